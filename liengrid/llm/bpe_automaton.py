"""Encoding by a tokenization automaton compiled from the merges, and decoding by its arc labels.

States are named by the arc taken last, arcs by tokens. Each merge (u, v) -> uv adds a gadget:
the arc uv, which ends where v ends, and the ban of v directly after u, which every arc that has
u at its right edge hands on, as does every arc that has v at its left edge. Compiled, an arc
keeps its two edges: the symbols along it with the rank of the merge that takes each of them away.
Whether arc y may follow arc x is read from the edges and the table of merges: it may not, if some
merge of a right-edge symbol of x with a left-edge symbol of y comes before both are taken away.

The path of a word is unique: for each prefix exactly one arc ends there, and its predecessor is the
arc that ends where it begins. Words are run through the tables together, position by position.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from liengrid.llm import texts

KEPT_WORDS = 300_000
SLICE_BYTES = 4 << 20
_NO = -1
_LAST = 2**31 - 1


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


@dataclass
class Automaton:
    """labels: the text of each arc. inner, final: the arc of a byte inside or at the end of a word.

    step_keys, step_to: the trie of arc spellings, node * 512 + byte (+ 256 at the end of a word);
    arc_of: the arc spelt at a node. pair_keys, pair_ranks: the merges, left * size + right.
    right_edge, left_edge: symbols along the edges of each arc, _NO beyond the end, and the ranks that end them.
    """

    labels: list[str]
    step_keys: np.ndarray
    step_to: np.ndarray
    arc_of: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    right_edge: np.ndarray
    right_until: np.ndarray
    left_edge: np.ndarray
    left_until: np.ndarray
    longest: int
    special: dict[str, int]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * len(self.labels) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], _LAST)

    def may_follow(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether arc y may follow arc x, for arrays of arcs."""
        allowed = np.ones(len(x), bool)
        for i in range(self.right_edge.shape[1]):
            for j in range(self.left_edge.shape[1]):
                open_ = np.flatnonzero(allowed & (self.right_edge[x, i] >= 0) & (self.left_edge[y, j] >= 0))
                if not len(open_):
                    break
                a, b = x[open_], y[open_]
                rank = self._rank(self.right_edge[a, i], self.left_edge[b, j])
                # Of equal pairs the left one is merged first.
                allowed[open_] = ~((rank < self.right_until[a, i]) & (rank <= self.left_until[b, j]) & (rank < _LAST))
        return allowed


def compile_automaton(model: str) -> Automaton:
    """The automaton of a byte-level BPE model (JSON text) with a word-end suffix."""
    spec = json.loads(model)
    vocabulary = spec["model"]["vocab"]
    suffix = spec["model"]["end_of_word_suffix"] or ""
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = 1 + max([*vocabulary.values(), *special.values()])
    labels = [""] * size
    for text, i in [*vocabulary.items(), *special.items()]:
        labels[i] = text

    spelling: dict[int, tuple[int, ...]] = {}
    for byte, character in _byte_characters().items():
        spelling[vocabulary[character]] = (byte,)
        spelling[vocabulary[character + suffix]] = (byte + 256,)
    parts: dict[int, tuple[int, int, int]] = {}
    right: dict[int, list[tuple[int, int]]] = {i: [(i, _LAST)] for i in spelling}
    left: dict[int, list[tuple[int, int]]] = {i: [(i, _LAST)] for i in spelling}
    for rank, merge in enumerate(spec["model"]["merges"]):
        u, v = (vocabulary[part] for part in (merge.split(" ") if isinstance(merge, str) else merge))
        arc = vocabulary[labels[u] + labels[v]]
        if arc in spelling or u not in spelling or v not in spelling:
            raise ValueError(f"merge {rank} makes a symbol twice or of symbols that come later")
        parts[arc] = (u, v, rank)
        spelling[arc] = spelling[u] + spelling[v]
        cut = lambda edge: [(edge[0][0], rank), *edge[1:]]
        right[arc] = [(arc, _LAST), *cut(right[v])]
        left[arc] = [(arc, _LAST), *cut(left[u])]

    def table(edges: dict[int, list[tuple[int, int]]], column: int, fill: int) -> np.ndarray:
        result = np.full((size, max(map(len, edges.values()))), fill, np.int32)
        for arc, edge in edges.items():
            result[arc, : len(edge)] = [e[column] for e in edge]
        return result

    nodes: dict[tuple[int, int], int] = {}
    arc_of = [_NO]
    for arc, path in spelling.items():
        node = 0
        for symbol in path:
            node = nodes.setdefault((node, symbol), len(arc_of))
            if node == len(arc_of):
                arc_of.append(_NO)
        arc_of[node] = arc
    steps = sorted((node * 512 + symbol, to) for (node, symbol), to in nodes.items())
    pairs = sorted((u * size + v, rank) for u, v, rank in parts.values())
    automaton = Automaton(
        labels,
        np.array([k for k, _ in steps], np.int64),
        np.array([to for _, to in steps], np.int32),
        np.array(arc_of, np.int32),
        np.array([k for k, _ in pairs], np.int64),
        np.array([r for _, r in pairs], np.int32),
        table(right, 0, _NO),
        table(right, 1, _LAST),
        table(left, 0, _NO),
        table(left, 1, _LAST),
        max(map(len, spelling.values())),
        special,
    )
    _drop_unreachable(automaton, parts)
    return automaton


def _drop_unreachable(automaton: Automaton, parts: dict[int, tuple[int, int, int]]) -> None:
    """Arcs that no text is encoded to: a merge between their parts, or within one, comes first."""
    arcs = np.array(list(parts), np.int64)
    u, v, rank = np.array([parts[a] for a in arcs.tolist()], np.int64).T
    crossed = np.zeros(len(arcs), bool)
    for i in range(automaton.right_edge.shape[1]):
        for j in range(automaton.left_edge.shape[1]):
            between = automaton._rank(automaton.right_edge[u, i], automaton.left_edge[v, j])
            until = np.minimum(automaton.right_until[u, i] - 1, automaton.left_until[v, j])
            crossed |= (between <= until) & (between < rank)
    bad = set(arcs[crossed].tolist())
    for arc in arcs.tolist():
        if bad.intersection(parts[arc][:2]):
            bad.add(arc)
    automaton.arc_of[np.isin(automaton.arc_of, list(bad))] = _NO


class Encoder:
    """Runs words through an automaton, with a memory of arc pairs that were looked at."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.seen = np.full(1 << 22, -1, np.int64)
        self.verdict = np.zeros(1 << 22, bool)

    def _may_follow(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keys = x.astype(np.int64) * len(self.automaton.labels) + y
        slots = ((keys * 0x9E3779B1) >> 10) & (len(self.seen) - 1)
        result = self.verdict[slots]
        missing = np.flatnonzero(self.seen[slots] != keys)
        if len(missing):
            fresh, back = np.unique(keys[missing], return_inverse=True)
            size = len(self.automaton.labels)
            allowed = self.automaton.may_follow(fresh // size, fresh % size)
            result[missing] = allowed[back]
            places = ((fresh * 0x9E3779B1) >> 10) & (len(self.seen) - 1)
            # Of arcs that meet in one slot the last stays, in both tables.
            last = len(places) - 1 - np.unique(places[::-1], return_index=True)[1]
            self.seen[places[last]], self.verdict[places[last]] = fresh[last], allowed[last]
        return result

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The arcs of each word, in order."""
        automaton = self.automaton
        lengths = np.array([len(w) for w in words], np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        symbols[offsets[1:][lengths > 0] - 1] += 256
        room = np.repeat(offsets[1:], lengths) - np.arange(len(symbols))
        # arcs[l][p]: the arc of l + 1 symbols that begins at p.
        arcs, node, at = [], np.zeros(len(symbols), np.int64), np.arange(len(symbols))
        for length in range(min(automaton.longest, int(lengths.max(initial=0)))):
            live = room[at] > length
            at, node = at[live], node[live]
            keys = node * 512 + symbols[at + length]
            found = np.minimum(np.searchsorted(automaton.step_keys, keys), len(automaton.step_keys) - 1)
            known = automaton.step_keys[found] == keys
            at, node = at[known], automaton.step_to[found[known]].astype(np.int64)
            if not len(at):
                break
            row = np.full(len(symbols), _NO, np.int32)
            row[at] = automaton.arc_of[node]
            arcs.append(row)
        ends_with = np.full(len(symbols) + 1, _NO, np.int32)
        order = np.argsort(-lengths, kind="stable")
        sizes, first = lengths[order], offsets[:-1][order]
        for end in range(1, int(lengths.max(initial=0)) + 1):
            open_ = first[: np.searchsorted(-sizes, -end, "right")]
            for length in range(min(end, len(arcs)), 0, -1):
                if not len(open_):
                    break
                begin = open_ + end - length
                arc = arcs[length - 1][begin]
                fits = arc >= 0
                if length < end:
                    some = np.flatnonzero(fits)
                    fits[some] = self._may_follow(ends_with[begin[some] - 1], arc[some])
                ends_with[open_[fits] + end - 1] = arc[fits]
                open_ = open_[~fits]
        span = np.zeros(len(automaton.labels), np.int64)
        for length, row in enumerate(arcs, 1):
            span[row[row >= 0]] = length
        return self._paths(ends_with, span, offsets)

    @staticmethod
    def _paths(ends_with: np.ndarray, span: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
        """From the last arc of each word back to its first."""
        at, floor = offsets[1:].copy(), offsets[:-1]
        found_word, found_arc = [], []
        live = np.flatnonzero(at > floor)
        while len(live):
            arc = ends_with[at[live] - 1]
            found_word.append(live)
            found_arc.append(arc)
            at[live] -= span[arc]
            live = live[at[live] > floor[live]]
        if not found_word:
            return [[] for _ in floor]
        word, arc = np.concatenate(found_word[::-1]), np.concatenate(found_arc[::-1])
        order = np.argsort(word, kind="stable")
        bounds = np.searchsorted(word[order], np.arange(len(floor) + 1)).tolist()
        flat = arc[order].tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]


_LETTERS = "a-zªµºß-öø-ÿ"
_NUMBERS = "0-9²³¹¼½¾"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\t-\\r \x85\xa0{_LETTERS}{_NUMBERS}]+")


class Splitter:
    """Text to words as the model's normalizer and pre-tokenizer do it; special texts come out whole."""

    def __init__(self, model: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        special = [t["content"] for t in json.loads(model)["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.back = {ord(c): b for b, c in _byte_characters().items()}

    def segments(self, text: str) -> list[str]:
        """Ordinary and special stretches in turn, beginning with an ordinary one."""
        return self.special.split(text) if "<" in text else [text]

    def words(self, text: str) -> list[str]:
        """Words of an ordinary stretch; in Latin-1 lower case and the pattern need no tables."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            normal = self.library.normalizer.normalize_str(text)
            found = self.library.pre_tokenizer.pre_tokenize_str(normal)
            return [bytes(self.back[ord(c)] for c in word).decode() for word, _ in found]
        return _LATIN.findall(text.lower())


def _encode_rows(batches: Iterator[pa.RecordBatch], compiled, model, digests: bool) -> Iterator[pa.RecordBatch]:
    automaton: Automaton = compiled.value
    encoder, splitter = Encoder(automaton), Splitter(model.value)
    special_ids = {text: str(i) for text, i in automaton.special.items()}
    ids_of, labels_of = dict(special_ids), {text: text for text in special_ids}
    label, spelt = automaton.labels.__getitem__, [str(i) for i in range(len(automaton.labels))].__getitem__
    for batch in batches:
        for first, last, _, _ in texts.text_slices(batch.column("text"), SLICE_BYTES):
            documents = []
            for text in batch.column("text").slice(first, last - first).to_pylist():
                found: list[str] = []
                for n, segment in enumerate(splitter.segments(text or "")):
                    found += [segment] if n % 2 else splitter.words(segment)
                documents.append(found)
            if len(ids_of) > KEPT_WORDS:
                ids_of, labels_of = dict(special_ids), {text: text for text in special_ids}
            new = list(set().union(*documents).difference(ids_of))
            for word, path in zip(new, encoder.encode([w.encode("utf-8", "surrogatepass") for w in new])):
                ids_of[word] = " ".join(map(spelt, path))
                labels_of[word] = " ".join(map(label, path))
            ids = [" ".join(map(ids_of.__getitem__, found)) for found in documents]
            decoded = [" ".join(map(labels_of.__getitem__, found)) for found in documents]
            counts = [text.count(" ") + 1 if text else 0 for text in ids]
            if digests:
                ids, decoded = ([sha256(text.encode()).hexdigest() for text in made] for made in (ids, decoded))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, last - first),
                    pa.array(counts, pa.int64()),
                    pa.array(ids, pa.string()),
                    pa.array(decoded, pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )


def encode_documents(documents: DataFrame, model_file: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by a space) and decoded of each row of (doc_id, text).

    The model is a byte-level BPE with a word-end suffix and lower-casing normalizer, as JSON. Ids are
    those of its library without added tokens; special texts inside a text become their own ids.
    decoded joins the labels of the arcs by a space, as the library does for a model without a decoder.
    With digests, ids and decoded are lowercase hex SHA-256 of these texts. A null text counts as
    empty: no tokens, empty texts. Rows are encoded each by itself, repeated ones and those with a
    null doc_id too; other columns are ignored. The driver compiles the automaton, whose tables
    (bounded by the vocabulary) go to the executors.
    """
    with open(model_file, encoding="utf-8") as file:
        model = file.read()
    context = documents.sparkSession.sparkContext
    compiled = context.broadcast(compile_automaton(model))
    rows = partial(_encode_rows, compiled=compiled, model=context.broadcast(model), digests=digests)
    source = documents.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return source.mapInArrow(rows, "doc_id long, n_tokens long, ids string, decoded string")
