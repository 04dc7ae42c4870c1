"""Token counts of whole texts by rank-synchronous merging in ragged numpy arrays.

The pre-tokens of a slice of texts lie one after the other in flat arrays of symbols. In each
step every sequence that still has a merge applies its lowest-rank pair, all sequences at
once, and the arrays are packed again; what survives is counted. Counts of pre-tokens are kept
for the following slices, up to a bounded number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from liengrid.llm import texts

LIMIT = 4096
KEPT_PRETOKENS = 400_000
SLICE_BYTES = 4 << 20
_SPACE = "▁"
_NEVER = np.int32(2**31 - 1)


@dataclass
class MergeTable:
    """pairs: sorted keys left * width + right; ranks and merged: what each pair becomes.

    first_symbol: the symbol of each code point; cost: tokens that a symbol counts for.
    """

    width: int
    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    first_symbol: np.ndarray
    cost: np.ndarray
    splits: bool

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NEVER) and result of pairs of symbols."""
        keys = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        known = self.pairs[at] == keys
        return np.where(known, self.ranks[at], _NEVER), self.merged[at]


def load_merges(model_file: str) -> MergeTable:
    """The merge table of a piece model with byte fallback.

    Two symbols merge if their texts together are a piece; the piece with the best score is
    merged first, the leftmost of equal ones. A character that is no piece counts for its bytes.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    count = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(count)]
    piece_ids = {model.id_to_piece(i): i for i in range(count) if not special[i]}
    by_score = sorted(piece_ids.values(), key=lambda i: -model.get_score(i))
    rank = np.zeros(count, np.int32)
    place = -1
    for n, i in enumerate(by_score):
        if n == 0 or model.get_score(i) != model.get_score(by_score[n - 1]):
            place += 1
        rank[i] = place
    characters = 0x110000
    width = count + characters
    first_symbol = np.arange(count, width, dtype=np.int32)
    cost = np.ones(width, np.int32)
    points = np.arange(characters)
    bytes_of = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    has_bytes = any(model.is_byte(i) for i in range(count))
    cost[count:] = bytes_of if has_bytes else 1
    for piece, i in piece_ids.items():
        if len(piece) == 1:
            first_symbol[ord(piece)] = i

    def symbol(part: str) -> int | None:
        return int(first_symbol[ord(part)]) if len(part) == 1 else piece_ids.get(part)

    rules = {}
    for piece, i in piece_ids.items():
        for cut in range(1, len(piece)):
            left, right = symbol(piece[:cut]), symbol(piece[cut:])
            if left is not None and right is not None:
                rules[left * width + right] = i
    pairs = np.array(sorted(rules), np.int64)
    merged = np.array([rules[k] for k in pairs.tolist()], np.int32)
    # Nothing merges over a change from text to space or over a line break, if no piece holds one.
    splits = not any("\n" in p or re.search(f"[^{_SPACE}]{_SPACE}", p) for p in piece_ids)
    return MergeTable(width, pairs, rank[merged], merged, first_symbol, cost, splits)


_PRETOKENS = re.compile(f"{_SPACE}+[^{_SPACE}\n]*|[^{_SPACE}\n]+|\n+")


def pretokens(text: str, splits: bool = True) -> list[str]:
    """Parts of a text that are merged apart from each other; together they are the whole text."""
    if not text:
        return []
    text = _SPACE + text.replace(" ", _SPACE)
    return _PRETOKENS.findall(text) if splits else [text]


def _pair_ranks(table: MergeTable, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ranks, merged = table.look_up(symbols[:-1], symbols[1:])
    ranks[owner[:-1] != owner[1:]] = _NEVER
    return np.append(ranks, _NEVER), np.append(merged, 0)


def _follow(at: np.ndarray) -> np.ndarray:
    """Which places come directly after the pair at the place before them."""
    return np.append(False, at[1:] == at[:-1] + 2)[: len(at)]


def count_sequences(table: MergeTable, sequences: list[str]) -> np.ndarray:
    """Number of tokens of each pre-token."""
    counts = np.zeros(len(sequences), np.int64)
    lengths = np.array([len(s) for s in sequences], np.int64)
    points = np.frombuffer("".join(sequences).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = table.first_symbol[points]
    owner = np.repeat(np.arange(len(sequences)), lengths)
    ranks, merged = _pair_ranks(table, symbols, owner)
    while len(symbols):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        lowest = np.minimum.reduceat(ranks, starts)
        finished = lowest == _NEVER
        if finished.any():
            sizes = np.diff(np.append(starts, len(symbols)))
            counts[owner[starts]] += np.where(finished, np.add.reduceat(table.cost[symbols], starts), 0)
            keep = np.repeat(~finished, sizes)
            symbols, owner, ranks, merged = symbols[keep], owner[keep], ranks[keep], merged[keep]
            if not len(symbols):
                break
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = lowest[~finished]
        sequence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(symbols))))
        at = np.flatnonzero(ranks == lowest[sequence])
        at = at[_every_other(at)]
        # All places of a sequence's lowest pair at once, unless a merge brings forth a pair that would come before
        # the next place: then the leftmost place alone.
        new = merged[at]
        rank = lowest[sequence[at]]
        before = np.maximum(at - 1, 0)
        after_place = np.minimum(at + 2, len(symbols) - 1)
        left = symbols[before].copy()
        follows = _follow(at)
        left[follows] = new[np.flatnonzero(follows) - 1]
        left_place = np.where(follows, at - 2, before)
        left_rank = np.where(
            (left_place < at) & (owner[left_place] == owner[at]), table.look_up(left, new)[0], _NEVER
        )
        right_rank = np.where(
            (after_place == at + 2) & (owner[after_place] == owner[at]),
            table.look_up(new, symbols[after_place])[0],
            _NEVER,
        )
        sooner = np.zeros(len(starts), bool)
        sooner[sequence[at[(left_rank <= rank) | (right_rank <= rank)]]] = True
        if sooner.any():
            leftmost = np.append(True, sequence[at[1:]] != sequence[at[:-1]])
            at = at[leftmost | ~sooner[sequence[at]]]
        symbols = symbols.copy()
        symbols[at] = merged[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        changed = np.zeros(len(symbols), bool)
        changed[at] = True
        changed[np.maximum(at - 1, 0)] = True
        changed[at[_follow(at)] - 2] = True
        symbols, owner, ranks, merged, changed = (a[keep] for a in (symbols, owner, ranks, merged, changed))
        renew = np.flatnonzero(changed)
        following = np.minimum(renew + 1, len(symbols) - 1)
        ranks[renew], merged[renew] = table.look_up(symbols[renew], symbols[following])
        ranks[renew[(following == renew) | (owner[following] != owner[renew])]] = _NEVER
    return counts


def _every_other(at: np.ndarray) -> np.ndarray:
    """Of places that follow each other directly, the first, third, ...: they overlap."""
    if not len(at):
        return np.zeros(0, bool)
    new_run = np.append(True, at[1:] != at[:-1] + 1)
    run_start = np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
    return (np.arange(len(at)) - run_start) % 2 == 0


def _count_rows(batches: Iterator[pa.RecordBatch], table, limit: int) -> Iterator[pa.RecordBatch]:
    merges: MergeTable = table.value
    known: dict[str, int] = {}
    for batch in batches:
        for first, last, _, offsets in texts.text_slices(batch.column("text"), SLICE_BYTES):
            parts = [pretokens(t or "", merges.splits) for t in batch.column("text").slice(first, last - first).to_pylist()]
            if len(known) > KEPT_PRETOKENS:
                known.clear()
            new = list(set().union(*parts).difference(known))
            known.update(zip(new, count_sequences(merges, new).tolist()))
            n_tokens = np.array([sum(map(known.__getitem__, p)) for p in parts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, last - first),
                    pa.array(np.diff(offsets)),
                    pa.array(n_tokens),
                    pa.array(n_tokens > limit),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )


def token_counts(documents: DataFrame, model_file: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of (doc_id, text).

    Tokens are those of the piece model at model_file, without begin, end or added tokens; a null
    text counts as empty: no bytes, no tokens. Rows are counted each by itself, repeated ones and
    those with a null doc_id too; other columns are ignored. The driver reads the model, whose
    merge table (bounded by the vocabulary) goes to the executors.
    """
    table = documents.sparkSession.sparkContext.broadcast(load_merges(model_file))
    source = documents.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return source.mapInArrow(
        partial(_count_rows, table=table, limit=limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
