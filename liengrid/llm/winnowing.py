"""Benchmark decontamination by winnowing.

Of the hashes of all K-word grams of a text, the least of every W consecutive ones is kept as a
fingerprint. Two texts that share W + K - 1 = 13 words in a row keep the same fingerprint
there, so joining fingerprints finds every shared span of 13 words. A hit is extended to both sides
as far as the words agree; the words that the extension can need go with the fingerprint, so no
text is read again. Benchmark items of fewer than 13 words have their whole text as fingerprint.

Documents keep only fingerprints that a fixed-size table of slots, filled from the benchmark, does
not rule out: the table has the same size for a benchmark of any size and never rules out a match.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from liengrid.llm import texts
from liengrid.sources.tables import stage

SPAN_WORDS = 13
GRAM_WORDS = 5
WINDOW = SPAN_WORDS - GRAM_WORDS + 1
SLOT_BITS = 22
REACH = SPAN_WORDS - GRAM_WORDS
_CONTEXT = GRAM_WORDS + 2 * REACH

_HIT = "struct<fingerprint: long, words: int, start: int, context: binary>"


def _kept(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Indices of grams that are the least of some window of WINDOW grams of one text."""
    count = len(values) - WINDOW + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    least = values[:count].copy()
    for shift in range(1, WINDOW):
        np.minimum(least, values[shift : shift + count], out=least)
    least[owner[:count] != owner[WINDOW - 1 :]] = 0
    # A gram is kept if it equals the least of a window that holds it, that is the greatest of these least ones.
    padded = np.zeros(len(values) + WINDOW - 1, np.uint64)
    padded[WINDOW - 1 : WINDOW - 1 + count] = least
    greatest = padded[: len(values)].copy()
    for shift in range(1, WINDOW):
        np.maximum(greatest, padded[shift : shift + len(values)], out=greatest)
    return np.flatnonzero((greatest == values) & (greatest > 0))


def _fingerprints(
    hashes: np.ndarray, owner: np.ndarray, lengths: Sequence[int]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Span length, fingerprints and word index of each: winnowed grams, then whole spans of the lengths."""
    values, first = texts.gram_hashes(hashes, owner, GRAM_WORDS)
    kept = _kept(values, owner[first])
    yield SPAN_WORDS, values[kept], first[kept]
    for length in lengths:
        yield length, *texts.gram_hashes(hashes, owner, length)


def _contexts(hashes: np.ndarray, owner: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Word hashes from REACH before a gram to REACH after it, 0 outside of the text."""
    index = first[:, None] + np.arange(-REACH, GRAM_WORDS + REACH)
    inside = (index >= 0) & (index < len(hashes))
    index = np.clip(index, 0, max(len(hashes) - 1, 0))
    inside &= owner[index] == owner[first][:, None]
    return np.where(inside, hashes[index], np.uint64(0))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, texts.Words]:
    data = texts.LOWER[data]
    found = texts.words(data, offsets, texts.ALPHANUMERIC)
    return texts.span_hashes(data, found.starts, found.ends), found


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in texts.text_slices(batch.column("text")):
            hashes, found = _words(data, offsets)
            count, owner = np.diff(found.bounds), found.owner
            item = batch.column("item").slice(first, last - first).to_numpy(zero_copy_only=False)
            for length in [SPAN_WORDS, *sorted({int(c) for c in count if 0 < c < SPAN_WORDS})]:
                if length == SPAN_WORDS:
                    _, values, at = next(iter(_fingerprints(hashes, owner, ())))
                    context = _contexts(hashes, owner, at)
                else:
                    whole = count[owner] == length
                    values, at = texts.gram_hashes(hashes[whole], owner[whole], length)
                    at = np.flatnonzero(whole)[at]
                    context = np.zeros((len(at), 0), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(values.view(np.int64)),
                        pa.array(np.full(len(at), length, np.int32)),
                        pa.array(item[owner[at]], pa.string()),
                        pa.array([row.tobytes() for row in context], pa.binary()),
                    ],
                    names=["fingerprint", "words", "item", "item_context"],
                )


def _document_rows(batches: Iterator[pa.RecordBatch], slots, lengths: Sequence[int]) -> Iterator[pa.RecordBatch]:
    taken: np.ndarray = slots.value
    for batch in batches:
        for first, last, data, offsets in texts.text_slices(batch.column("text")):
            hashes, found = _words(data, offsets)
            owner, count = found.owner, np.diff(found.bounds)
            rows = []
            for length, values, at in _fingerprints(hashes, owner, lengths):
                possible = taken[(values >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                values, at = values[possible], at[possible]
                context = _contexts(hashes, owner, at) if length == SPAN_WORDS else np.zeros((len(at), 0), np.uint64)
                start = at - found.bounds[owner[at]]
                rows += zip(owner[at].tolist(), values.view(np.int64).tolist(), [length] * len(at), start.tolist(), context)
            hits: list[list[dict]] = [[] for _ in count]
            for text, value, length, start, context in rows:
                hits[text].append({"fingerprint": value, "words": length, "start": start, "context": context.tobytes()})
            names = ["doc_id", "text_key", "n_words", "hits"]
            kind = pa.list_(
                pa.struct([("fingerprint", pa.int64()), ("words", pa.int32()), ("start", pa.int32()), ("context", pa.binary())])
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, last - first),
                    pa.array(texts.span_hashes(data, offsets[:-1], offsets[1:]).view(np.int64)),
                    pa.array(count),
                    pa.array(hits, kind),
                ],
                names=names,
            )


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of words around pairs of equal fingerprints that agree and are long enough."""
    for batch in batches:
        words = batch.column("words").to_numpy(zero_copy_only=False)
        start = batch.column("start").to_numpy(zero_copy_only=False).astype(np.int64)
        end = start + words
        keep = words < SPAN_WORDS
        grams = np.flatnonzero(~keep)
        if len(grams):
            mine, theirs = (
                np.frombuffer(b"".join(batch.column(c).take(pa.array(grams)).to_pylist()), np.uint64).reshape(-1, _CONTEXT)
                for c in ("context", "item_context")
            )
            same = (mine == theirs) & (mine != 0)
            before = np.cumprod(same[:, REACH - 1 :: -1], axis=1).sum(axis=1)
            after = np.cumprod(same[:, REACH + GRAM_WORDS :], axis=1).sum(axis=1)
            whole = same[:, REACH : REACH + GRAM_WORDS].all(axis=1)
            end[grams] = start[grams] + GRAM_WORDS + after
            start[grams] -= before
            keep[grams] = whole & (before + GRAM_WORDS + after >= SPAN_WORDS)
        kept = pa.array(keep)
        columns = [batch.column(c).filter(kept) for c in ("doc_id", "text_key", "item")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(start[keep].astype(np.int32)), pa.array(end[keep].astype(np.int32))],
            names=["doc_id", "text_key", "item", "start", "end"],
        )


def benchmark_spans(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables: (doc_id, text_key, n_words) of each row, and spans (doc_id, text_key, item, start, end).

    start and end count words of the document; spans of an item may overlap. text_key tells
    apart rows with the same doc_id and different texts.
    """
    spark = documents.sparkSession
    items = benchmark.selectExpr("cast(item_id as string) as item", "cast(text as string) as text").where("item is not null")
    fingerprints = stage(
        items.mapInArrow(_item_rows, "fingerprint long, words int, item string, item_context binary").distinct()
    )
    lengths = [r.words for r in fingerprints.where(f"words < {SPAN_WORDS}").select("words").distinct().collect()]
    slot = f"shiftrightunsigned(fingerprint, {64 - SLOT_BITS})"
    taken = np.zeros(1 << SLOT_BITS, bool)
    taken[fingerprints.selectExpr(f"cast({slot} as int) as slot").distinct().toArrow()["slot"].to_numpy()] = True
    source = documents.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    rows = partial(_document_rows, slots=spark.sparkContext.broadcast(taken), lengths=sorted(lengths))
    found = stage(source.mapInArrow(rows, f"doc_id long, text_key long, n_words long, hits array<{_HIT}>"))
    hits = found.where("size(hits) > 0").selectExpr("doc_id", "text_key", "inline(hits)").distinct()
    pairs = hits.join(fingerprints, ["fingerprint", "words"])
    spans = pairs.mapInArrow(_span_rows, "doc_id long, text_key long, item string, start int, end int").distinct()
    return found.drop("hits"), stage(spans)


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """How far each row of documents (doc_id, text) repeats items of the benchmark (item_id, text).

    Words are runs of a-z (A-Z lower-cased), 0-9 and non-ASCII characters. A window is 13 consecutive
    words of an item, or all words of a shorter one; a document's word inside an occurrence of a window
    is hit. Returns doc_id, n_words, n_hit, n_items (items with occurring windows), items_sha256 (of
    their ids, sorted as text, joined by a comma) and contaminated (n_hit > 0 and 20 * n_hit >=
    n_words). Null and empty texts have no words and no hits. Rows are judged each by itself, repeated
    ones and those with a null doc_id too; items without id, text or words hit nothing, and rows that
    share an item_id are one item. Other columns are ignored.
    """
    counts, spans = benchmark_spans(documents, benchmark)
    key = ["doc_id", "text_key"]
    words = spans.selectExpr(*key, "explode(sequence(start, end - 1)) as word").distinct()
    n_hit = words.groupBy(*key).count().selectExpr("doc_id as hit_doc", "text_key as hit_key", "count as n_hit")
    items = spans.select(*key, "item").distinct().groupBy(*key).agg({"item": "collect_list"})
    items = items.selectExpr("doc_id as item_doc", "text_key as item_key", "array_sort(`collect_list(item)`) as items")
    joined = counts.join(n_hit, (counts.doc_id.eqNullSafe(n_hit.hit_doc)) & (counts.text_key == n_hit.hit_key), "left")
    joined = joined.join(items, (joined.doc_id.eqNullSafe(items.item_doc)) & (joined.text_key == items.item_key), "left")
    return joined.selectExpr(
        "doc_id",
        "n_words",
        "coalesce(n_hit, 0L) as n_hit",
        "cast(if(items is null, 0, size(items)) as long) as n_items",
        "sha2(coalesce(array_join(items, ','), ''), 256) as items_sha256",
        "coalesce(n_hit, 0L) > 0 and 20 * coalesce(n_hit, 0L) >= n_words as contaminated",
    )
