"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its bytes, A-Z lower-cased, and an end byte. Each byte is coded in eight binary decisions.
For each, several predictors look up how often the bit was 0 and 1 in the training texts after
the same context: the last byte, the last three bytes, and the word so far. Contexts are hashed to
tables of fixed size. The log-odds of the predictors are combined by weights, which are gated by the
place of the bit in its byte, and are refined while a text is read: each bit, once coded, moves
the weights that coded it by a step of gradient descent on its cost. The weights that a text starts from
are learnt from all training texts: one Newton step of logistic regression from START_WEIGHT, to which
each byte gives one of its bits, the eight places in turn.

Counting covers all training texts: each task counts into tables of its own, Spark adds
them up, and the tables, of a size that does not depend on the corpus, go to all tasks. Words are
counted exactly: texts are handled in chunks, each with the list of its distinct words, so that
counts are joined once per chunk and word. The texts of a chunk are kept compressed, in slices of like lengths.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from liengrid.llm import texts
from liengrid.sources.tables import stage

CONTEXT_BITS = (8, 14, 14)
START_WEIGHT = 0.4
MOST_WEIGHT = 1.0
RATE = 0.01
MOST_ODDS = 12
PRIOR = 0.4
CHUNK_BYTES = 16 << 20
SCORED_BYTES = 2 << 20
GATHERED_BYTES = 1 << 14
END_WORD = np.int64(0x656E64)

_ROWS = "kind byte, chunk long, texts binary, key long, count long"
_DOCUMENT, _WORD, _SLOT = 0, 1, 2
_STARTS = np.concatenate(([0], np.cumsum([1 << (bits + 8) for bits in CONTEXT_BITS])))
_PLACES = np.arange(8)
_BYTES = np.arange(256)[:, None]
# For each byte the nodes at which its bits are decided, and the bits as -1 and 1.
_NODES = (1 << _PLACES) | (_BYTES >> (8 - _PLACES))
_SIGNS = (((_BYTES >> (7 - _PLACES)) & 1) * 2 - 1).astype(np.float32)


def _sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with an end byte 0 after each text."""
    with_end = np.insert(texts.LOWER[data], offsets[1:], 0)
    return with_end, offsets + np.arange(len(offsets))


def _contexts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each byte and predictor the slot of its context, times 256."""
    filled = offsets[:-1][np.diff(offsets) > 0]
    three = np.zeros(len(data), np.uint32)
    for n in (1, 2, 3):
        three[n:] |= data[:-n].astype(np.uint32) << np.uint32(8 * n - 8)
    # The first bytes of a text see nothing of the text before.
    for n, mask in ((0, 0), (1, 0xFF), (2, 0xFFFF)):
        first = np.minimum(filled + n, len(data) - 1)
        three[first] &= np.uint32(mask)
    one = (three & np.uint32(0xFF)).astype(np.int32) << 8
    three = ((three * np.uint32(0x9E3779B1)) >> np.uint32(32 - CONTEXT_BITS[1])).astype(np.int32) << 8
    # The word so far is the bytes since the last start of a word or text.
    begin = np.zeros(len(data), np.int64)
    starts = np.append(texts.words(data, offsets, texts.NOT_SPACE).starts, filled)
    begin[starts] = starts
    begin = np.maximum.accumulate(begin)
    word = texts.prefix_hashes(data, begin) >> np.uint64(64 - CONTEXT_BITS[2])
    return [one, three, word.astype(np.int32) << 8]


def _bit_odds(counts: np.ndarray) -> np.ndarray:
    """From counts (contexts, 256) the log-odds of a 1 at each of 256 nodes; 0 where nothing was seen."""
    odds = np.zeros(counts.shape, np.float32)
    level = counts.astype(np.float32)
    for depth in range(7, -1, -1):
        zeros, ones = level[:, 0::2], level[:, 1::2]
        odds[:, 1 << depth : 2 << depth] = np.log((ones + PRIOR) / (zeros + PRIOR))
        level = zeros + ones
    return odds.ravel()


def _build_tables(slots: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Per predictor the log-odds at slot * 256 + node."""
    flat = np.zeros(_STARTS[-1], np.float32)
    flat[slots] = counts
    return [_bit_odds(flat[a:b].reshape(-1, 256)) for a, b in zip(_STARTS[:-1], _STARTS[1:])]


def text_costs(
    tables: list[np.ndarray], data: np.ndarray, offsets: np.ndarray, start: np.ndarray | None = None
) -> np.ndarray:
    """Coding cost of each sequence, in units of e; data has the end bytes.

    start has the weights by predictor and place of the bit that each sequence begins with. All sequences are
    read side by side, byte by byte. As weights are gated by the place, each bit of a byte has weights of its
    own, so the eight bits of a byte take their steps at once.
    """
    contexts = _contexts(data, offsets)
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    begin, longest = offsets[:-1][order], int(lengths.max(initial=0))
    if start is None:
        start = np.full((len(contexts), 8), START_WEIGHT)
    weights = [np.tile(w.astype(np.float32), len(lengths)) for w in start]
    # Longer sequences come first, so those that have a byte at a position are the first ones.
    live = np.searchsorted(-lengths[order], -np.arange(longest), "left")
    costs = np.zeros(len(lengths))
    one, rate, most = np.float32(1), np.float32(RATE), np.float32(MOST_ODDS)
    first = 0
    while first < longest:
        last = min(longest, first + max(1, GATHERED_BYTES // int(live[first])))
        counts = live[first:last]
        bounds = np.concatenate(([0], np.cumsum(counts)))
        text = np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts)
        at = begin[text] + np.repeat(np.arange(first, last), counts)
        nodes, sign = _NODES[data[at]], _SIGNS[data[at]].ravel()
        # Log-odds for the bit that came, by position, sequence and place.
        inputs = [t.take(c[at][:, None] + nodes, mode="clip").ravel() * sign for t, c in zip(tables, contexts)]
        mixed = np.empty(len(sign), np.float32)
        term, error = np.empty(8 * counts[0], np.float32), np.empty(8 * counts[0], np.float32)
        for a, b in zip((8 * bounds[:-1]).tolist(), (8 * bounds[1:]).tolist()):
            size = b - a
            odds, part, step = mixed[a:b], term[:size], error[:size]
            mine = [(x[a:b], w[:size]) for x, w in zip(inputs, weights)]
            np.multiply(*mine[0], odds)
            for x, w in mine[1:]:
                np.add(odds, np.multiply(x, w, part), odds)
            np.maximum(np.minimum(odds, most, odds), -most, odds)
            # The error of a bit coded with these odds is 1 / (1 + exp(odds)), its cost log(1 + exp(-odds)).
            np.divide(rate, np.add(np.exp(odds, step), one, step), step)
            for x, w in mine:
                np.add(w, np.multiply(x, step, part), w)
        cost = np.log1p(np.exp(-mixed)).reshape(-1, 8).sum(axis=1)
        costs[: counts[0]] += np.bincount(text, weights=cost, minlength=counts[0])
        first = last
    result = np.empty(len(lengths))
    result[order] = costs
    return result


def _weight_sums(batches: Iterator[pa.RecordBatch], tables) -> Iterator[pa.RecordBatch]:
    """Gradient and Hessian of the cost of the training texts at START_WEIGHT: per place of the bit, the
    sums of each predictor and of each pair of predictors. A byte gives the bit at its position modulo 8."""
    count = len(CONTEXT_BITS)
    sums = np.zeros((8, count, 1 + count))
    for batch in batches:
        for packed in batch.column("texts"):
            for documents in _unpacked(packed):
                learnt = documents.filter(pc.invert(documents.column("held_out")))
                for _, _, *texts_in in texts.text_slices(learnt.column("text")):
                    data, offsets = _sequence(*texts_in)
                    place = (np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))) & 7
                    node, sign = _NODES[data, place], _SIGNS[data, place]
                    x = np.stack([t.take(c + node, mode="clip") * sign for t, c in zip(tables.value, _contexts(data, offsets))])
                    error = 1 / (1 + np.exp(np.clip(START_WEIGHT * x.sum(axis=0), -MOST_ODDS, MOST_ODDS)))
                    for p in range(8):
                        mine = x[:, place == p].astype(np.float64)
                        wrong = error[place == p].astype(np.float64)
                        sums[p, :, 0] += mine @ wrong
                        sums[p, :, 1:] += (mine * (wrong * (1 - wrong))) @ mine.T
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["cell", "total"])


def _start_weights(totals: dict[int, float]) -> np.ndarray:
    """By predictor and place, from the sums of all tasks; START_WEIGHT without training texts."""
    count = len(CONTEXT_BITS)
    sums = np.array([totals.get(cell, 0.0) for cell in range(8 * count * (1 + count))]).reshape(8, count, 1 + count)
    steps = [np.linalg.solve(place[:, 1:] + np.eye(count), place[:, 0]) for place in sums]
    # Sums of tasks come in any order: their last digits are not kept.
    return np.clip(np.round(START_WEIGHT + np.array(steps).T, 4), 0, MOST_WEIGHT)


def _packed(documents: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(documents)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: pa.Scalar) -> list[pa.RecordBatch]:
    return list(pa.ipc.open_stream(packed.as_buffer()))


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, texts.Words]:
    data = texts.LOWER[data]
    found = texts.words(data, offsets, texts.NOT_SPACE)
    hashes = texts.span_hashes(data, found.starts, found.ends).view(np.int64)
    # One hash is kept for the end.
    return np.where(hashes == END_WORD, END_WORD + 1, hashes), found


def _table(kind: int, **columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    types = {"chunk": pa.int64(), "texts": pa.binary(), "key": pa.int64(), "count": pa.int64()}
    arrays = [pa.array(np.full(size, kind, np.int8))]
    arrays += [pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", *types])


def _own_counts(documents: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The words of a chunk and how often its training texts have them."""
    seen, learnt = [], []
    for batch in documents:
        learns = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for first, last, data, offsets in texts.text_slices(batch.column("text")):
            hashes, found = _word_hashes(data, offsets)
            seen += [hashes, np.full(last - first, END_WORD)]
            learnt += [learns[first:last][found.owner], learns[first:last]]
    words, which = np.unique(np.concatenate(seen), return_inverse=True)
    return words, np.bincount(which, weights=np.concatenate(learnt), minlength=len(words)).astype(np.int64)


def _gather_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents with their chunk, the words of each chunk and the task's counts by slot."""
    counts = np.zeros(_STARTS[-1], np.int32)
    for batch in batches:
        for first, last in texts.slices(texts.text_bytes(batch.column("text"))[1], CHUNK_BYTES):
            chunk = uuid4().int >> 65
            part = batch.slice(first, last - first)
            sizes = np.diff(texts.text_bytes(part.column("text"))[1])
            part = part.take(pa.array(np.argsort(-sizes, kind="stable")))
            bounds = texts.text_bytes(part.column("text"))[1]
            for a, b in texts.slices(bounds, SCORED_BYTES):
                yield _table(_DOCUMENT, chunk=[chunk], texts=[_packed(part.slice(a, b - a))])
            held = part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for a, b, data, offsets in texts.text_slices(part.column("text")):
                sequence, bounds = _sequence(data, offsets)
                taught = np.repeat(~held[a:b], np.diff(bounds))
                for start, slots in zip(_STARTS, _contexts(sequence, bounds)):
                    np.add.at(counts, start + (slots + sequence)[taught], np.int32(1))
            words, learnt = _own_counts([part])
            yield _table(_WORD, chunk=np.full(len(words), chunk), key=words, count=learnt)
    slots = np.flatnonzero(counts)
    yield _table(_SLOT, key=slots, count=counts[slots].astype(np.int64))


_SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
    "score double, n_bytes long, bits_per_byte double"
)


def _score_chunk(chunk: pa.Table, told: pa.Table, tables, start: np.ndarray, total: int, distinct: int) -> pa.Table:
    words, counts = _own_counts(batch for packed in chunk["texts"] for batch in _unpacked(packed))
    counts[np.searchsorted(words, told["key"].to_numpy())] = told["count"].to_numpy()
    floor = np.log10(total + distinct + 1)
    end = int(counts[np.searchsorted(words, END_WORD)])
    parts = []
    for batch in (batch for packed in chunk["texts"] for batch in _unpacked(packed)):
        for first, last, data, offsets in texts.text_slices(batch.column("text"), SCORED_BYTES):
            hashes, found = _word_hashes(data, offsets)
            count = counts[np.searchsorted(words, hashes)]
            size = np.diff(found.bounds)
            sums = np.concatenate(([0], np.cumsum(np.log10(count + 1) - floor)))
            sure = np.concatenate(([0], np.cumsum(count > 0)))
            cost = text_costs(tables.value, *_sequence(data, offsets), start)
            length = np.diff(offsets)
            parts.append(
                pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        batch.column("held_out").slice(first, last - first),
                        pa.array(size + 1),
                        pa.array(sure[found.bounds[1:]] - sure[found.bounds[:-1]] + (end > 0)),
                        pa.array(np.full(last - first, total)),
                        pa.array(sums[found.bounds[1:]] - sums[found.bounds[:-1]] + np.log10(end + 1) - floor),
                        pa.array(-cost / np.log(10)),
                        pa.array(length),
                        pa.array(cost / np.log(2) / (length + 1)),
                    ],
                    names=[f.split()[0] for f in _SCORED.split(", ")],
                )
            )
    return pa.Table.from_batches(parts)


def score_documents(documents: DataFrame) -> DataFrame:
    """Score each row of (doc_id, text, held_out), learning from the rows that are not held out.

    Tokens are runs without ASCII white space, A-Z lower-cased, and one end per text. Returns doc_id,
    held_out, n_tokens, n_known (tokens that training has), train_tokens (N), base_score (sum of
    log10((count + 1) / (N + V + 1)), V the distinct training tokens), score (log10 probability of the
    text by the mixing model), n_bytes and bits_per_byte (end byte included). A null text counts as
    empty: one token, the end. A null held_out is false. Repeated rows are each learnt and scored, rows
    with a null doc_id too; other columns are ignored. Without training rows N = V = 0 and all bits
    are even.
    """
    source = documents.selectExpr(
        "cast(doc_id as long) as doc_id", "coalesce(cast(text as string), '') as text", "coalesce(held_out, false) as held_out"
    )
    gathered = stage(source.mapInArrow(_gather_rows, _ROWS))
    slots = gathered.where(f"kind = {_SLOT}").groupBy("key").agg({"count": "sum"}).toArrow()
    tables = _build_tables(slots["key"].to_numpy(), slots["sum(count)"].to_numpy())
    shared = documents.sparkSession.sparkContext.broadcast(tables)

    chunks = gathered.where(f"kind = {_DOCUMENT}").select("chunk", "texts")
    sums = chunks.mapInArrow(partial(_weight_sums, tables=shared), "cell long, total double")
    start = _start_weights(dict(sums.groupBy("cell").agg({"total": "sum"}).collect()))

    by_chunk = gathered.where(f"kind = {_WORD}").select("chunk", "key", "count")
    counts = by_chunk.where("count > 0").groupBy("key").agg({"count": "sum"}).withColumnRenamed("sum(count)", "count")
    counts = stage(counts)
    total, distinct = counts.selectExpr("coalesce(sum(count), 0L)", "count(*)").first()
    # A chunk counts its own words again; it is told the words that others have as well.
    known = by_chunk.withColumnRenamed("count", "own").join(counts, "key").where("count > own")
    known = known.selectExpr("chunk as of_chunk", "key", "count").groupBy("of_chunk")
    scored = partial(_score_chunk, tables=shared, start=start, total=total, distinct=distinct)
    by_texts = chunks.groupBy("chunk").cogroup(known)
    return by_texts.applyInArrow(lambda documents, told: scored(documents, told), _SCORED)
