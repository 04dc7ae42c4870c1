"""Packing of documents into sequences by a configuration linear program.

Each task encodes its documents, cuts those longer than a sequence and keeps of each piece where it
lies, its length and a checksum; texts and ids go no further. The counts of lengths, at most one number
per length, are all the driver sees. It solves the program whose variables are configurations
(multisets of lengths that fit a sequence) and whose rows say that each length is covered: rows have
multiplicative weights that rise while they lag, and a knapsack over the capacity prices the configurations.
The solution is rounded down, then configurations that still fit what is left are taken once each; after a
second program for the rest the few pieces left over are best-fit. Pieces find their places by (length, ordinal): ordinals are counts
per task put end to end, so no length has to be gathered anywhere.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from liengrid.sources.tables import stage

CAPACITY = 2048
END_ID = 0
# Pricings a program, programs solved one after the other, and the share of all pieces after which prices are levelled.
PRICINGS, PROGRAMS, LEVELS = 250, 2, 10
# Configurations made from one pricing, each around one of the lengths that lag most.
CONFIGURATIONS_A_PRICING = 200
# How fast the weight of a length rises with its lag; what may lag when a level is closed, as a share of the level.
RISE, SLACK = 0.3, 0.15

# How byte-level BPE splits a text, and its special token, which is matched inside texts.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = {"<|endoftext|>": 50256}

Configuration = tuple[tuple[int, int], ...]


def load_ranks(ranks_file: str) -> dict[bytes, int]:
    with open(ranks_file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _encoder(ranks):
    import tiktoken

    return tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=ranks.value, special_tokens=SPECIAL)


def cut(count: int, capacity: int) -> list[tuple[int, int]]:
    """start and length of the pieces of a document: only the first may be shorter than the capacity."""
    first = count if count <= capacity else count % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, count, capacity)]


def _piece_rows(batches: Iterator[pa.RecordBatch], ranks, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Pieces; place is the number of pieces of the same length that the task made before."""
    encoder, part = _encoder(ranks), TaskContext.get().partitionId()
    made = [0] * (capacity + 1)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = encoder.encode_to_numpy(text.as_py() or "", allowed_special="all", disallowed_special=())
            ids = np.append(ids, end_id).astype("<u4")
            for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                rows.append((doc_id, piece, start, length, crc32(ids[start : start + length].tobytes()), part, made[length]))
                made[length] += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)


_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]
    + [("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64())]
)
_PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def price(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: the best value within each capacity, and the length taken last (0: one token left free).

    values[l] is the value of a piece of length l, -inf where there is none; values[0] is not used.
    """
    best, last = np.zeros(len(values)), np.zeros(len(values), np.int64)
    for c in range(1, len(values)):
        with_last = values[1 : c + 1] + best[c - 1 :: -1]
        at = int(with_last.argmax())
        if with_last[at] > best[c - 1]:
            best[c], last[c] = with_last[at], at + 1
        else:
            best[c] = best[c - 1]
    return best, last


def _configuration(last: np.ndarray, capacity: int, around: int) -> Configuration:
    """The best configuration that has a piece of length `around`."""
    counts = defaultdict(int, {around: 1})
    left = capacity - around
    while left > 0:
        length = int(last[left])
        counts[length] += 1
        left -= length or 1
    counts.pop(0, None)
    return tuple(sorted(counts.items(), reverse=True))


def solve(histogram: dict[int, int], capacity: int) -> dict[Configuration, float]:
    """How often each configuration is used in a fractional solution for the histogram.

    Row l asks that configurations hold histogram[l] pieces of length l. All rows are covered at the same pace, level
    by level. The weight of a row is the size of its length, times a power of e that grows with its lag behind the level;
    rows that have reached it wait. So short pieces last as long as the long ones that need them.
    """
    sizes, covered = np.zeros(capacity + 1), np.zeros(capacity + 1)
    for length, count in histogram.items():
        sizes[length] = count
    lengths, used, pricings = np.arange(capacity + 1), defaultdict(float), 0
    for level in range(1, LEVELS + 1):
        while pricings < PRICINGS:
            share = np.divide(covered, sizes, out=np.ones(capacity + 1), where=sizes > 0)
            lag = np.maximum(level / LEVELS - share, 0)
            open_lengths = np.flatnonzero(lag > 1e-9)
            if (lag * sizes * lengths).sum() <= SLACK / LEVELS * (sizes * lengths).sum():
                break
            pricings += 1
            values = np.full(capacity + 1, -np.inf)
            values[open_lengths] = lengths[open_lengths] * np.exp(RISE * lag[open_lengths])
            last, moved = price(values)[1], False
            for around in open_lengths[np.lexsort((-open_lengths, -lag[open_lengths]))][:CONFIGURATIONS_A_PRICING].tolist():
                made = _configuration(last, capacity, around)
                step = min((level / LEVELS * sizes[n] - covered[n]) / k for n, k in made)
                if step > 1e-9:
                    used[made] += step
                    moved = True
                    for n, k in made:
                        covered[n] += step * k
            if not moved:
                break
    return dict(used)


def round_down(used: dict[Configuration, float], left: dict[int, int], capacity: int) -> dict[Configuration, int]:
    """Whole numbers of configurations, no length more often than it is there; takes them out of left.

    First each rounded down, then one more of each that still fits what is left, the most used first, if
    its room is too small for all pieces left.
    """
    taken: dict[Configuration, int] = defaultdict(int)

    def take(made: Configuration, times: int) -> None:
        times = min(times, *(left[n] // k for n, k in made))
        if times > 0:
            taken[made] += times
            for n, k in made:
                left[n] -= times * k

    for made, times in used.items():
        take(made, int(times + 1e-6))
    for made in sorted(used, key=lambda m: (int(used[m]) - used[m], m)):
        room = capacity - sum(n * k for n, k in made)
        if not any(count and n <= room for n, count in left.items()):
            take(made, 1)
    return dict(taken)


def best_fit(left: dict[int, int], capacity: int) -> dict[Configuration, int]:
    """The pieces left over, longest first, each into the fullest sequence that has room; like ones together."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[Configuration, int]]] = defaultdict(list)

    def add(room: int, made: Configuration, times: int) -> None:
        if room not in groups:
            insort(rooms, room)
        groups[room].append((made, times))

    for length in sorted((n for n, count in left.items() if count), reverse=True):
        count = left[length]
        while count:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if count >= each:
                    add(capacity - each * length, ((length, each),), count // each)
                if count % each:
                    add(capacity - count % each * length, ((length, count % each),), 1)
                break
            room = rooms[at]
            made, times = groups[room].pop()
            fits = room // length
            each = min(fits, count)
            times_used = min(times, count // each)
            if times > times_used:
                groups[room].append((made, times - times_used))
            elif not groups[room]:
                del groups[room]
                rooms.remove(room)
            merged = dict(made)
            merged[length] = merged.get(length, 0) + each
            add(room - each * length, tuple(sorted(merged.items(), reverse=True)), times_used)
            count -= each * times_used
    packed: dict[Configuration, int] = defaultdict(int)
    for group in groups.values():
        for made, times in group:
            packed[made] += times
    return dict(packed)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[Configuration, int]:
    """How many sequences of each configuration hold exactly the pieces of a histogram {length: count}."""
    left = {n: c for n, c in histogram.items() if c and n < capacity}
    packed: dict[Configuration, int] = defaultdict(int)
    if histogram.get(capacity):
        packed[((capacity, 1),)] = histogram[capacity]
    # What rounding leaves is a smaller program of the same kind.
    for _ in range(PROGRAMS):
        for made, times in round_down(solve(left, capacity), left, capacity).items():
            packed[made] += times
        left = {n: c for n, c in left.items() if c}
    for made, times in best_fit(left, capacity).items():
        packed[made] += times
    return dict(packed)


@dataclass
class Places:
    """Where the pieces of each length go: entries bounds[l] to bounds[l + 1] are for length l.

    Entry e serves the ordinals from first[e] on, `each[e]` of them in every sequence from sequence[e] on, at offset[e].
    """

    bounds: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def find(self, length: np.ndarray, ordinal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length).tolist():
            rows, entries = np.flatnonzero(length == n), slice(self.bounds[n], self.bounds[n + 1])
            e = entries.start + np.searchsorted(self.first[entries], ordinal[rows], "right") - 1
            nth = ordinal[rows] - self.first[e]
            sequence[rows] = self.sequence[e] + nth // self.each[e]
            offset[rows] = self.offset[e] + nth % self.each[e] * n
        return sequence, offset


def places(packed: dict[Configuration, int], capacity: int) -> Places:
    entries, first, sequence = [], defaultdict(int), 0
    for made, times in sorted(packed.items()):
        offset = 0
        for length, each in made:
            entries.append((length, first[length], each, sequence, offset))
            first[length] += times * each
            offset += length * each
        sequence += times
    table = np.array(sorted(entries), np.int64).reshape(-1, 5)
    return Places(np.searchsorted(table[:, 0], np.arange(capacity + 2)), *(table[:, c] for c in range(1, 5)))


def _place_rows(batches: Iterator[pa.RecordBatch], found) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    for batch in batches:
        length, ordinal = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "ordinal"))
        columns = [batch.column(c) for c in names] + [pa.array(c) for c in found.value.find(length, ordinal)]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])


def pack(documents: DataFrame, ranks_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each row of (doc_id, text) and their places in sequences of at most `capacity` tokens.

    Columns: doc_id, piece (from 0), start (ids of the document before the piece), length, ids_crc32 (of the
    ids as unsigned little-endian 32-bit numbers), sequence_id (0 and on, without gaps) and offset (tokens of the
    sequence before the piece). A document is its byte-level BPE ids, then end_id; only one longer than the
    capacity is cut, and only its first piece may be shorter. A null or empty text is end_id alone. Repeated rows
    and rows with a null doc_id are documents of their own; other columns are ignored; an empty table gives no rows.

    The driver reads the vocabulary and one count per length, and broadcasts the vocabulary and the configurations in
    use: at most PRICINGS x CONFIGURATIONS_A_PRICING a program, and sequences of what they leave, whatever the table's size.
    """
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_file))
    source = documents.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    task = partial(_piece_rows, ranks=ranks, capacity=capacity, end_id=end_id)
    pieces = stage(source.mapInArrow(task, _PIECES_SQL))
    counts = pieces.groupBy("part", "length").count()
    histogram = {r.length: r.n for r in counts.groupBy("length").agg({"count": "sum"}).toDF("length", "n").collect()}
    found = spark.sparkContext.broadcast(places(plan(histogram, capacity), capacity))
    before = "sum(count) over (partition by length order by part rows between unbounded preceding and 1 preceding)"
    bases = counts.selectExpr("part", "length", f"coalesce({before}, 0) as base")
    numbered = pieces.join(bases, ["part", "length"]).withColumn("ordinal", pieces["place"] + bases["base"])
    return numbered.mapInArrow(
        partial(_place_rows, found=found),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
