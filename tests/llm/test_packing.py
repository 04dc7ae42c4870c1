"""Packing: pieces against the tokenizers library, sequences against their rules and the least possible number."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest

from liengrid.llm import packing, queries

SF_DIR = "/root/testdata/sf0.01"
HARD = [None, "", " ", "<|endoftext|> a <|endoftext|", "x" * 9000, "日本語 é \U0001f600 \x00", "don't I'LL 12345  \n\n\t x  ", "word " * 5000]


def library_pieces(rows, capacity=2048):
    """(doc_id, piece, start, length, crc) of every row, from the library's ids."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    made = []
    for doc_id, text in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity if len(ids) > capacity else len(ids)
        for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
            part = np.array(ids[start : first if piece == 0 else start + capacity], "<u4")
            made.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    return sorted(made, key=repr)


def check_sequences(rows, capacity):
    """Pieces of a sequence lie end to end from 0 and fit; gives the number of sequences."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(held)


def test_given_and_hard_texts(spark):
    rows = [(10_000 + i, t) for i, t in enumerate(HARD)] + [(None, "no id"), (10_000, "again"), (10_000, "again")]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id int, text string, length int").repartition(5)
    made = packing.pack(df, queries.tokenizer_file("byte_bpe_50k.tiktoken")).collect()
    expected = library_pieces(rows)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in made), key=repr) == expected
    least = -(-sum(p[3] for p in expected) // 2048)
    assert check_sequences(made, 2048) <= least + 1


def test_other_capacity_and_end(spark):
    rows = [(i, "one two three four " * (i % 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = packing.pack(df, queries.tokenizer_file("byte_bpe_50k.tiktoken"), capacity=16, end_id=50256).collect()
    assert check_sequences(made, 16) <= -(-sum(r.length for r in made) // 16) + 1
    assert {r.piece for r in made if r.length < 16} == {0}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    made = packing.pack(empty, queries.tokenizer_file("byte_bpe_50k.tiktoken"))
    assert made.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert made.count() == 0


@cache
def fewest(lengths: tuple[int, ...], capacity: int) -> int:
    """The least number of sequences, by trying every set of pieces beside the longest one."""
    if not lengths:
        return 0
    longest, rest = lengths[0], lengths[1:]
    best = len(lengths)
    for chosen in range(1 << len(rest)):
        inside = [n for i, n in enumerate(rest) if chosen >> i & 1]
        if longest + sum(inside) <= capacity:
            outside = tuple(n for i, n in enumerate(rest) if not chosen >> i & 1)
            best = min(best, 1 + fewest(outside, capacity))
    return best


def held(packed):
    counts = Counter()
    for made, times in packed.items():
        for length, each in made:
            counts[length] += each * times
    return dict(counts)


def test_small_programs_are_near_the_optimum():
    rng = random.Random(3)
    over = 0
    for _ in range(40):
        lengths = tuple(sorted((rng.randrange(3, 21) for _ in range(9)), reverse=True))
        packed = packing.plan(dict(Counter(lengths)), 24)
        assert held(packed) == dict(Counter(lengths))
        over += sum(packed.values()) - fewest(lengths, 24)
    assert over <= 4


def test_program_beats_best_fit_where_that_is_bad():
    """Six kinds of pieces that best fit needs 11 sequences for and the program 9, thousandfold."""
    histogram = {1034: 6000, 532: 6000, 522: 6000, 492: 12000}
    packed = packing.plan(histogram, 2048)
    assert held(packed) == histogram
    assert sum(packed.values()) <= 9010
    assert sum(packing.best_fit(dict(histogram), 2048).values()) == 11000


@pytest.mark.parametrize("capacity", [1, 2, 7])
def test_full_and_tiny_pieces(capacity):
    histogram = {capacity: 5} | ({1: 23} if capacity > 1 else {})
    packed = packing.plan(histogram, capacity)
    assert held(packed) == histogram
    assert sum(packed.values()) == 5 + (-(-23 // capacity) if capacity > 1 else 0)


def test_knapsack_against_all_choices():
    rng = random.Random(9)
    for _ in range(20):
        values = np.array([-np.inf] + [rng.choice([-np.inf, rng.random() * n]) for n in range(1, 31)])
        best, last = packing.price(values)
        plain = [0.0]
        for c in range(1, 31):
            plain.append(max([plain[c - 1]] + [plain[c - n] + values[n] for n in range(1, c + 1)]))
        assert np.allclose(best, plain)
        for around in (3, 30):
            made = packing._configuration(last, 30, around)
            assert sum(n * k for n, k in made) <= 30 and dict(made).get(around, 0) >= 1


def test_places_fill_every_configuration():
    packed = {((5, 2), (3, 1)): 3, ((5, 1),): 2, ((3, 4),): 1}
    found = packing.places(packed, 16)
    length = np.array([5] * 8 + [3] * 7)
    ordinal = np.concatenate([np.arange(8), np.arange(7)])
    sequence, offset = found.find(length, ordinal)
    cells = set(zip(sequence.tolist(), offset.tolist()))
    assert len(cells) == 15 and len(set(sequence.tolist())) == 6
