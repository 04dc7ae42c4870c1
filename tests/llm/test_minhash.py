from __future__ import annotations

import numpy as np
import pytest
from brute import near_duplicates as brute
from brute import shingles

from liengrid.llm import minhash, texts

SF_DIR = "/root/testdata/sf0.01"


def run(spark, rows, schema="doc_id long, text string"):
    return minhash.near_duplicates(spark.createDataFrame(rows, schema))


def test_like_brute_force(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    expected = brute(rows)
    assert len({c for _, c in expected.values()}) < len(rows)
    got = {r.doc_id: r for r in minhash.near_duplicates(documents).collect()}
    assert got.keys() == expected.keys()
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == expected
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_chain_of_copies_and_blocks_of_unlinked_documents(spark):
    """A chain whose ends are not similar, and many documents that share half of their words."""
    words = [f"w{i}" for i in range(200)]
    chain = [(i, " ".join(words[6 * i : 6 * i + 60])) for i in range(20)]
    shared = " ".join(f"s{i}" for i in range(40))
    half = [(100 + i, shared + " " + " ".join(f"d{i}x{j}" for j in range(40))) for i in range(400)]
    rows = chain + half
    got = {r.doc_id: r.component_id for r in run(spark, rows).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}
    assert {got[i] for i in range(20)} == {0}


def test_defined_cases(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [
        (1, None, 1),
        (2, "", 1),
        (3, " \n\t ", 1),
        (4, "Only Four words here", 1),
        (5, "only four\twords  here", 1),
        (6, long, 1),
        (7, long + " more", 1),
        (8, "x", 1),
        (9, "é x y z w", 1),
        (9, "é x y z w", 1),
        (None, "é x y z w", 1),
        (10, "a b c d e", 1),
        (11, "f g h i j", 1),
        (11, "a b c d e", 1),
    ]
    got = run(spark, rows, "doc_id long, text string, id int").collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert by_id[1] == (0, 1, True) and by_id[2] == (0, 2, True) and by_id[3] == (0, 3, True)
    assert by_id[5] == (1, 4, False) and by_id[7] == (59_997, 6, False)
    assert by_id[9] == (1, 9, True) and by_id[None] == (1, None, True)
    assert by_id[11] == (1, 10, False)
    assert run(spark, []).count() == 0


def test_shingle_hashes_count_like_sets():
    import pyarrow as pa

    samples = ["a b a b a b a b", "", "A b\x0bc", "é è", "x " * 50, "one two three four five six"]
    for _, _, data, offsets in texts.text_slices(pa.array(samples)):
        _, bounds = texts.shingle_sets(data, offsets, 5)
        assert np.diff(bounds).tolist() == [len(shingles(s)) for s in samples]


def test_every_near_signature_pair_shares_a_key():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, minhash.COORDINATES).astype(np.uint16)
        b = a.copy()
        b[rng.choice(minhash.COORDINATES, minhash.MAX_DIFFERENT, replace=False)] ^= 1
        x, y = minhash._chunk_keys(np.array([a, b]))
        assert set(x) & set(y)


def test_threshold_below_the_signature_is_refused(spark):
    with pytest.raises(ValueError):
        minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), similar_percent=50)


def test_parities_differ_in_no_more_bits_than_sets_in_values():
    rng = np.random.default_rng(7)
    pool = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 700), replace=False)) for _ in range(40)] + [pool[:0]]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    bits = np.unpackbits(minhash.parities(np.concatenate(sets), bounds), axis=1)
    assert not bits[-1].any()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            apart = len(np.setxor1d(a, b))
            flipped = int((bits[i] != bits[j]).sum())
            assert flipped <= apart and (apart - flipped) % 2 == 0
            if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)):
                assert 175 * flipped <= 25 * (len(a) + len(b))
