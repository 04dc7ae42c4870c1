"""The trie of conversations against plain sequences."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from compare import connect, difference

from liengrid.llm import oracle, prefix_trie, queries

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, n_convs string, D1 int"


def plain(rows):
    """All nodes as tuples in the order of the operator's columns."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        sequence = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        ends[sequence].append(c)
        for d in range(len(sequence) + 1):
            members[sequence[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        own_saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += own_saved
    made = []
    for node, convs in members.items():
        sha = sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        made.append((min(convs), len(node), parent, len(convs), children[node], leaves[node], saved[node], sha))
    return sorted(made, key=repr)


def built(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    made = prefix_trie.prefix_trie(df)
    assert made.columns == prefix_trie._NODE
    return sorted(map(tuple, made.collect()), key=repr)


def drawn(seed, convs, most, words):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(convs * 2), convs):
        for turn in range(rng.randrange(1, most)):
            rows.append((c, turn, rng.choice(["user", "user", None]), rng.choice(words)))
    return rows


def test_drawn_conversations_with_nulls_ties_and_repeats(spark):
    rows = drawn(1, 120, 12, ["", None, "a", "a", "é" * 3])
    rows += [(900, None, "user", "first"), (900, 3, "user", "a"), (900, 3, "user", "a"), (None, 0, "user", "no id"), (None, None, None, None)]
    assert built(spark, rows) == plain(rows)


def test_copies_long_conversations_and_hot_first_turns(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    long = [("user", f"t{i % 9}") for i in range(300)]
    rows = [(c, t, *long[t]) for c in range(0, 60) for t in range(120 if c in (0, 30, 41) else 10)]
    rows += [(c, t, "user", "hello" if t == 0 else f"own {c} {t}") for c in range(100, 160) for t in range(4)]
    assert built(spark, rows, 6) == plain(rows)


def test_one_conversation_over_many_partitions(spark):
    rows = [(5, t, "user", f"t{t % 50}") for t in range(240)] + [(6, 0, "user", "x"), (4, 0, "user", "y")]
    rows += [(10, 7, "user", "same")] * 150
    assert built(spark, rows, 8) == plain(rows)


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    rows = drawn(2, 150, 9, ["a", "b", "c d"])
    expected = plain(rows)
    monkeypatch.setattr(prefix_trie, "LEAST_CELLS", 64)
    monkeypatch.setattr(prefix_trie, "MOST_CELLS", 64)
    assert built(spark, rows) == expected


def test_only_prefixes_that_may_be_shared_are_kept_by_the_sketch(spark):
    rows = [(c, t, "user", "hi" if t == 0 else f"{c} {t}") for c in range(0, 3000, 5) for t in range(10)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    _, paths = prefix_trie.rebuilt_paths(prefix_trie.numbered_turns(df))
    sketch, width = prefix_trie.sketch_of(paths)
    digests = paths.select("d1", "d2").toPandas()
    estimate = np.full(len(digests), 9, np.uint8)
    for cells in prefix_trie._cells(*(digests[c].to_numpy().view(np.uint64) for c in ("d1", "d2")), width):
        estimate = np.minimum(estimate, sketch[cells])
    counts = digests.value_counts().loc[list(zip(digests.d1, digests.d2))].to_numpy()
    assert (estimate >= np.minimum(counts, 2)).all()
    assert ((estimate > 1) & (counts == 1)).mean() < 0.02


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")], [(1, 0, "user", "x")], [(7, None, None, None)]])
def test_hardly_any_rows(spark, rows):
    assert built(spark, rows, 1) == plain(rows)


def test_given_table_against_sql_and_plain(spark):
    made = queries.queries()["op13_prefix_trie"](spark, SF_DIR).cache()
    rows = spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(tuple, made.select(*prefix_trie._NODE).collect()), key=repr) == plain(map(tuple, rows))
    assert difference(made, connect(SF_DIR), oracle.oracle_sql()["op13_prefix_trie"]) is None
