"""Clustering against the plain method on integers."""

from __future__ import annotations

import math
import random
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from compare import connect, difference

from liengrid.llm import oracle, queries, shallot

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, cluster string, V string"


def plain(rows, clusters, rounds, dimension):
    """vec_id, cluster, distance, both inertias and the digest, by computing every distance."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    centroids = [v for _, v in start]
    if not kept:
        return []

    def assign():
        found = []
        for _, v in kept:
            found.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)))
        return found

    for _ in range(rounds):
        where = [n for _, n in assign()]
        for n in range(len(centroids)):
            own = [v for (_, v), w in zip(kept, where) if w == n]
            if own:
                centroids[n] = [sum(column) // len(own) for column in zip(*own)]
    found = assign()
    per = [sum(d for d, n in found if n == c) for c in range(len(centroids))]
    shas = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, per[n], sum(per), shas[n]) for (i, _), (d, n) in zip(kept, found)), key=repr)


def clustered(spark, rows, clusters, rounds, dimension, chunk=16):
    df = spark.createDataFrame([(i, v, "x", None) for i, v in rows], SCHEMA).repartition(3)
    made = shallot.cluster(df, clusters, rounds, dimension, chunk=chunk)
    assert made.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, made.collect()), key=repr)


def test_equals_the_plain_method_with_ties_nulls_and_repeats(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 5, 0.7) for _ in range(4)]) for i in range(150)]
    rows += [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(200, 260)]
    rows += rows[:20] + [(7, [0.5] * 4), (None, [0.25, -0.25, 0.0, 9.0]), (None, [0.25, -0.25, 0.0, 9.0])]
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0] * 5), (904, [1.0, None, 1.0, 1.0])]
    rows += [(905, [math.nan] * 4), (906, [1.0, math.inf, 1.0, 1.0])]
    assert clustered(spark, rows, 6, 5, 4) == plain(rows, 6, 5, 4)


@pytest.mark.parametrize("count", [0, 1, 3])
def test_fewer_vectors_than_centroids(spark, count):
    rows = [(i, [float(i), 1.0]) for i in range(count)] + [(9, None)]
    assert clustered(spark, rows, 4, 2, 2) == plain(rows, 4, 2, 2)


def test_equal_vectors_leave_centroids_empty(spark):
    rows = [(i, [1.0, 2.0]) for i in range(12)]
    assert clustered(spark, rows, 3, 3, 2) == plain(rows, 3, 3, 2)


def test_only_null_ids(spark):
    assert {r[1] for r in clustered(spark, [(None, [1.0]), (None, [5.0])], 2, 1, 1)} == {0, 1}


def test_component_beyond_a_long_is_an_error(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        clustered(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])], 2, 1, 2)


def test_search_is_exact_and_skips():
    """Over moving centroids the search finds what full comparison finds, with fewer distances."""
    rng = np.random.default_rng(1)
    points = rng.integers(-50, 50, (2000, 3)) + 400 * rng.integers(0, 4, (2000, 1))
    centroids, state, moved, taken = points[:12].copy(), None, None, 0
    for step in range(12):
        apart = ((points[:, None, :] - centroids[None]) ** 2).sum(2)
        near, second, upper, lower, n = shallot.nearest(points, centroids, moved, state)
        assert (near == apart.argmin(1)).all()
        exact = np.sqrt(apart[np.arange(2000), near])
        others = apart.astype(float).copy()
        others[np.arange(2000), near] = np.inf
        assert (upper >= exact).all() and (lower <= np.sqrt(others.min(1))).all()
        taken += n if step else 0
        state = near, second, upper, lower
        after = np.array([points[near == c].sum(0) // max(1, (near == c).sum()) for c in range(12)])
        moved, centroids = shallot._moved(centroids, after), after
    assert taken < 0.35 * 11 * 2000 * 12


def test_rounds_join_without_a_shuffle(spark):
    tables = shallot._Bucketed(spark, 4)
    try:
        points = tables.write(spark.range(40).selectExpr("id as chunk", "array(id) as ids", "binary('') as data").repartition(4, "chunk"))
        state = tables.write(spark.range(40).selectExpr("id as chunk", "binary('') as near", "array(id) as totals"))
        plan = shallot._with_state(points, state)._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Exchange" not in plan
    finally:
        tables.forget()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("liengrid_chunks")]


def test_given_table_against_sql(spark):
    made = queries.queries()["op11_centroid_clusters"](spark, SF_DIR)
    assert difference(made, connect(SF_DIR), oracle.oracle_sql()["op11_centroid_clusters"]) is None


def test_sql_of_an_empty_table(spark):
    database = duckdb.connect()
    database.execute("create table embeddings (vec_id bigint, embedding float[], label integer)")
    assert database.execute(oracle.oracle_sql()["op11_centroid_clusters"]).fetchall() == []
