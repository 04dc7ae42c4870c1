"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are scaled to length one and rotated at random, which spreads what tells them apart over all
dimensions, and are put into lists around centroids. For each probed list the dimensions are
scanned in blocks of columns. After each block a hypothesis test compares the partial distance,
scaled up to all dimensions, with the distance of the k-th best candidate so far: pairs that are
almost surely farther away are abandoned and not scanned further. What is left is measured exactly,
in double precision on the original vectors.

Equal vectors are one candidate with its least ids, so copies cost nothing. Lists of any size are
divided into blocks, and the queries that probe a list into chunks.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from liengrid.sources.tables import stage

K = 5
SAMPLE_ROWS = 20_000
ROWS_PER_LIST = 500
MOST_LISTS = 2_048
PROBED_SHARE = 0.6
LEAST_PROBES = 16
BLOCK_ROWS = 4_096
CHUNK_QUERIES = 1_024
COLUMNS = 16
CONFIDENCE = 2.1
SEEDS = 64

_USABLE = (
    "embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and "
    "abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones continue with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    result = np.zeros((len(column), width))
    result[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return result


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def rotation(width: int) -> np.ndarray:
    """A fixed random rotation."""
    return np.linalg.qr(np.random.default_rng(width).standard_normal((width, width)))[0]


def centroids(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centres of count lists, by k-means on unit vectors."""
    centres = sample[np.random.default_rng(count).permutation(len(sample))[:count]].astype(np.float32)
    sample = sample.astype(np.float32)
    for _ in range(rounds):
        nearest = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(sample, -(-len(sample) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    return centres


def _place(batches, turn, centres, width: int, probes: int):
    """rep, ids, embedding, its unit vector after rotation, and the nearest lists."""
    for batch in batches:
        rotated = _unit(_matrix(batch.column("embedding"), width)) @ turn.value
        likeness = rotated.astype(np.float32) @ centres.value.T
        near = np.argpartition(-likeness, min(probes, likeness.shape[1]) - 1, axis=1)[:, :probes]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(likeness, near, 1), axis=1, kind="stable"), 1)
        to_list = lambda a, kind: pa.ListArray.from_arrays(
            pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.astype(kind).ravel())
        )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("rep"),
                batch.column("ids"),
                batch.column("embedding"),
                to_list(rotated, np.float32),
                to_list(near, np.int32),
            ],
            names=["rep", "ids", "embedding", "rotated", "lists"],
        )


def scan(queries: np.ndarray, candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that survive the adaptive scan of rotated unit vectors; float rounding is allowed for."""
    width = candidates.shape[1]
    seeds = min(SEEDS, len(candidates))
    first = np.maximum(2 - 2 * (queries @ candidates[:seeds].T), 0)
    bar = np.full(len(queries), np.inf, np.float32)
    if seeds >= k:
        bar = np.partition(first, k - 1, axis=1)[:, k - 1] + np.float32(1e-5)
    seed_query, seed_candidate = np.nonzero(first <= bar[:, None])
    rest = candidates[seeds:]
    if not len(rest):
        return seed_query, seed_candidate
    partial_distance = None
    for begin in range(0, width, COLUMNS):
        end = min(begin + COLUMNS, width)
        q, c = queries[:, begin:end], rest[:, begin:end]
        if partial_distance is None:
            block = (q**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * (q @ c.T)
            query, candidate = np.nonzero(_may_be_near(block, bar[:, None], end, width))
            partial_distance = block[query, candidate]
        else:
            partial_distance = partial_distance + ((q[query] - c[candidate]) ** 2).sum(1)
            near = _may_be_near(partial_distance, bar[query], end, width)
            query, candidate, partial_distance = query[near], candidate[near], partial_distance[near]
    return np.append(seed_query, query), np.append(seed_candidate, candidate + seeds)


def _may_be_near(distance: np.ndarray, bar: np.ndarray, scanned: int, width: int) -> np.ndarray:
    """The test: whether a squared distance over the scanned columns allows for one within the bar."""
    slack = 1.0 if scanned == width else (1 + CONFIDENCE / np.sqrt(scanned)) ** 2
    return distance * np.float32(width / scanned) <= bar * np.float32(slack) + np.float32(1e-5)


_FOUND = "query_rep long, vec_ids array<long>, score double"


def _search(key, queries: pa.Table, candidates: pa.Table, k: int, width: int) -> pa.Table:
    if not queries.num_rows or not candidates.num_rows:
        return pa.table({"query_rep": pa.array([], pa.int64()), "vec_ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
    queries = queries.rename_columns([name.removeprefix("query_") for name in queries.column_names])
    rotated = [_matrix(t["rotated"], width).astype(np.float32) for t in (queries, candidates)]
    query, candidate = scan(*rotated, k)
    originals = [_matrix(t["embedding"], width) for t in (queries, candidates)]
    norms = [np.linalg.norm(rows, axis=1) for rows in originals]
    score = np.einsum("ij,ij->i", originals[0][query], originals[1][candidate]) / (norms[0][query] * norms[1][candidate])
    rep = candidates["rep"].to_numpy()
    order = np.lexsort((rep[candidate], -score, query))
    query, candidate, score = query[order], candidate[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    best = place < k
    return pa.table(
        {
            "query_rep": queries["rep"].take(pa.array(query[best])),
            "vec_ids": candidates["ids"].take(pa.array(candidate[best])),
            "score": pa.array(score[best]),
        }
    )


def nearest(
    vectors: DataFrame,
    query_condition: str,
    k: int = K,
    probed_share: float = PROBED_SHARE,
    rows_per_list: int = ROWS_PER_LIST,
) -> DataFrame:
    """The k nearest other rows of vectors (vec_id, embedding) by cosine, for the rows that meet a condition.

    Returns query_id, rank (from 1), vec_id and score, nearest first, ties to the smaller vec_id; all other
    rows if there are fewer. Centroids are fitted on the driver on at most SAMPLE_ROWS vectors, drawn by
    the hash of their id; every vector is indexed. One list holds rows_per_list vectors on average, up to
    MOST_LISTS lists, and probed_share of the lists, at least LEAST_PROBES, are probed. Vectors that are null
    or zero or hold null or non-finite components, and rows with a null vec_id, take no part; shorter vectors
    count as continued with zeros. A vec_id that occurs more than once stands for all its vectors, and has
    the best of their scores. Other columns are ignored.
    """
    spark = vectors.sparkSession
    usable = vectors.selectExpr("cast(vec_id as long) as vec_id", "cast(embedding as array<float>) as embedding")
    usable = usable.where(_USABLE)
    least = Window.partitionBy("embedding").orderBy("vec_id")
    members = usable.distinct().withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1)
    distinct = members.groupBy("embedding").agg(
        F.expr("min(vec_id)").alias("rep"), F.expr("array_sort(collect_list(vec_id))").alias("ids")
    )
    # Two vectors with the same least id (a repeated vec_id) need names of their own.
    distinct = stage(distinct.selectExpr("xxhash64(embedding, rep) as rep", "ids", "embedding"))
    count, width = distinct.selectExpr("count(*)", "coalesce(max(size(embedding)), 0)").first()
    n_lists = max(1, min(count // rows_per_list, MOST_LISTS))
    probes = min(n_lists, max(LEAST_PROBES, int(np.ceil(n_lists * probed_share))))
    sample = distinct.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("embedding").toArrow()
    turn = rotation(max(width, 1))
    if count:
        centres = centroids(_unit(_matrix(sample["embedding"], width)) @ turn, n_lists)
    else:
        centres = np.zeros((1, max(width, 1)), np.float32)
    shared = spark.sparkContext.broadcast
    place = partial(_place, turn=shared(turn), centres=shared(centres), width=max(width, 1), probes=probes)
    index = stage(
        distinct.mapInArrow(
            place, "rep long, ids array<long>, embedding array<float>, rotated array<float>, lists array<int>"
        )
    )
    queries = usable.where(query_condition).select(F.col("vec_id").alias("query_id"), "embedding")
    queries = stage(queries.join(distinct.select("rep", "embedding"), "embedding").select("query_id", "rep"))
    probing = index.join(queries.select("rep").distinct(), "rep", "left_semi")

    sizes = index.groupBy(F.expr("lists[0]").alias("list")).count().selectExpr(
        "list", f"cast(ceil(count / {BLOCK_ROWS}) as int) as blocks"
    )
    wanted = probing.selectExpr("explode(lists) as list").groupBy("list").count().selectExpr(
        "list", f"cast(ceil(count / {CHUNK_QUERIES}) as int) as chunks"
    )
    # One row per list, at most MOST_LISTS.
    plan = stage(sizes.join(wanted, "list"))
    candidates = index.withColumn("list", F.expr("lists[0]")).join(plan, "list")
    candidates = candidates.selectExpr(
        "list", "pmod(xxhash64(rep), blocks) as block", "explode(sequence(0, chunks - 1)) as chunk", "rep", "ids", "embedding", "rotated"
    )
    asked = probing.selectExpr("explode(lists) as list", "rep", "embedding", "rotated").join(plan, "list")
    asked = asked.selectExpr(
        "list", "explode(sequence(0, blocks - 1)) as block", "pmod(xxhash64(rep), chunks) as chunk",
        "rep as query_rep", "embedding as query_embedding", "rotated as query_rotated",
    )
    key = ["list", "block", "chunk"]
    as_key = {"block": "cast(block as int)", "chunk": "cast(chunk as int)"}
    candidates, asked = (df.withColumns({c: F.expr(e) for c, e in as_key.items()}) for df in (candidates, asked))
    search = partial(_search, k=k + 1, width=max(width, 1))
    found = asked.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(
        lambda key, left, right: search(key, left, right), _FOUND
    )
    best = Window.partitionBy("query_rep").orderBy(F.desc("score"), "vec_id")
    found = found.selectExpr("query_rep", "explode(vec_ids) as vec_id", "score").withColumn("rank", F.row_number().over(best))
    found = found.where(F.col("rank") <= k + 1).drop("rank")
    answers = queries.join(found, queries.rep == found.query_rep).where("query_id <> vec_id")
    each = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (
        answers.withColumn("rank", F.row_number().over(each))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
