"""Exact centroid clustering on integers with Shallot search.

Vectors become integers and are kept in chunks, one row per chunk, in a table bucketed by chunk. What
a chunk remembers of its vectors between rounds - nearest and second-nearest centroid, a bound from
above on the distance to the first, one from below on the distance to all others - is a small table
bucketed alike, so each round joins the two without a shuffle and writes only the small one. A vector
whose bounds still separate keeps its centroid unseen. For any other the scan starts from the closer
of its two remembered centroids, goes through that one's neighbours in order of distance and ends
where the ball that can hold a better second-nearest ends; the ball shrinks with every find. Bounds are
floating-point numbers rounded away from the decision, survivors are compared as integers, so the result
is that of the plain method. Only sums per centroid and component come to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liengrid.sources.tables import stage, staging_folder

CLUSTERS, ROUNDS, DIMENSION, SCALE, SALT = 8, 10, 64, 1024, 3
CHUNK = 1024
# Components below this have squared distances that fit a long at up to 64 components.
MOST_COMPONENT = 1 << 27
# More than the rounding error of a square root and a few sums, relative to the value.
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12

_POINTS = "chunk long, ids array<long>, data binary"
_STATE = "chunk long, near binary, second binary, upper binary, lower binary, totals array<long>"


def nearest(
    points: np.ndarray, centroids: np.ndarray, moved: np.ndarray | None, state: tuple | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest and second-nearest centroid, bound above and below, of integer points; how many distances that took.

    state holds the same four for the centroids before they moved by the distances moved, or is None.
    Equal distances go to the smaller number. With one centroid there is no second: it is -1.
    """
    count, k = len(points), len(centroids)
    taken = 0

    def distance(rows: np.ndarray, to: np.ndarray | int) -> np.ndarray:
        nonlocal taken
        taken += len(rows)
        apart = points[rows] - centroids[to]
        return np.einsum("ij,ij->i", apart, apart)

    if k == 1:
        zero = np.zeros(count, np.int64)
        return zero, zero - 1, np.full(count, np.inf), np.full(count, np.inf), 0
    between = np.sqrt(((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2).astype(float)) * _DOWN
    order = [[int(j) for j in np.argsort(between[c], kind="stable") if j != c] for c in range(k)]
    if state is None:
        near, second = np.zeros(count, np.int64), np.ones(count, np.int64)
        upper, lower = np.full(count, np.inf), np.zeros(count)
        open_rows = np.arange(count)
    else:
        near, second, upper, lower = (s.copy() for s in state)
        most_of_others = np.array([np.delete(moved, c).max() for c in range(k)])
        upper = (upper + moved[near]) * _UP
        lower = lower - most_of_others[near]
        lower -= np.abs(lower) * 1e-12
        safe = np.maximum(lower, np.array([between[c, order[c][0]] / 2 for c in range(k)])[near])
        open_rows = np.flatnonzero(~(upper < safe))
        exact = distance(open_rows, near[open_rows])
        upper[open_rows] = np.sqrt(exact.astype(float)) * _UP
        open_rows = open_rows[~(upper[open_rows] < safe[open_rows])]
    if not len(open_rows):
        return near, second, upper, lower, taken
    first, other = near[open_rows], second[open_rows]
    best, next_best = distance(open_rows, first), distance(open_rows, other)
    swap = (next_best < best) | ((next_best == best) & (other < first))
    first, other = np.where(swap, other, first), np.where(swap, first, other)
    best, next_best = np.where(swap, next_best, best), np.where(swap, best, next_best)
    start, known, base = first.copy(), other.copy(), np.sqrt(best.astype(float)) * _UP
    for c in range(k):
        within = np.flatnonzero(start == c)
        for j in order[c]:
            within = within[between[c, j] <= base[within] + np.sqrt(next_best[within].astype(float)) * _UP]
            if not len(within):
                break
            new = within[known[within] != j]
            d = distance(open_rows[new], j)
            closest = (d < best[new]) | ((d == best[new]) & (j < first[new]))
            nearer = ~closest & ((d < next_best[new]) | ((d == next_best[new]) & (j < other[new])))
            win = new[closest]
            other[win], next_best[win] = first[win], best[win]
            first[win], best[win] = j, d[closest]
            runner_up = new[nearer]
            other[runner_up], next_best[runner_up] = j, d[nearer]
    near[open_rows], second[open_rows] = first, other
    upper[open_rows] = np.sqrt(best.astype(float)) * _UP
    lower[open_rows] = np.sqrt(next_best.astype(float)) * _DOWN
    return near, second, upper, lower, taken


def _to_integers(values: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(values * float(scale))
    if len(scaled) and not (np.abs(scaled) < MOST_COMPONENT).all():
        raise ValueError(f"a component times {scale} is not below {MOST_COMPONENT}: its squared distances do not fit a long")
    return scaled.astype(np.int64)


def _pack(batches: Iterator[pa.RecordBatch], dimension: int, scale: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Chunks of up to `chunk` vectors, each one row."""
    made = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at in range(0, batch.num_rows, chunk):
            part = batch.slice(at, chunk)
            values = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dimension)
            data = _to_integers(values, scale).astype("<i4").tobytes()
            ids = pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([made], pa.int64()), ids, pa.array([data], pa.binary())], names=["chunk", "ids", "data"]
            )
            made += 1


def _chunks(batches: Iterator[pa.RecordBatch], dimension: int, remembered: bool) -> Iterator[tuple]:
    """chunk, ids, integer vectors and what is remembered of them, of each row."""
    for batch in batches:
        for row in range(batch.num_rows):
            cell = {name: batch.column(name)[row] for name in batch.schema.names}
            points = np.frombuffer(cell["data"].as_py(), "<i4").reshape(-1, dimension).astype(np.int64)
            state = None
            if remembered:
                state = tuple(np.frombuffer(cell[c].as_py(), np.int8).astype(np.int64) for c in ("near", "second"))
                state += tuple(np.frombuffer(cell[c].as_py(), float) for c in ("upper", "lower"))
            yield cell["chunk"], cell["ids"], points, state


def _round(batches: Iterator[pa.RecordBatch], centroids, moved, remembered: bool) -> Iterator[pa.RecordBatch]:
    """The state of each chunk for these centroids, and its sums: per centroid the count, then each component."""
    k, dimension = centroids.shape
    for chunk, _, points, state in _chunks(batches, dimension, remembered):
        near, second, upper, lower, _ = nearest(points, centroids, moved, state)
        totals = np.zeros((k, 1 + dimension), np.int64)
        totals[:, 0] = np.bincount(near, minlength=k)
        for c in np.flatnonzero(totals[:, 0]):
            totals[c, 1:] = points[near == c].sum(0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([chunk.as_py()], pa.int64()),
                *[pa.array([a.astype(np.int8).tobytes()], pa.binary()) for a in (near, second)],
                *[pa.array([a.tobytes()], pa.binary()) for a in (upper, lower)],
                pa.array([totals.ravel().tolist()], pa.list_(pa.int64())),
            ],
            names=["chunk", "near", "second", "upper", "lower", "totals"],
        )


def _assigned(batches: Iterator[pa.RecordBatch], centroids, moved, remembered: bool) -> Iterator[pa.RecordBatch]:
    """vec_id, cluster and squared distance of every vector."""
    for _, ids, points, state in _chunks(batches, centroids.shape[1], remembered):
        near = nearest(points, centroids, moved, state)[0]
        apart = points - centroids[near]
        distance = np.einsum("ij,ij->i", apart, apart)
        yield pa.RecordBatch.from_arrays(
            [ids.values, pa.array(near.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"]
        )


class _Bucketed:
    """Tables in the shared folder, bucketed by chunk, known to the catalog while the clustering runs."""

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets, self.names = spark, buckets, []

    def write(self, df: DataFrame) -> DataFrame:
        name = f"liengrid_chunks_{uuid.uuid4().hex}"
        path = f"{staging_folder(self.spark)}/{name}"
        self.names.append(name)
        df.write.bucketBy(self.buckets, "chunk").format("parquet").option("path", path).saveAsTable(name)
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
        return self.spark.table(name)

    def forget(self) -> None:
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")


def _with_state(points: DataFrame, state: DataFrame | None) -> DataFrame:
    """Chunks with what is remembered of them: a hash join of equal buckets, the small side built."""
    if state is None:
        return points
    return points.join(state.drop("totals").hint("shuffle_hash"), "chunk")


def _moved(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return np.sqrt(((after - before) ** 2).sum(1).astype(float)) * _UP


def usable(vectors: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """vec_id and components (v, doubles) of the vectors that take part: of this size, all components finite."""
    every = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    rows = vectors.selectExpr("cast(vec_id as long) as vec_id", "cast(embedding as array<double>) as v")
    return rows.where(f"coalesce(size(v) = {dimension} and {every}, false)")


def cluster(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimension: int = DIMENSION,
    scale: int = SCALE,
    salt: int = SALT,
    chunk: int = CHUNK,
) -> DataFrame:
    """Cluster the rows of (vec_id, embedding): one row per vector that takes part.

    Columns: vec_id, cluster, distance (squared, to the final centroid), cluster_inertia and inertia
    (its sums over the cluster and over all; null if beyond a long) and centroid_sha256. Vectors of
    another size, null, or with a null or non-finite component take no part; other columns are ignored.
    Repeated rows and repeated ids are vectors of their own. The first centroids are the `clusters`
    vectors with the least sha256 of `salt:vec_id`, equal ones in order of their components; a vector
    with a null id is clustered but starts none. With fewer vectors there are fewer centroids, with
    none (an empty table) there are no rows; if only null ids are left, the least vectors start.
    A component that is not below 2^27 in integers is an error, as its distances don't fit a long.
    At most 127 clusters; the state has a byte for each.
    """
    if not 1 <= clusters <= 127:
        raise ValueError("clusters must be from 1 to 127")
    spark = vectors.sparkSession
    kept = usable(vectors, dimension)
    first = kept.orderBy(F.expr(f"sha2(concat('{salt}:', vec_id), 256)").asc_nulls_last(), "v").limit(clusters).collect()
    if any(r.vec_id is not None for r in first):
        first = [r for r in first if r.vec_id is not None]
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.stack([_to_integers(np.array(r.v), scale) for r in first])
    tables = _Bucketed(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        packed = kept.mapInArrow(partial(_pack, dimension=dimension, scale=scale, chunk=chunk), _POINTS)
        points, state, moved = tables.write(packed.repartition(tables.buckets, "chunk")), None, None
        for _ in range(rounds):
            task = partial(_round, centroids=centroids, moved=moved, remembered=state is not None)
            state = tables.write(_with_state(points, state).mapInArrow(task, _STATE))
            sums = state.selectExpr("posexplode(totals) as (place, total)").groupBy("place")
            rows = sums.agg(F.expr("sum(cast(total as decimal(38,0)))").alias("total")).collect()
            totals = [[0] * (1 + dimension) for _ in centroids]
            for r in rows:
                totals[r.place // (1 + dimension)][r.place % (1 + dimension)] = int(r.total)
            after = [[s // t[0] for s in t[1:]] if t[0] else c.tolist() for t, c in zip(totals, centroids)]
            before, centroids = centroids, np.array(after, np.int64)
            moved = _moved(before, centroids)
        task = partial(_assigned, centroids=centroids, moved=moved, remembered=state is not None)
        made = stage(_with_state(points, state).mapInArrow(task, "vec_id long, cluster int, distance long"))
    finally:
        tables.forget()
    return _with_inertia(made, centroids)


def _with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The sums of distances and the digests of centroids, a row per cluster, put beside each vector."""
    sums = assigned.groupBy("cluster").agg(F.expr("sum(cast(distance as decimal(38,0)))").alias("total")).collect()
    inertia = {r.cluster: int(r.total) for r in sums}
    total = sum(inertia.values())
    rows = [
        (c, *[v if v < 1 << 63 else None for v in (inertia.get(c, 0), total)], sha256(",".join(map(str, x)).encode()).hexdigest())
        for c, x in enumerate(centroids.tolist())
    ]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    per_cluster = assigned.sparkSession.createDataFrame(rows, schema)
    joined = assigned.join(F.broadcast(per_cluster), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
