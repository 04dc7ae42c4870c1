"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame

from liengrid.sources.tables import discard, stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u goes to the least of u and its neighbours."""
    both = edges.union(edges.selectExpr("v as u", "u as v"))
    least = both.groupBy("u").agg({"v": "min"}).selectExpr("u", "least(u, `min(v)`) as m")
    return both.where("v > u").join(least, "u").selectExpr("v as u", "m as v").where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours go to the least of them; edges run from larger to smaller."""
    least = edges.groupBy("u").agg({"v": "min"}).selectExpr("u", "`min(v)` as m")
    neighbours = edges.join(least, "u").selectExpr("v as u", "m as v").where("u <> v")
    return neighbours.union(least.selectExpr("u", "m as v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and component (the least id reachable) of every id in the edges (a, b).

    Each round writes its edges to the shared folder, so a lost executor repeats one
    round. Nothing but the number of edges and a checksum comes to the driver. Loops
    (a = b) say nothing and are dropped; edges with a null end are dropped as well.
    """
    apart = edges.where("a is not null and b is not null and a <> b")
    current = stage(apart.selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct())
    before = None
    while True:
        state = current.selectExpr("count(*)", "bit_xor(xxhash64(u, v))").first()
        if state == before or state[0] == 0:
            break
        before, old = state, current
        current = stage(_small_star(_large_star(current)))
        discard(old)
    return current.selectExpr("u as id", "v as component").union(current.selectExpr("v", "v").distinct())
