"""Groups of near items, from block keys that every near pair is known to share.

A block of n items would give n * n / 2 pairs. Instead, each item is first checked against
the least item of its blocks, which joins groups of copies in linear time. Then, for some rounds,
each block draws another of its items, and each item is checked against the nearest item, by
signature, that its blocks have drawn from other groups; this too is linear. Only blocks that
still hold items of several groups are looked at in pairs, and of these only pairs between
groups whose signatures are near enough: all other pairs are connected already or can't be
near. So no link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liengrid.llm.components import components
from liengrid.sources.tables import discard, stage


def _open_rows(live: DataFrame, links: DataFrame) -> DataFrame:
    """key, id and part of the blocks that hold items of several parts."""
    grouped = live.join(components(links), "id", "left").selectExpr("key", "id", "coalesce(component, id) as part")
    # Dealt by key once, for the parts of a key and for its rows.
    grouped = grouped.repartition("key")
    parts = grouped.groupBy("key").agg(
        F.min("part").alias("least"), F.max("part").alias("greatest"), F.min("id").alias("one"), F.max("id").alias("other")
    )
    # Several parts have several ids: with both columns the two sides read one shuffle.
    return stage(grouped.join(parts.where("least <> greatest and one <> other").select("key"), "key"))


def linked_groups(
    keys: DataFrame,
    features: DataFrame,
    near: str,
    closeness: str,
    confirm: Callable[[DataFrame], DataFrame],
    given: DataFrame | None = None,
    rounds: int = 3,
    once: str = "true",
) -> DataFrame:
    """id and component of the items that have a link; the least id names a component.

    keys: (key, id) rows. features: (id, ...) with what near needs, a condition between
    items x and y that holds for every linked pair, and closeness, greater for nearer ones.
    confirm keeps the linked ones of pairs (a, b) that are near. given has links (a, b) known beforehand.
    once, a condition on x.key and the features of x and y, is to hold for just one of the keys that two near
    items share, so that their pair is made once.
    """
    keys = keys.repartition("key")
    shared = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("items")).where("items > 1")
    live = stage(keys.join(shared.select("key", "hub"), "key").select("key", "id", "hub"))
    x, y = features.alias("x"), features.alias("y")
    to_hub = live.where("id <> hub").groupBy("id").agg(F.min("hub").alias("a")).selectExpr("a", "id as b")
    to_hub = to_hub.join(x, F.expr("a = x.id")).join(y, F.expr("b = y.id")).where(near).select("a", "b")
    links = confirm(to_hub)
    links = stage(links if given is None else links.unionByName(given))
    open_rows = _open_rows(live.drop("hub"), links)
    for turn in range(rounds):
        if open_rows.isEmpty():
            break
        drawn = open_rows.groupBy("key").agg(
            F.expr(f"min_by(struct(id, part), struct(xxhash64({turn}, key, id), id))").alias("drawn")
        )
        met = open_rows.join(drawn, "key").where("part <> drawn.part")
        met = met.selectExpr("id as met_id", "drawn.id as met_hub").distinct()
        met = met.join(x, F.expr("met_id = x.id")).join(y, F.expr("met_hub = y.id")).where(near)
        best = met.groupBy("met_id").agg(F.expr(f"max_by(met_hub, struct({closeness}, -met_hub))").alias("hub"))
        found = confirm(best.selectExpr("least(met_id, hub) as a", "greatest(met_id, hub) as b").distinct())
        old_links, old_rows = links, open_rows
        links = stage(links.unionByName(found))
        open_rows = _open_rows(live.drop("hub"), links)
        discard(old_links, old_rows)

    discard(live)
    # Most items are parts of their own: a null takes no place.
    rows = stage(open_rows.withColumn("part", F.expr("nullif(part, id)")).join(features, "id"))
    discard(open_rows)
    apart = "coalesce(x.part, x.id) < coalesce(y.part, y.id)"
    pairs = rows.alias("x").join(rows.alias("y"), F.expr(f"x.key = y.key and {apart} and ({near}) and ({once})"))
    # Written before they are confirmed, so that the rows and their shuffle files, many times as large, can go.
    pairs = stage(pairs.selectExpr("least(x.id, y.id) as a", "greatest(x.id, y.id) as b").distinct())
    discard(rows)
    last = stage(confirm(pairs))
    discard(pairs)
    return components(links.unionByName(last))
