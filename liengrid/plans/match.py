"""Results and advertised lists matched to parcels, one row per business key.

Joining first and keeping the first row afterwards, as one would on a small table,
builds every pair of a frequent key. Both sides are cut to the rows that can win
before they meet, which gives the same rows from a join that is at most one to one
on the parcel side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from liengrid.functions.geometry import centroid
from liengrid.operators.keep_first import keep_first, locale_order, nulls_last
from liengrid.operators.matching import KEY, left_match, left_match_first, with_key

PROPERTY_KEYS = ["block", "lot", "ward", "section"]
LATEST_KEYS = ["block", "lot", "ward"]
PARCEL_ORDER = ["objectid"]


def with_centroid(parcels: DataFrame, geometry: str = "geometry") -> DataFrame:
    """G1: replaces the polygon column by x and y, before any shuffle moves the polygons."""
    if geometry not in parcels.columns:
        return parcels
    shape = geometry
    if not parcels.schema[geometry].dataType.simpleString().startswith("array<array<array<"):
        shape = f"if({geometry} is null, null, array({geometry}))"
    located = parcels.selectExpr(f"* except ({geometry})", f"{centroid(shape)} as _point")
    return located.selectExpr("* except (_point)", "_point.x as x", "_point.y as y")


def match_history(
    results: DataFrame, parcels: DataFrame, order: Sequence[str], parcel_order: Sequence[str] = PARCEL_ORDER
) -> DataFrame:
    """First row per (pin, auction_year) with the first parcel of its pin."""
    facts = keep_first(
        with_key(results.drop("block", "lot"), ["pin"]), [KEY, "auction_year"], _ordered(order, ["pin"])
    )
    return left_match_first(facts, _first_parcel(parcels, ["pin"], parcel_order))


def match_latest(
    results: DataFrame, parcels: DataFrame, order: Sequence[str], parcel_order: Sequence[str] = PARCEL_ORDER
) -> DataFrame:
    """First row per adv_number, where a row with a known csa comes first.

    Many results may share one property key, so both sides are shuffled for the join and
    Spark can split a frequent key over several tasks.
    """
    by_csa = locale_order("csa")
    best_parcel = keep_first(
        with_centroid(parcels.drop("section")), LATEST_KEYS, [by_csa, *_ordered(parcel_order)]
    )
    facts = keep_first(results, ["adv_number", *LATEST_KEYS], _ordered(order))
    matched = left_match(facts, best_parcel, LATEST_KEYS)
    return keep_first(matched, ["adv_number"], [by_csa, *_ordered([*order, *LATEST_KEYS])])


def match_advertised(
    advertised: DataFrame, parcels: DataFrame, order: Sequence[str], parcel_order: Sequence[str] = PARCEL_ORDER
) -> DataFrame:
    """First row per (block, lot, ward, section) with the first such parcel."""
    facts = keep_first(with_key(advertised, PROPERTY_KEYS), [KEY], _ordered(order, PROPERTY_KEYS))
    return left_match_first(facts, _first_parcel(parcels, PROPERTY_KEYS, parcel_order))


def combine_results(history: DataFrame, latest: DataFrame) -> DataFrame:
    """Certificate sales of the earlier years and the latest results, stacked by name."""
    return history.where("auction_type = 'certificate_sale'").unionByName(latest, allowMissingColumns=True)


def _first_parcel(parcels: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return keep_first(with_key(with_centroid(parcels), keys), [KEY], _ordered(order, keys))


def _ordered(names: Sequence[str], keys: Sequence[str] = ()) -> list[str]:
    """Sort items; the key columns are equal within a key and left out."""
    return [nulls_last(name) for name in names if name not in keys]
