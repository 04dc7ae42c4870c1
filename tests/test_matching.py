"""Matching against the plain way: join first, keep the first row afterwards."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from liengrid.operators.keep_first import keep_first, nulls_last
from liengrid.operators.matching import left_match, left_match_first, match_audit, with_key
from liengrid.plans.match import combine_results, match_advertised, match_history, match_latest

PARCEL = "objectid int, pin string, block string, lot string, ward string, section string, csa string"


def maybe(value, chance=0.15):
    return None if random.random() < chance else value


def some_parcels(count):
    return [
        (
            i,
            maybe(str(random.randint(1, 8))),
            maybe(str(random.randint(1, 3))),
            str(random.randint(1, 2)),
            maybe("1"),
            maybe("2"),
            maybe(random.choice(["Canton", "CARE", "Oldtown"]), 0.4),
        )
        for i in range(count)
    ]


def last(value):
    """Sort key that puts null at the end."""
    return (value is None, value if value is not None else 0)


def plain_match(facts, parcels, fact_keys, parcel_keys, kept, order):
    """Nested loops, a stable sort and the first row per kept key; returns fact -> parcel ids."""
    joined = []
    for fact in facts:
        hits = [p for p in parcels if all(fact[a] == p[b] for a, b in zip(fact_keys, parcel_keys))]
        joined += [(fact, p) for p in sorted(hits, key=lambda p: p[0])] or [(fact, None)]
    first = {}
    for fact, parcel in sorted(joined, key=order):
        first.setdefault(tuple(fact[k] for k in kept), (fact[0], parcel and parcel[0]))
    return first


@pytest.mark.parametrize("seed", range(3))
def test_history(spark, seed):
    random.seed(seed)
    parcels = some_parcels(15)
    facts = [(i, maybe(str(random.randint(1, 10))), maybe(2000 + random.randint(0, 2))) for i in range(60)]
    results = spark.createDataFrame(facts, "adv_number int, pin string, auction_year int").selectExpr(
        "*", "'x' as block", "'y' as lot"
    )
    matched = match_history(results, spark.createDataFrame(parcels, PARCEL), ["adv_number"])
    found = {(r.pin, r.auction_year): (r.adv_number, r.objectid) for r in matched.collect()}
    assert matched.count() == len(found)
    assert found == plain_match(facts, parcels, [1], [1], [1, 2], lambda j: j[0][0])


@pytest.mark.parametrize("seed", range(3))
def test_latest_prefers_a_known_area(spark, seed):
    random.seed(seed)
    parcels = some_parcels(25)
    facts = [
        (i, maybe(random.randint(1, 20)), maybe(str(random.randint(1, 3))), str(random.randint(1, 2)), maybe("1"))
        for i in range(60)
    ]
    results = spark.createDataFrame(facts, "line int, adv_number int, block string, lot string, ward string")
    matched = match_latest(results, spark.createDataFrame(parcels, PARCEL), ["line"])
    found = {(r.adv_number,): (r.line, r.objectid) for r in matched.collect()}
    by_area = lambda j: (last(j[1] and j[1][6] and j[1][6].lower()), j[0][0], last(j[1] and j[1][0]))
    assert found == plain_match(facts, parcels, [2, 3, 4], [2, 3, 4], [1], by_area)


@pytest.mark.parametrize("seed", range(3))
def test_advertised(spark, seed):
    random.seed(seed)
    parcels = some_parcels(25)
    facts = [
        (i, maybe(str(random.randint(1, 3))), str(random.randint(1, 3)), maybe("1"), maybe("2"))
        for i in range(60)
    ]
    listed = spark.createDataFrame(facts, "line int, block string, lot string, ward string, section string")
    matched = match_advertised(listed, spark.createDataFrame(parcels, PARCEL), ["line"])
    keys = ["block", "lot", "ward", "section"]
    found = {tuple(r[k] for k in keys): (r.line, r.objectid) for r in matched.collect()}
    assert found == plain_match(facts, parcels, [1, 2, 3, 4], [2, 3, 4, 5], [1, 2, 3, 4], lambda j: j[0][0])


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_null_keys_match_null_keys_in_every_join(spark, threshold):
    left = spark.createDataFrame([("1", None, 1), (None, None, 2), ("2", "x", 3)], "a string, b string, l int")
    right = spark.createDataFrame([("1", None, 10), (None, None, 20), (None, "x", 30)], "a string, b string, r int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for joined in (
            left_match(left, right, ["a", "b"]),
            left_match_first(with_key(left, ["a", "b"]), with_key(right, ["a", "b"])),
        ):
            assert joined.columns[:2] == ["a", "b"]
            assert {(r.l, r.r) for r in joined.collect()} == {(1, 10), (2, 20), (3, None)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_clashing_columns_get_a_suffix(spark):
    left = spark.createDataFrame([(1, "a")], "k int, name string")
    right = spark.createDataFrame([(1, "b")], "k int, name string")
    assert left_match(left, right, ["k"]).first().asDict() == {"k": 1, "name": "a", "name_right": "b"}


def test_audit_counts_what_the_join_would_do(spark):
    random.seed(7)
    parcels = some_parcels(15)
    facts = [(i % 30, maybe(str(random.randint(1, 10))), 2000 + i % 3) for i in range(60)]
    left = spark.createDataFrame(facts, "adv_number int, pin string, auction_year int")
    right = spark.createDataFrame(parcels, PARCEL)
    pins = [p[1] for p in parcels]
    for kept in (["pin", "auction_year"], ["adv_number"]):
        place = [left.columns.index(k) for k in kept]
        keyed = [tuple(f[i] for i in place) for f in facts]
        assert match_audit(left, right, ["pin"], kept).first().asDict() == {
            "rows_in": 60,
            "rows_matched": sum(f[1] in pins for f in facts),
            "rows_unmatched": sum(f[1] not in pins for f in facts),
            "rows_after_join": sum(max(1, pins.count(f[1])) for f in facts),
            "rows_kept": len(set(keyed)),
            "rows_kept_matched": len({k for k, f in zip(keyed, facts) if f[1] in pins}),
        }


def test_stacking_keeps_certificates_and_fills_columns(spark):
    history = spark.createDataFrame(
        [("certificate_sale", 1), ("assignment_sale", 2), (None, 3)], "auction_type string, num_bids int"
    )
    latest = spark.createDataFrame([("certificate_sale", "1")], "auction_type string, owner_occupied string")
    rows = {tuple(r) for r in combine_results(history, latest).collect()}
    assert rows == {("certificate_sale", 1, None), ("certificate_sale", None, "1")}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keep_first_cuts_rows_before_the_shuffle(spark):
    plan = plan_of(keep_first(spark.range(100).selectExpr("id % 5 as k", "id"), ["k"], [nulls_last("id")]))
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_property_match_shuffles_each_side_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        listed = spark.range(100).selectExpr(
            "id as line", "string(id) as block", "'1' as lot", "'1' as ward", "'1' as section"
        )
        parcels = spark.range(100).selectExpr(
            "id as objectid", "string(id) as block", "'1' as lot", "'1' as ward", "'1' as section", "'a' as csa"
        )
        plan = plan_of(match_advertised(listed, parcels, ["line"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 2 and "SortMergeJoin" in plan


def test_a_frequent_property_key_is_split(spark):
    """A third of the results share one property; the join has to use several tasks for it."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        results = spark.range(60_000, numPartitions=8).selectExpr(
            "id as adv_number", "if(id % 3 = 0, '0', string(id)) as block", "'1' as lot", "'1' as ward"
        )
        parcels = spark.range(30_000).selectExpr(
            "id as objectid", "string(id) as block", "'1' as lot", "'1' as ward", "'1' as section", "'a' as csa"
        )
        matched = match_latest(results, parcels, ["adv_number"])
        rows = matched.agg(F.count("*"), F.count("objectid")).collect()
        assert rows[0][0] == 60_000 and rows[0][1] == 40_000
        matched.collect()
        plan = matched._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert "SortMergeJoin(skew=true)" in plan
