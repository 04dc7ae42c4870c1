"""Sketches that merge, and tables that grow without being written anew."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from liengrid.operators.sketches import distinct_counts, distinct_sketches, merge_sketches, relative_error
from liengrid.plans.full_run import Inputs, add_history, build_tables
from liengrid.sources import tables
from test_full_run import HEADER, LATEST


def files_of(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("part-*")}


def test_sketches_of_parts_count_the_whole(spark):
    df = spark.range(300_000).selectExpr("id % 3 as area", "id % 7 as year", "if(id % 11 = 0, null, id % 40000) as who")
    parts = distinct_sketches(df.where("year < 5"), ["area", "year"], ["who"])
    late = distinct_sketches(df.where("year >= 5"), ["area", "year"], ["who"])
    merged = merge_sketches(parts.unionByName(late), ["area"], ["who"])
    exact = {r.area: r.n for r in df.groupBy("area").agg(F.expr("count(distinct who) + 1 as n")).collect()}
    for r in distinct_counts(merged, ["area"], ["who"]).collect():
        assert abs(r.num_distinct_who - exact[r.area]) <= relative_error() * exact[r.area]


def test_few_values_are_counted_exactly_and_null_is_one(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("a", "x"), ("b", "y"), ("c", None)], "k string, who string")
    made = distinct_counts(distinct_sketches(df, ["k"], ["who"]), ["k"], ["who"]).collect()
    assert sorted(map(tuple, made)) == [("a", 2), ("b", 1), ("c", 1)]


def test_one_year_is_replaced_and_the_others_untouched(spark, tmp_path):
    df = spark.range(90).selectExpr("id", "int(2006 + id % 3) as year")
    path = tmp_path / "t"
    tables.save_partitions(df, str(path), ["year"])
    before = files_of(path)
    for _ in range(2):
        tables.save_partitions(df.where("year = 2007").selectExpr("id * 10 as id", "year"), str(path), ["year"])
    after = files_of(path)
    assert {f: t for f, t in before.items() if "2007" not in f} == {f: t for f, t in after.items() if "2007" not in f}
    stored = tables.load_table(spark, str(path))
    assert stored.count() == 90 and stored.where("year = 2007").agg({"id": "sum"}).first()[0] == 10 * sum(range(1, 90, 3))


def test_a_table_is_replaced_by_what_reads_it(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(3).toDF("n"), path)
    tables.replace_table(tables.load_table(spark, path).selectExpr("n + 10 as n"), path)
    assert sorted(r.n for r in tables.load_table(spark, path).collect()) == [10, 11, 12]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t"]


def test_a_broken_replacement_leaves_a_whole_version(spark, tmp_path):
    path = tmp_path / "t"
    tables.replace_table(spark.range(3).toDF("n"), str(path))
    bad = spark.range(3).selectExpr("if(id = 2, raise_error('broken'), id) as n")
    with pytest.raises(Exception, match="broken"):
        tables.replace_table(bad, str(path))
    assert tables.load_table(spark, str(path)).count() == 3
    path.rename(tmp_path / "t.before")
    tables.recover_table(spark, str(path))
    assert tables.load_table(spark, str(path)).count() == 3
    (tmp_path / "t.before").mkdir()
    tables.recover_table(spark, str(path))
    assert not (tmp_path / "t.before").exists() and tables.load_table(spark, str(path)).count() == 3
    path.rename(tmp_path / "t.before")
    tables.replace_table(spark.range(5).toDF("n"), str(path))
    assert tables.load_table(spark, str(path)).count() == 5


def test_a_late_year_is_added_to_the_stored_tables(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    fixed = {c: "'-'" for c in tables.PARCEL_COLUMNS} | {"objectid": "'1'", "pin": "'123405'", "csa": "'C1'"}
    shape = "array(array(array(named_struct('x', 0D, 'y', 0D)))) as geometry"
    spark.range(1).selectExpr(*[f"{sql} as {c}" for c, sql in fixed.items()], shape).write.parquet(str(tmp_path / "parcels"))
    (raw / "index.csv").write_text("auction_label,auction_date,auction_year,auction_type,tax_year\nS,2019-05-13,2019,certificate_sale,2018\n")
    line = "{},01234005,,,1,{},0,2,10.5,1,7,2,100.25,5000,{}\n"
    (raw / "certificate_sale_results_2018.csv").write_text(f"{HEADER}\n" + line.format(1, 2017, "A") + "too,short\n")
    (raw / "certificate_sale_results_2019.csv").write_text(f"{HEADER}\n" + line.format(2, 2018, "B"))
    (raw / "report_2020.csv").write_text(f"{LATEST}\n1,5,C,1234,05,07,70,100,1,0,1,2019,bankruptcy,5/2/2020,1,\n")
    inputs = Inputs(str(tmp_path / "parcels"), str(raw / "index.csv"), str(raw), str(raw / "report_2020.csv"))
    out = tmp_path / "tables"
    build_tables(spark, inputs, str(out))
    assert tables.load_table(spark, f"{out}/rejected_rows").first().record == "too,short"
    before = {n: files_of(out / n) for n in ("auction_results", "auction_results_history", "bidder_sketches")}
    (raw / "certificate_sale_results_2019.csv").write_text(f"{HEADER}\n" + line.format(2, 2018, "C") + "another,short\n")
    for _ in range(2):
        assert add_history(spark, inputs, str(out), "2019") == [2019]
    for name, files in before.items():
        kept = {f: t for f, t in files.items() if "auction_year=2019" not in f}
        assert kept and kept == {f: t for f, t in files_of(out / name).items() if "auction_year=2019" not in f}
    rows = tables.load_table(spark, f"{out}/auction_results").collect()
    assert sorted((r.auction_year, r.winning_bidder_name) for r in rows if r.auction_year < 2020) == [(2018, "A"), (2019, "C")]
    assert sorted(r.record for r in tables.load_table(spark, f"{out}/rejected_rows").collect()) == ["another,short", "too,short"]
    merged = merge_sketches(tables.load_table(spark, f"{out}/bidder_sketches").where("auction_year < 2020"), ["type"], ["winning_bidder_name"])
    assert {r.num_distinct_winning_bidder_name for r in distinct_counts(merged, ["type"], ["winning_bidder_name"]).collect()} == {2}
