"""Headers of many files in one scan, rows that don't fit them, and the order of rows in files."""

from __future__ import annotations

import pytest

from liengrid.plans.ingest import type_history
from liengrid.plans.match import match_history
from liengrid.sources import files


@pytest.fixture
def ragged(tmp_path):
    (tmp_path / "results_1.csv").write_text('\n a ,b,c\n1,2,3\n4,5\n6,7,8,9\n"x\ny", z ,""\n\n,,\n')
    (tmp_path / "results_2.csv").write_text("﻿c,a,a,\r\n1,2,3,4\r\n")
    (tmp_path / "results_3.csv").write_text("")
    (tmp_path / "other.csv").write_text("a,b,c\n0,0,0\n")
    return tmp_path


def jobs_of(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        result = action()
        return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()


def test_layouts_of_many_files_take_two_jobs(spark, tmp_path):
    headers = ["a,b", "b,a", "a,b,c"]
    for i in range(200):
        (tmp_path / f"f{i:03d}.csv").write_text(f"{headers[i % 3]}\n" + "1,2,3\n"[: 4 + 2 * (i % 3 == 2)].strip(",") + "\n")
    layouts, jobs = jobs_of(spark, "layouts", lambda: files.find_layouts(spark, str(tmp_path), "f", glob="*.csv"))
    assert jobs <= 2
    assert {la.columns: len(la.paths) for la in layouts} == {("a", "b"): 67, ("b", "a"): 67, ("a", "b", "c"): 66}
    rows = files.read_checked_csvs(spark, layouts)
    assert rows.rows._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 3


def test_names_of_headers(spark, ragged):
    layouts = files.find_layouts(spark, str(ragged), "results", glob="*.csv")
    assert [la.columns for la in layouts] == [("a", "b", "c"), ("c", "a1", "a2", "_c3")]
    assert files.find_layouts(spark, str(ragged), "results", excludes="results") == []
    (ragged / "results_4.csv").write_text('"a\nb",c\n1,2\n')
    with pytest.raises(ValueError, match="results_4"):
        files.find_layouts(spark, str(ragged), "results")


@pytest.mark.parametrize("multi_line", [True, False])
def test_every_row_is_typed_or_rejected(spark, ragged, multi_line):
    path = ragged / "results_1.csv"
    if not multi_line:
        path.write_text(path.read_text().replace("x\ny", "x y"))
    read = files.read_checked_csvs(spark, files.find_layouts(spark, str(path)), multi_line)
    rows = read.rows.orderBy(files.FILE_ORDER).drop(files.FILE_ORDER).collect()
    assert [tuple(r) for r in rows] == [("1", "2", "3"), ("x\ny" if multi_line else "x y", "z", None), (None, None, None)]
    assert [r.record for r in read.rejected.orderBy(files.FILE_ORDER).collect()] == ["4,5", "6,7,8,9"]
    assert read.rows.select("b").count() + read.rejected.count() == 5
    assert read.rows.count() == 3


def test_what_becomes_of_ragged_rows(spark, ragged):
    path = str(ragged / "results_1.csv")
    with pytest.raises(Exception, match="does not fit the header"):
        files.read_text_csv(spark, path).select("a").collect()
    kept = files.read_text_csv(spark, path, ragged="keep", with_order=True).orderBy(files.FILE_ORDER)
    assert [tuple(r) for r in kept.drop(files.FILE_ORDER).collect()][1:3] == [("4", "5", None), ("6", "7", "8")]
    assert files.read_text_csvs(spark, [path], ragged="reject").count() == 3
    with pytest.raises(ValueError, match="ragged"):
        files.read_text_csv(spark, path, ragged="maybe")
    with pytest.raises(FileNotFoundError):
        files.read_checked_csvs(spark, [])
    with pytest.raises(FileNotFoundError):
        files.read_text_csv(spark, str(ragged / "results_3.csv"))


def test_first_row_in_the_file_wins(spark, tmp_path):
    """Two rows of one property and year: the first line wins, though the other has the smaller number."""
    header = (
        "Adv Number,Account Number,Removed Because,Removed Time Stamp,Homestead,Tax Year,Num Ties,Num Bids,Winning Bid,"
        "Winning Premium,Winning Bidder,Winning Amount Due,Face Amount,Assessed Value,Winning Bidder Name\n"
    )
    line = "{},01234005,,,1,{},,,,,,,10,,{}\n"
    (tmp_path / "certificate_2.csv").write_text(header + line.format(1, 2018, "later file"))
    (tmp_path / "certificate_1.csv").write_text(header + line.format(9, 2018, "first") + line.format(2, 2018, "second") + line.format(5, 2017, "other year"))
    paths = files.find_files(spark, str(tmp_path), "certificate")
    typed = type_history(files.read_text_csvs(spark, paths, with_order=True))
    parcels = spark.createDataFrame([(7, "123405", "x")], "objectid long, pin string, csa string")
    matched = match_history(typed, parcels, [files.FILE_ORDER]).collect()
    assert sorted((r.auction_year, r.adv_number, r.winning_bidder_name, r.objectid) for r in matched) == [
        (2018, 5, "other year", 7),
        (2019, 9, "first", 7),
    ]
