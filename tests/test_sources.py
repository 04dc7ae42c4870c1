"""Files in, tables between, files out."""

from __future__ import annotations

import datetime
import glob

import pytest

from liengrid.functions.geometry import EPSG_2804
from liengrid.plans.ingest import (
    ADVERTISED_UPDATE_NAMES,
    type_advertised,
    type_history,
    type_latest,
    with_auction_index,
)
from liengrid.sources import files, tables


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "certificate_sale_results_2018.csv").write_text(
        "Adv Number,Account Number,Removed Because,Removed Time Stamp,Homestead,Tax Year,Num Ties,Num Bids,"
        "Winning Bid,Winning Premium,Winning Bidder,Winning Amount Due,Face Amount,Assessed Value,Winning Bidder Name\n"
        ' 1 ,01234005,"paid-in-full",2018-05-01 10:00:00,1,2017,0,2, 10.50 ,1,7,2,100.25,5000,"Smith, J"\n'
        '2,0123B004,NA,,0,2017,x,3.7,NA,"",NA,,,,\n'
    )
    (tmp_path / "certificate_sale_results_2019.csv").write_text(
        "Tax Year,Adv Number,Account Number,Removed Because,Removed Time Stamp,Homestead,Num Ties,Num Bids,"
        "Winning Bid,Winning Premium,Winning Bidder,Winning Amount Due,Face Amount,Assessed Value,Winning Bidder Name,Extra\n"
        "2018,3,01234005,,,,1,1,1,1,1,1,1,1,B,more\n"
    )
    (tmp_path / "certificate_sale_results_2017.csv").write_text(
        (tmp_path / "certificate_sale_results_2018.csv").read_text().splitlines()[0] + "\n4" + "," * 14 + "\n"
    )
    (tmp_path / "certificate_sale_results_2020.csv").write_text("a\n1\n")
    (tmp_path / "notes.csv").write_text("a\n1\n")
    (tmp_path / "certificate_sale_results_old.txt").write_text("a\n1\n")
    return tmp_path


def test_files_are_chosen_by_name(spark, folder):
    found = files.find_files(spark, str(folder), "certificate_sale_results", excludes="2020")
    assert [path.rsplit("_", 1)[1] for path in found] == ["2017.csv", "2018.csv", "2019.csv"]


def test_yearly_files_become_typed_results(spark, folder):
    found = files.find_files(spark, str(folder), "certificate_sale_results", excludes="2020")
    raw = files.read_text_csvs(spark, found)
    assert set(dict(raw.dtypes).values()) == {"string"} and raw.count() == 4
    assert raw._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
    rows = {r.adv_number: r for r in type_history(raw).collect()}
    first, second, third = rows[1], rows[2], rows[3]
    assert (first.block, first.lot, first.pin) == ("1234", "05", "123405")
    assert (first.removed, first.removed_because) == ("Y", "Paid-In-Full")
    assert first.removed_date == datetime.date(2018, 5, 1)
    assert (first.winning_bid, first.lien_amount, first.winning_bidder_name) == (10.5, 100.25, "Smith, J")
    assert (first.auction_year, first.auction_type, first.homestead) == (2018, "certificate_sale", "Y")
    assert (second.removed, second.removed_because, second.homestead, second.pin) == ("N", None, "N", "0123B04")
    assert (second.num_ties, second.num_bids, second.winning_bid, second.winning_bidder_number) == (None, 3, None, None)
    assert (third.extra, third.homestead, first.extra) == ("more", None, None)
    assert rows[4].tax_year is None and rows[4].pin is None
    assert "path" not in first


def test_index_gives_label_and_date(spark, folder):
    (folder / "index.csv").write_text(
        "auction_label,auction_date,auction_year,auction_type,tax_year\n"
        "2018 Sale,2018-05-14,2018,certificate_sale,2017\nOther,NA,2018,assignment_sale,2017\n"
    )
    index = files.read_auction_index(spark, str(folder / "index.csv"))
    assert [r.auction_date for r in index.collect()] == [datetime.date(2018, 5, 14), None]
    raw = files.read_text_csvs(spark, files.find_files(spark, str(folder), "results", excludes="2020"))
    labels = {r.adv_number: r.auction_label for r in with_auction_index(type_history(raw), index).collect()}
    assert labels == {1: "2018 Sale", 2: "2018 Sale", 3: None, 4: None}


def test_latest_report(spark, folder):
    (folder / "report.csv").write_text(
        "Batch,Adv No.,Cert No.,Block,Lot,Ward,Lien Amount,Assessed Value,Winning Bid,Winning Bid Premium,"
        "Winning Bidder Amt Due,Tax Year,Removed Because,Removed Date,Owner Occupied,Winning Bidder Name\n"
        "1,11,C1, 0123 ,004,07,12.5,100,1,0,1,2019,bankruptcy,5/2/2020,1,\n"
    )
    row = type_latest(files.read_text_csv(spark, str(folder / "report.csv"))).first()
    assert (row.batch_number, row.adv_number, row.certificate_number) == ("1", 11, "C1")
    assert (row.block, row.lot, row.ward, row.lien_amount) == ("0123", "004", "07", 12.5)
    assert (row.removed, row.removed_because, row.removed_date) == ("Y", "Bankruptcy", datetime.date(2020, 5, 2))
    assert (row.auction_year, row.auction_type, row.owner_occupied) == (2020, "certificate_sale", "1")


def test_both_releases_of_the_list(spark):
    first = spark.createDataFrame([("1 Main", "5", "10", "2", "3", "NA", "100", "x")],
        "Address string, Seq string, Block string, Lot string, Ward string, Section string, Assessment string, `Lien Amount` string")
    second = spark.createDataFrame([("1 Main", "10", "2", "3", "4", "100", "7.5")],
        "Address string, Blk string, Lot string, Wd string, Sec string, `Assessed Value` string, Lien string")
    old = type_advertised(first, 2021).first()
    new = type_advertised(second, 2021, ADVERTISED_UPDATE_NAMES).first()
    assert (old.street_name, old.adv_number, old.section, old.assessment, old.lien_amount) == ("1 Main", 5, None, 100.0, None)
    assert (new.block, new.ward, new.section, new.lien_amount, new.adv_number) == ("10", "3", "4", 7.5, None)
    assert (new.tax_year, new.auction_year) == (2020, 2021)


def test_tables_are_overwritten_and_pruned(spark, tmp_path):
    path = str(tmp_path / "results")
    df = spark.range(100).selectExpr("id", "int(2006 + id % 3) as auction_year")
    for _ in range(2):
        tables.save_table(df, path, ["auction_year"])
    stored = tables.load_table(spark, path)
    assert stored.count() == 100 and len(glob.glob(f"{path}/auction_year=*")) == 3
    plan = stored.where("auction_year <> 2006")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(auction_year" in plan


def test_summary_file_keeps_order_and_writes_na(spark, tmp_path):
    df = spark.createDataFrame([("B", 1.5, None), ("a", None, 2)], "area string, share double, n int")
    path = str(tmp_path / "summary")
    tables.write_summary_csv(df.orderBy("area"), path)
    lines = [line for part in sorted(glob.glob(f"{path}/*.csv")) for line in open(part).read().splitlines()]
    assert lines == ["area,share,n", "B,1.5,NA", "a,NA,2"]


def test_parcels_are_selected_and_projected(spark, tmp_path):
    corner = [{"x": -77.0, "y": EPSG_2804.origin_lat}]
    columns = ", ".join(f"'{c}' as {c}" for c in tables.PARCEL_COLUMNS)
    df = spark.createDataFrame([([corner],)], "geometry array<array<struct<x:double,y:double>>>")
    df.selectExpr("*", *columns.split(", "), "'z' as unused").write.parquet(str(tmp_path / "parcels"))
    parcels = tables.read_parcels(spark, str(tmp_path / "parcels"), EPSG_2804)
    assert parcels.columns == [*tables.PARCEL_COLUMNS, "geometry"]
    assert parcels.first().geometry[0][0].x == pytest.approx(400000.0)


def test_stage_writes_to_the_shared_folder(spark):
    staged = tables.stage(spark.range(5).selectExpr("id", "id * 2 as twice"))
    assert staged.count() == 5
    assert spark.conf.get("spark.checkpoint.dir") in staged.inputFiles()[0]


def test_summary_is_one_file_with_one_header(spark, tmp_path):
    df = spark.range(8).selectExpr("id as n", "if(id = 3, null, id) as x").repartition(4).orderBy("n")
    tables.write_summary_csv(df, str(tmp_path / "summary"))
    (part,) = (tmp_path / "summary").glob("part-*")
    assert part.read_text().splitlines() == ["n,x", *[f"{n},{'NA' if n == 3 else n}" for n in range(8)]]
