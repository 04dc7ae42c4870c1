"""The whole run from files to summaries."""

from __future__ import annotations

import csv
import glob

import pytest

from liengrid.plans.ingest import ADVERTISED_NAMES, ADVERTISED_UPDATE_NAMES
from liengrid.plans.full_run import Inputs, build_tables, write_summaries
from liengrid.sources.files import read_text_csv, read_text_table
from liengrid.sources.tables import PARCEL_COLUMNS, load_table

HEADER = (
    "Adv Number,Account Number,Removed Because,Removed Time Stamp,Homestead,Tax Year,Num Ties,Num Bids,Winning Bid,"
    "Winning Premium,Winning Bidder,Winning Amount Due,Face Amount,Assessed Value,Winning Bidder Name"
)
LATEST = (
    "Batch,Adv No,Cert No,Block,Lot,Ward,Lien Amount,Assessed Value,Winning Bid,Winning Bid Premium,"
    "Winning Bidder Amt Due,Tax Year,Removed Because,Removed Date,Owner Occupied,Winning Bidder Name"
)


def read_summary(path):
    rows = []
    for part in sorted(glob.glob(f"{path}/*.csv")):
        rows += list(csv.DictReader(open(part)))
    return rows


@pytest.fixture
def run(spark, tmp_path):
    square = [[{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 2.0}, {"x": 0.0, "y": 2.0}, {"x": 0.0, "y": 0.0}]]
    fixed = {c: "'-'" for c in PARCEL_COLUMNS} | {"no_imprv": "'N'", "vacind": "'N'", "ward": "'07'", "section": "'010'"}
    parcels = spark.createDataFrame(
        [("1", "123405", "1234", "05", "Canton", "District 1", "C1", square), ("2", "123406", "1234", "06", None, None, None, square)],
        """objectid string, pin string, block string, lot string, neighborhood string, council_district string,
        csa string, geometry array<array<struct<x:double,y:double>>>""",
    )
    parcels.selectExpr("*", *[f"{sql} as {c}" for c, sql in fixed.items() if c not in parcels.columns]).write.parquet(
        str(tmp_path / "parcels")
    )
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "index.csv").write_text(
        "auction_label,auction_date,auction_year,auction_type,tax_year\n"
        "2019 Sale,2019-05-13,2019,certificate_sale,2018\n2020 Sale,2020-07-20,2020,certificate_sale,2019\n"
    )
    (raw / "certificate_sale_results_2019.csv").write_text(
        f"{HEADER}\n1,01234005,,,1,2018,0,2,10.5,1,7,2,100.25,5000,Smith\n"
        "1,01234005,paid,2019-05-01,0,2018,0,2,,,,,90,5000,\n2,09999009,,,0,2018,0,1,5,1,7,2,10,500,Smith\n"
    )
    (raw / "report_2020.csv").write_text(f"{LATEST}\n1,5,C,1234,05,07,70,100,1,0,1,2019,bankruptcy,5/2/2020,1,\n")
    (raw / "list_update.csv").write_text(
        "Address,Blk,Lot,Wd,Sec,Assessed Value,Lien,Occupied\n1 Main,1234,05,07,010,100,1500,H\n2 Main,9,9,9,9,1,1,D\n"
    )
    first = spark.createDataFrame(
        [("1 Main", 3, "1234", "05", "07", "010", 100, 1200.5, "D")],
        "Address string, Seq int, Block string, Lot string, Ward string, Section string, Assessment int, `Lien Amount` double, Occupied string",
    )
    first.write.parquet(str(tmp_path / "list"))
    inputs = Inputs(
        parcels=str(tmp_path / "parcels"),
        index=str(raw / "index.csv"),
        history_folder=str(raw),
        latest_report=str(raw / "report_2020.csv"),
        lists={
            "advertised_first": (read_text_table(spark, str(tmp_path / "list")), ADVERTISED_NAMES, 2021),
            "advertised_update": (read_text_csv(spark, str(raw / "list_update.csv")), ADVERTISED_UPDATE_NAMES, 2021),
        },
    )
    build_tables(spark, inputs, str(tmp_path / "tables"))
    boundaries = spark.createDataFrame([("District 1", "g")], "name string, geometry string")
    write_summaries(
        spark,
        str(tmp_path / "tables"),
        str(tmp_path / "out"),
        "advertised_update",
        2021,
        str(raw / "index.csv"),
        boundaries=boundaries,
    )
    return tmp_path


def test_tables_and_summaries(spark, run):
    results = {r.adv_number: r for r in load_table(spark, f"{run}/tables/auction_results").collect()}
    assert results.keys() == {1, 2, 5}
    assert (results[1].lien_amount, results[1].csa, results[1].auction_label) == (100.25, "C1", "2019 Sale")
    assert results[2].csa is None and results[5].removed_because == "Bankruptcy"
    first = load_table(spark, f"{run}/tables/advertised_first").first()
    assert (first.adv_number, first.lien_amount, first.objectid, first.x) == (3, 1200.5, "1", 1.0)
    assert load_table(spark, f"{run}/tables/auction_year_area_index").count() == 12
    assert load_table(spark, f"{run}/tables/auction_year_area_index_2021").count() == 6

    by_year = read_summary(f"{run}/out/results_summary_by_csa_year")
    assert [(r["area"], r["auction_year"]) for r in by_year] == [
        ("C1", "2019"),
        ("C1", "2020"),
        ("Unknown", "2019"),
        ("Unknown", "2020"),
    ]
    assert (by_year[0]["num_removed"], by_year[0]["sum_lien_amount"]) == ("0", "100.25")
    assert (by_year[1]["num_owner_occupied_removed"], by_year[2]["num_removed"]) == ("1", "NA")
    by_list = read_summary(f"{run}/out/property_summary_by_district_2021")
    assert (by_list[0]["area"], by_list[0]["num_owner_occupied_not_vacant"]) == ("District 1", "1")
    assert read_summary(f"{run}/out/bidder_summary")[0]["winning_bidder_name"] == "Smith"
    assert read_summary(f"{run}/out/district_report")[0]["Council district"] == "District 1"
    assert {r["num_matched"] for r in read_summary(f"{run}/out/match_quality")} == {"0", "1"}
    bins = load_table(spark, f"{run}/out/homeowner_lien_bins").collect()
    assert [(r.lien_thousands, r.lien_bin) for r in bins] == [(1.5, 1)]
    assert load_table(spark, f"{run}/tables/rejected_rows").count() == 0
    assert load_table(spark, f"{run}/out/homeowner_lien_bin_counts").first().num_properties == 1
    assert {r["type"] for r in read_summary(f"{run}/out/area_report")} == {r["type"] for r in read_summary(f"{run}/out/match_quality")}
    assert load_table(spark, f"{run}/out/district_map").first().num_advertised == 1
