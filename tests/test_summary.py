"""Area summaries on small hand-made tables."""

from __future__ import annotations

import datetime

import pytest

from liengrid.operators.grid import area_property_count, area_year_grid
from liengrid.plans.area_summary import (
    ADVERTISED_COLUMNS,
    AREA_YEAR_COLUMNS,
    summarise_advertised,
    summarise_by_area,
    unknown_area_loss,
)
from liengrid.plans.bidders import bidder_summary
from liengrid.plans.match_quality import area_report, drop_range, match_quality
from liengrid.plans.reports import (
    DISTRICT_LABELS,
    choropleth_layer,
    district_report,
    homeowner_lien_bins,
    lien_bin_counts,
    removed_after_deadline,
)

RESULT = """csa string, auction_year int, removed string, winning_bidder_name string, lien_amount double,
    assessed_value double, winning_bid double, num_bids int, homestead string, owner_occupied string, vacind string"""


@pytest.fixture(scope="module")
def counts(spark):
    parcels = spark.createDataFrame(
        [("Canton",)] * 8 + [("CARE",)] * 4 + [("Canton Industrial Area",)] * 2 + [(None,)], "csa string"
    )
    return area_property_count(parcels, ["csa"])


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(
        [
            ("Canton", 2019, "Y", None, 100.0, 1000.0, None, 2, "Y", None, "Y"),
            ("Canton", 2019, "N", "B1", 50.5, 3000.0, 10.0, 3, "Y", None, "N"),
            ("Canton", 2019, "N", "B1", 60.0, 2000.0, 20.0, None, "N", None, None),
            ("Canton", 2020, "Y", None, None, 10.0, None, None, None, "1", "Y"),
            ("Canton", 2020, "N", "B2", 30.0, 20.0, 5.0, None, None, "0", "N"),
            ("CARE", 2020, None, "B2", 30.0, None, 5.0, None, None, None, None),
            (None, 2019, "N", "B9", 1.0, 1.0, 1.0, 1, "Y", None, "Y"),
        ],
        RESULT,
    )


def by_cell(summary):
    return {(r.area, r.auction_year): r.asDict() for r in summary.collect()}


def test_counts_name_the_missing_area(counts):
    found = {(r.area, r.type): r.num_properties for r in counts.collect()}
    assert found == {
        ("Canton", "csa"): 8,
        ("CARE", "csa"): 4,
        ("Canton Industrial Area", "csa"): 2,
        ("Unknown", "csa"): 1,
    }


def test_grid_uses_the_distinct_years_of_an_index(spark, counts):
    index = spark.createDataFrame([(2019,), (2020,), (2020,), (None,)], "auction_year int")
    grid = area_year_grid(counts.select("area", "type"), index)
    assert grid.count() == 8 and {r.auction_year for r in grid.collect()} == {2019, 2020}


def test_area_year_summary(spark, results, counts):
    summary = summarise_by_area(results, counts, [2019, 2020], ["csa"])
    assert summary.columns == AREA_YEAR_COLUMNS
    rows = summary.collect()
    order = ["Canton", "Canton Industrial Area", "CARE", "Unknown"]
    assert [(r.area, r.auction_year) for r in rows] == [(a, y) for a in order for y in (2019, 2020)]

    cells = by_cell(summary)
    earlier = cells["Canton", 2019]
    expected = {
        "num_properties": 8,
        "perc_properties_area": 37.5,
        "perc_properties_sold_area": 25.0,
        "num_advertised": 3,
        "num_removed": 1,
        "num_scheduled": 2,
        "num_sold": 2,
        "sum_lien_amount": 210.5,
        "median_lien_amount": 60.0,
        "median_assessed_value": 2000.0,
        "num_winning_bidders": 2,
        "mean_num_bids": 2.5,
        "perc_removed": 33.33,
        "num_advertised_homestead": 2,
        "num_scheduled_homestead": 1,
        "perc_scheduled_homestead": 50.0,
        "num_owner_occupied": None,
        "num_vacant": None,
    }
    assert {name: earlier[name] for name in expected} == expected
    current = cells["Canton", 2020]
    expected = {
        "sum_lien_amount": None,
        "median_lien_amount": None,
        "median_assessed_value": 15.0,
        "mean_num_bids": None,
        "num_advertised_homestead": None,
        "num_owner_occupied": 1,
        "num_owner_occupied_removed": 1,
        "num_vacant": 1,
        "perc_owner_occupied": 50.0,
        "perc_owner_occupied_removed": 100.0,
        "perc_vacant": 50.0,
    }
    assert {name: current[name] for name in expected} == expected
    unknown_removal = cells["CARE", 2020]
    assert unknown_removal["num_removed"] == 0 and unknown_removal["num_scheduled"] == 0
    assert unknown_removal["perc_owner_occupied_removed"] is None
    empty = cells["Unknown", 2019]
    assert empty["num_advertised"] == 0 and empty["perc_properties_area"] == 0
    assert empty["num_sold"] is None and empty["perc_properties_sold_area"] is None


def test_unmatched_results_can_be_kept(spark, results, counts):
    summary = summarise_by_area(results, counts, [2019, 2020], ["csa"], keep_unmatched=True, bid_measures=True)
    cell = by_cell(summary)["Unknown", 2019]
    assert (cell["num_advertised"], cell["sum_winning_bids"], cell["median_winning_bid"]) == (1, 1.0, 1.0)


def test_homestead_needs_the_year_before_the_snapshot(spark, results, counts):
    older = results.replace(2019, 2010, ["auction_year"])
    cell = by_cell(summarise_by_area(older, counts, [2010, 2020], ["csa"]))["Canton", 2010]
    assert cell["num_advertised"] == 3 and cell["num_advertised_homestead"] is None


def test_approximate_medians_take_one_pass(spark, results, counts):
    summary = summarise_by_area(results, counts, [2019, 2020], ["csa"], median_accuracy=10000, distinct_error=0.02)
    cell = by_cell(summary)["Canton", 2019]
    assert (cell["median_lien_amount"], cell["num_winning_bidders"]) == (60.0, 2)


ADVERTISED = """objectid int, csa string, lien_amount double, assessment double, vacind string, no_imprv string,
    occupied string"""


@pytest.fixture(scope="module")
def advertised(spark):
    return spark.createDataFrame(
        [
            (1, "Canton", 10.0, 100.0, "Y", "N", "D"),
            (2, "Canton", 20.0, 200.0, "N", "Y", "H"),
            (3, "Canton", 30.0, 400.0, "N", "N", None),
            (4, "CARE", None, 100.0, None, "N", "D"),
            (None, None, 5.0, 50.0, None, None, "D"),
        ],
        ADVERTISED,
    )


def test_advertised_summary(advertised, counts):
    summary = summarise_advertised(advertised, counts, 2021, ["csa"])
    assert summary.columns == ADVERTISED_COLUMNS
    cells = {r.area: r.asDict() for r in summary.collect()}
    full, partial, empty = cells["Canton"], cells["CARE"], cells["Unknown"]
    assert (full["num_advertised"], full["sum_lien_amount"], full["median_lien_amount"]) == (3, 60.0, 20.0)
    assert (full["num_vacant"], full["num_vacant_lot"]) == (1, 1)
    assert (full["num_owner_occupied"], full["num_owner_occupied_not_vacant"]) == (2, 1)
    assert (full["perc_properties_area"], full["perc_vacant"], full["auction_year"]) == (37.5, 33.33, 2021)
    assert (partial["sum_lien_amount"], partial["median_lien_amount"]) == (0.0, None)
    assert (partial["num_vacant"], partial["num_owner_occupied_not_vacant"]) == (None, None)
    assert partial["num_vacant_lot"] == 0 and partial["num_owner_occupied"] == 1
    assert empty["num_advertised"] == 0 and empty["num_vacant"] is None
    kept = {r.area: r.num_advertised for r in summarise_advertised(advertised, counts, 2021, ["csa"], True).collect()}
    assert kept["Unknown"] == 1


def test_loss_report(advertised):
    assert unknown_area_loss(advertised, ["csa"]).first().asDict() == {
        "type": "csa",
        "rows_in": 5,
        "rows_shown": 4,
        "rows_lost": 1,
    }


def test_match_quality_and_its_report(spark, advertised):
    listed = advertised.selectExpr(
        "* except (assessment)", "string(assessment) as assessment", "csa as neighborhood", "csa as council_district"
    )
    quality = match_quality(listed)
    rows = {(r.type, r.area_name): r for r in quality.collect()}
    assert len(rows) == 9
    unmatched = rows["council district", None]
    assert (unmatched.num_matched, unmatched.num_unmatched, unmatched.perc_unmatched) == (0, 1, 100.0)
    assert unmatched.perc_matched == 0.0 and unmatched.perc_vacant is None
    assert rows["csa", "CARE"].mean_lien_amount is None and rows["csa", "CARE"].mean_assessment == 100.0
    assert rows["csa", "Canton"].sum_assessment == 700.0

    report = area_report(quality)
    assert [r.type for r in report.collect()] == sorted(r.type for r in report.collect())
    shown = {(r.type, r.area_name): r for r in report.collect()}["csa", "Canton"]
    assert (shown.mean_assessment, shown.sum_lien_amount, shown.perc_vacant) == ("$233.33", "$60.00", "33.33%")
    assert not {"num_matched", "num_unmatched", "perc_matched"} & set(report.columns)


def test_drop_range(spark):
    df = spark.range(1).selectExpr("1 as a", "2 as b", "3 as c", "4 as d")
    assert drop_range(df, "b", "c").columns == ["a", "d"]


def test_bidders(spark, results):
    extra = spark.createDataFrame([("CARE", 2019, "N", "B0", 1.0, 1.0, None, 1, "N", None, None)], RESULT)
    rows = [r.asDict() for r in bidder_summary(results.unionByName(extra)).collect()]
    assert [r["winning_bidder_name"] for r in rows] == ["B1", "B0", "B9"]
    assert rows[0] == {
        "auction_year": 2019,
        "winning_bidder_name": "B1",
        "num_bids_won": 2,
        "num_homestead": 1,
        "mean_winning_bid": 15.0,
        "median_winning_bid": 15.0,
        "sum_winning_bid_amount": 30.0,
        "perc_homestead_properties": 50.0,
    }
    assert (rows[1]["mean_winning_bid"], rows[1]["median_winning_bid"]) == (None, None)
    assert rows[1]["sum_winning_bid_amount"] == 0.0


def test_district_report(spark):
    day = datetime.date
    rows = [
        ("10", 2020, "Y", day(2020, 5, 1), "1", "Y"),
        ("10", 2020, "Y", day(2020, 4, 30), "1", "N"),
        ("2", 2020, "N", None, "0", "N"),
        (None, 2020, "N", None, None, None),
        ("X", 2020, "N", None, None, None),
        ("2", 2019, "N", None, None, None),
    ]
    results = spark.createDataFrame(
        rows,
        "council_district string, auction_year int, removed string, removed_date date, owner_occupied string, vacind string",
    )
    table = district_report(results).collect()
    assert [r.id for r in table] == ["2", "10", "X", None]
    ten = table[1]
    assert (ten.removed_properties, ten.properties_removed_after_original_deadline) == (2, 1)
    assert (ten.perc_removed, ten.perc_owner_occupied, ten.perc_owner_occupied_removed) == (100.0, 100.0, 100.0)
    assert district_report(results, labels=True).columns == list(DISTRICT_LABELS.values())
    late = removed_after_deadline(results, ["council_district"]).where("area = '10'").first()
    assert (late.num_advertised, late.num_removed_after_deadline) == (2, 1)


def test_map_layer_keeps_every_boundary(spark, advertised, counts):
    boundaries = spark.createDataFrame([("Canton", "g1"), ("Elsewhere", "g2")], "name string, geometry string")
    layer = choropleth_layer(boundaries, summarise_advertised(advertised, counts, 2021, ["csa"]))
    assert layer.columns[:2] == ["name", "geometry"]
    assert {(r.name, r.num_advertised) for r in layer.collect()} == {("Canton", 3), ("Elsewhere", None)}


def test_lien_bins_of_homeowners(spark):
    rows = [(i, "csa", float(i * 1000), 1.0, "N", "N", "D") for i in range(1, 11)]
    rows += [(99, "csa", 1.0, 1.0, "Y", "N", "D"), (98, "csa", 1.0, 1.0, "N", "N", "N"), (97, "c", 1.0, 1.0, None, "N", "H")]
    binned = homeowner_lien_bins(spark.createDataFrame(rows, ADVERTISED))
    assert binned.count() == 10
    assert {(r.lien_bin, r.num_properties) for r in lien_bin_counts(binned).collect()} == {(b, 2) for b in range(1, 6)}
