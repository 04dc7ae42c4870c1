"""The whole run: raw files to stored tables, stored tables to summary files.

Each matched table is written once and read by every summary, so the joins to the
parcels are done once and a summary scans only the columns it needs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liengrid.functions.geometry import LambertConic
from liengrid.operators.grid import AREA_TYPES, area_property_count, area_year_grid, by_area
from liengrid.operators.sketches import distinct_sketches
from liengrid.plans.area_summary import (
    ADVERTISED_COLUMNS,
    AREA_YEAR_COLUMNS,
    area_year_order,
    summarise_advertised,
    summarise_by_area,
)
from liengrid.plans.bidders import bidder_order, bidder_summary
from liengrid.plans.ingest import type_advertised, type_history, type_latest, with_auction_index
from liengrid.plans.match import combine_results, match_advertised, match_history, match_latest
from liengrid.plans.match_quality import area_report, match_quality, report_order
from liengrid.plans.reports import (
    DISTRICT_ORDER,
    choropleth_layer,
    district_order,
    district_report,
    homeowner_lien_bins,
    lien_bin_counts,
)
from liengrid.sources.files import FILE_ORDER, Layout, find_layouts, read_auction_index, read_checked_csvs
from liengrid.sources.tables import (
    load_table,
    read_parcels,
    replace_table,
    save_partitions,
    save_table,
    stage,
    write_summary_csv,
)

BIDDERS = ["winning_bidder_name"]

# How an area type appears in the name of a summary.
AREA_LABELS = {"neighborhood": "neighborhood", "csa": "csa", "council_district": "district"}


@dataclass(frozen=True)
class Inputs:
    """Where the raw files are.

    lists maps a table name to the raw list, its header names and its auction year.
    """

    parcels: str
    index: str
    history_folder: str
    latest_report: str
    lists: Mapping[str, tuple[DataFrame, dict[str, str], int]] = field(default_factory=dict)
    history_name: str = "certificate_sale_results"
    snapshot_year: int = 2020
    projection: LambertConic | None = None


def _row_order(df: DataFrame) -> list[str]:
    """The order of the rows in their files; of tables without one, business number, then all other columns."""
    if FILE_ORDER in df.columns:
        return [FILE_ORDER]
    return ["adv_number", *sorted(c for c in df.columns if c != "adv_number")]


def build_tables(spark: SparkSession, inputs: Inputs, out: str) -> None:
    """K1: reads the raw files and stores the typed, matched and dimension tables in out.

    Rows of the result files that don't fit their header are in the table rejected_rows.
    """
    save_table(read_parcels(spark, inputs.parcels, inputs.projection), f"{out}/real_property")
    parcels = load_table(spark, f"{out}/real_property")
    index = read_auction_index(spark, inputs.index)
    save_table(area_property_count(parcels), f"{out}/area_property_count")
    areas = load_table(spark, f"{out}/area_property_count").select("area", "type")
    save_table(area_year_grid(areas, index), f"{out}/auction_year_area_index")

    layouts = find_layouts(
        spark, inputs.history_folder, inputs.history_name, excludes=str(inputs.snapshot_year), glob="*.csv"
    )
    yearly = read_checked_csvs(spark, layouts)
    raw = yearly.rows.withColumn("path", F.col(f"{FILE_ORDER}.path"))
    history = with_auction_index(type_history(raw), index)
    matched = match_history(history, parcels, _row_order(history)).drop(FILE_ORDER)
    save_table(matched, f"{out}/auction_results_history", ["auction_year"])

    report = read_checked_csvs(spark, find_layouts(spark, inputs.latest_report))
    latest = with_auction_index(type_latest(report.rows), index)
    save_table(match_latest(latest, parcels, _row_order(latest)).drop(FILE_ORDER), f"{out}/auction_results_latest")
    save_table(yearly.rejected.unionByName(report.rejected), f"{out}/rejected_rows")

    results = combine_results(
        load_table(spark, f"{out}/auction_results_history"), load_table(spark, f"{out}/auction_results_latest")
    )
    save_table(results.drop("x", "y"), f"{out}/auction_results", ["auction_year"])
    save_table(bidder_sketches(load_table(spark, f"{out}/auction_results")), f"{out}/bidder_sketches", ["auction_year"])

    for name, (raw, headers, year) in inputs.lists.items():
        listed = type_advertised(raw, year, headers)
        save_table(match_advertised(listed, parcels, _row_order(listed)).drop(FILE_ORDER), f"{out}/{name}")
        save_table(area_year_grid(areas, [year]), f"{out}/auction_year_area_index_{year}")


def add_history(spark: SparkSession, inputs: Inputs, out: str, contains: str) -> list[int]:
    """Reads the result files whose name contains a text and replaces their years in the stored tables.

    Other years' files are left as they are; a run that failed is repeated as it is. Returns the years.
    """
    parcels, index = load_table(spark, f"{out}/real_property"), read_auction_index(spark, inputs.index)
    layouts = find_layouts(spark, inputs.history_folder, inputs.history_name, excludes=str(inputs.snapshot_year), glob="*.csv")
    chosen = [Layout(la.columns, tuple(p for p in la.paths if contains in p.rsplit("/", 1)[1])) for la in layouts]
    read = read_checked_csvs(spark, [la for la in chosen if la.paths])
    raw = read.rows.withColumn("path", F.col(f"{FILE_ORDER}.path"))
    history = with_auction_index(type_history(raw), index)
    matched = stage(match_history(history, parcels, _row_order(history)).drop(FILE_ORDER))
    save_partitions(matched, f"{out}/auction_results_history", ["auction_year"])
    years = sorted(r.auction_year for r in matched.select("auction_year").distinct().collect() if r.auction_year is not None)
    stored = load_table(spark, f"{out}/auction_results_history").where(F.col("auction_year").isin(years))
    latest = load_table(spark, f"{out}/auction_results_latest")
    combined = combine_results(stored, latest).where(F.col("auction_year").isin(years)).drop("x", "y")
    save_partitions(combined, f"{out}/auction_results", ["auction_year"])
    known = load_table(spark, f"{out}/rejected_rows")
    other = known.where(~F.substring_index(f"{FILE_ORDER}.path", "/", -1).contains(contains))
    replace_table(other.unionByName(read.rejected), f"{out}/rejected_rows")
    sketches = bidder_sketches(load_table(spark, f"{out}/auction_results").where(F.col("auction_year").isin(years)))
    save_partitions(sketches, f"{out}/bidder_sketches", ["auction_year"])
    return years


def bidder_sketches(results: DataFrame) -> DataFrame:
    """Sketches of the bidders of each area and year, to be merged over areas, years and late files."""
    return distinct_sketches(by_area(results, AREA_TYPES, ["auction_year", *BIDDERS]), ["type", "area", "auction_year"], BIDDERS)


def write_summaries(
    spark: SparkSession,
    tables: str,
    out: str,
    advertised: str,
    list_year: int,
    index: str,
    pre_year: int = 2019,
    snapshot_year: int = 2020,
    boundaries: DataFrame | None = None,
    area_types: Sequence[str] = AREA_TYPES,
) -> None:
    """Reads stored tables and writes every summary, bin and map table to out."""
    counts = load_table(spark, f"{tables}/area_property_count")
    results = load_table(spark, f"{tables}/auction_results")
    listed = load_table(spark, f"{tables}/{advertised}")
    years = read_auction_index(spark, index)
    # One run for all area types, stored by type; each file is cut from it.
    by_year = summarise_by_area(results, counts, years, area_types, pre_year, snapshot_year, sketched=True)
    save_table(by_year, f"{out}/results_summary", ["type"])
    save_table(summarise_advertised(listed, counts, list_year, area_types), f"{out}/property_summary", ["type"])
    for area in area_types:
        label = AREA_LABELS[area]
        for name, columns, file in (
            ("results_summary", AREA_YEAR_COLUMNS, f"results_summary_by_{label}_year"),
            ("property_summary", ADVERTISED_COLUMNS, f"property_summary_by_{label}_{list_year}"),
        ):
            cut = load_table(spark, f"{out}/{name}").where(F.col("type") == area).select(*columns)
            write_summary_csv(cut, f"{out}/{file}", area_year_order())
    write_summary_csv(bidder_summary(results, snapshot_year), f"{out}/bidder_summary", bidder_order())
    quality = stage(match_quality(listed))
    write_summary_csv(quality, f"{out}/match_quality", report_order())
    write_summary_csv(area_report(quality), f"{out}/area_report", report_order())
    districts = district_report(results, snapshot_year, labels=True)
    write_summary_csv(districts, f"{out}/district_report", district_order(districts.columns[0], DISTRICT_ORDER))
    bins = stage(homeowner_lien_bins(listed))
    save_table(bins, f"{out}/homeowner_lien_bins")
    save_table(lien_bin_counts(bins), f"{out}/homeowner_lien_bin_counts")
    if boundaries is not None:
        by_district = load_table(spark, f"{out}/property_summary").where("type = 'council_district'")
        save_table(choropleth_layer(boundaries, by_district), f"{out}/district_map")
