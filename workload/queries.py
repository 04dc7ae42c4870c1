"""One callable per registered query: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liengrid.functions.geometry import EPSG_2804, over_points
from liengrid.functions.numbers import exact_sum, money_sum, pct
from liengrid.functions.text import account_block, account_lot
from liengrid.operators.columns import aggregate_sql, with_sql
from liengrid.operators.grid import area_property_count, area_year_grid, by_area
from liengrid.operators.keep_first import keep_first, nulls_last
from liengrid.operators.matching import match_audit
from liengrid.operators.sketches import distinct_counts, distinct_sketches, merge_sketches
from liengrid.plans.area_summary import (
    ADVERTISED_INPUTS,
    RESULT_INPUTS,
    summarise_advertised,
    summarise_by_area,
    unknown_area_loss,
)
from liengrid.plans.bidders import bidder_summary
from liengrid.plans.ingest import (
    ADVERTISED_UPDATE_NAMES,
    type_advertised,
    type_history,
    type_latest,
    with_auction_index,
)
from liengrid.plans.match import (
    LATEST_KEYS,
    PROPERTY_KEYS,
    combine_results,
    match_advertised,
    match_history,
    match_latest,
    with_centroid,
)
from liengrid.plans.match_quality import area_report, match_quality
from liengrid.plans.reports import (
    choropleth_layer,
    district_report,
    homeowner_lien_bins,
    lien_bin_counts,
    removed_after_deadline,
)
from liengrid.sources.files import (
    FILE_ORDER,
    find_files,
    find_layouts,
    read_auction_index,
    read_checked_csvs,
    read_text_csvs,
    read_text_table,
)
from liengrid.sources.tables import load_table, read_parcels, save_table, stage, write_summary_csv
from workload import raw_files
from workload import tables as t

AREAS = {"district": "council_district", "csa": "csa", "neighborhood": "neighborhood"}
SHOWN_FACT = ["adv_number", "auction_year", "auction_type", "removed", "lien_amount"]
CENTRE = ["round(x, 6) as x", "round(y, 6) as y"]
SHOWN_PARCEL = ["objectid", "owner_1", "neighborhood", "csa", "council_district"]


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Rounds values that two engines may interpolate with a different last bit."""
    return with_sql(df, {name: f"round({name}, {digits})" for name in names})


def matched_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    parcels = t.parcels_with_copies(spark, sf_dir)
    return match_history(t.history(t.results(spark, sf_dir)), parcels, t.RESULT_ORDER)


def matched_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parcels = t.parcels_with_copies(spark, sf_dir)
    return match_latest(t.latest(t.results(spark, sf_dir)), parcels, t.RESULT_ORDER)


def matched_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    parcels, results = t.parcels_with_copies(spark, sf_dir), t.results(spark, sf_dir)
    return combine_results(
        match_history(t.history(results), parcels, t.RESULT_ORDER),
        match_latest(t.latest(results), parcels, t.RESULT_ORDER),
    )


def matched_advertised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_advertised(t.advertised(spark, sf_dir), t.parcels(spark, sf_dir), t.ADVERTISED_ORDER)


def staged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined results with the columns the summaries read, written once."""
    return stage(matched_results(spark, sf_dir).select(*AREAS.values(), *RESULT_INPUTS))


def staged_advertised(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The advertised list with the columns the summaries read, written once."""
    columns = [*AREAS.values(), *ADVERTISED_INPUTS, *more]
    return stage(matched_advertised(spark, sf_dir).select(*columns))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return area_property_count(t.parcels(spark, sf_dir))


def q_area_property_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spark, sf_dir)


def q_area_year_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return area_year_grid(counts(spark, sf_dir).select("area", "type"), t.sale_index(spark))


def q_area_list_year_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return area_year_grid(counts(spark, sf_dir).select("area", "type"), [t.LIST_YEAR])


def advertised_by_area(
    spark: SparkSession, sf_dir: str, area_types: list[str], keep_unmatched: bool = False
) -> DataFrame:
    summary = summarise_advertised(
        staged_advertised(spark, sf_dir),
        counts(spark, sf_dir),
        t.LIST_YEAR,
        area_types,
        keep_unmatched,
    )
    return _rounded(summary, 3, "median_lien_amount", "median_assessed_value")


def results_by_area_year(
    spark: SparkSession, sf_dir: str, area_types: list[str], repaired: bool = False, sketched: bool = False
) -> DataFrame:
    """repaired adds the winning-bid measures and keeps results without an area; sketched takes medians from sketches."""
    summary = summarise_by_area(
        staged_results(spark, sf_dir),
        counts(spark, sf_dir),
        t.sale_index(spark),
        area_types,
        t.PRE_YEAR,
        t.SNAPSHOT_YEAR,
        bid_measures=repaired,
        keep_unmatched=repaired,
        sketched=sketched,
    )
    extra = ["median_winning_bid"] if repaired else []
    return _rounded(summary, 3, "median_lien_amount", "median_assessed_value", *extra)


def q_results_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_history(t.raw_history(spark, sf_dir))


def q_latest_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_latest(t.raw_latest(spark, sf_dir))


def q_advertised_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = type_advertised(t.raw_list(spark, sf_dir), t.LIST_YEAR)
    second = type_advertised(t.raw_list_update(spark, sf_dir), t.LIST_YEAR, ADVERTISED_UPDATE_NAMES)
    return first.unionByName(second)


def q_account_to_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = t.read(spark, sf_dir, "customer").selectExpr(
        "c_custkey", f"{t.account_number('c_custkey')} as account_number"
    )
    parts = {"block": account_block("account_number"), "lot": account_lot("account_number")}
    return with_sql(with_sql(accounts, parts), {"pin": "concat(block, lot)"})


def q_results_with_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = with_auction_index(type_history(t.raw_history(spark, sf_dir)), t.sale_index(spark))
    return typed.select(
        "adv_number", "tax_year", "auction_year", "auction_type", "auction_label", "auction_date"
    )


def _shown(matched: DataFrame, *keys: str) -> DataFrame:
    return matched.selectExpr(*keys, *SHOWN_FACT, *SHOWN_PARCEL, *CENTRE)


def q_results_matched_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(matched_history(spark, sf_dir), "pin", "block", "lot")


def q_results_latest_matched_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(matched_latest(spark, sf_dir), *LATEST_KEYS)


def q_advertised_matched_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_advertised(spark, sf_dir).select(
        *PROPERTY_KEYS,
        "adv_number",
        "line_number",
        "lien_amount",
        "assessment",
        "occupied",
        "vacind",
        "no_imprv",
        *SHOWN_PARCEL,
    )


def q_results_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_results(spark, sf_dir).select(
        *SHOWN_FACT,
        "tax_year",
        "removed_because",
        "removed_date",
        "winning_bidder_name",
        "assessed_value",
        "winning_bid",
        "num_bids",
        "homestead",
        "owner_occupied",
        "vacind",
        *SHOWN_PARCEL,
    )


def q_bidder_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = bidder_summary(staged_results(spark, sf_dir), t.SNAPSHOT_YEAR)
    return _rounded(summary, 3, "median_winning_bid")


def q_match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = match_quality(staged_advertised(spark, sf_dir, "objectid"))
    return _rounded(quality, 3, "median_assessment", "median_lien_amount")


def q_area_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = staged_advertised(spark, sf_dir, "objectid")
    return area_report(match_quality(matched))


def q_match_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies, results = t.parcels_with_copies(spark, sf_dir), t.results(spark, sf_dir)
    audits = {
        "history": match_audit(t.history(results), copies, ["pin"], ["pin", "auction_year"]),
        "latest": match_audit(t.latest(results), copies, LATEST_KEYS, ["adv_number"]),
        "advertised": match_audit(
            t.advertised(spark, sf_dir), t.parcels(spark, sf_dir), PROPERTY_KEYS, PROPERTY_KEYS
        ),
    }
    named = [audit.selectExpr("*", f"'{name}' as match") for name, audit in audits.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


def q_removed_after_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_after_deadline(matched_results(spark, sf_dir), list(AREAS.values()))


def q_choropleth_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = advertised_by_area(spark, sf_dir, ["council_district"])
    return with_centroid(choropleth_layer(t.boundaries(spark, sf_dir), summary))


def _lien_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = homeowner_lien_bins(staged_advertised(spark, sf_dir, *PROPERTY_KEYS, "x", "y"))
    return _rounded(binned, 6, "lien_bin_low", "lien_bin_high")


def q_lien_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lien_bins(spark, sf_dir).selectExpr(
        *PROPERTY_KEYS, "lien_amount", "lien_bin", "lien_bin_low", "lien_bin_high", *CENTRE
    )


def q_lien_bin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lien_bin_counts(_lien_bins(spark, sf_dir))


def q_district_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["MACHINERY", "BUILDING", "HOUSEHOLD"]
    return district_report(matched_latest(spark, sf_dir), t.SNAPSHOT_YEAR, order=order)


def q_unknown_area_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unknown_area_loss(matched_advertised(spark, sf_dir))


def q_parcel_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_centroid(t.parcels(spark, sf_dir)).selectExpr("objectid", *CENTRE)


def q_reproject_lcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = with_sql(t.degrees(spark, sf_dir), {"point": EPSG_2804.forward("lon", "lat")})
    return points.selectExpr("objectid", "round(point.x, 3) as x", "round(point.y, 3) as y")


def q_files_history_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly files of three layouts, found by name, stacked and typed."""
    layouts = find_layouts(spark, raw_files.write_history(spark, sf_dir), "_sale_", excludes="report", glob="*.csv")
    raw = read_checked_csvs(spark, layouts, multi_line=False).rows
    return type_history(raw.withColumn("path", F.col(f"{FILE_ORDER}.path"))).drop(FILE_ORDER)


def q_files_with_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index read from its file, joined to the results read from theirs."""
    index = read_auction_index(spark, raw_files.write_index(spark))
    typed = with_auction_index(q_files_history_typed(spark, sf_dir), index)
    return typed.select(
        "adv_number", "tax_year", "auction_year", "auction_type", "auction_label", "auction_date"
    )


def q_files_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each property and year, in the order of files and lines."""
    paths = find_files(spark, raw_files.write_history(spark, sf_dir), "_sale_")
    typed = type_history(read_text_csvs(spark, paths, with_order=True))
    first = keep_first(typed, ["pin", "auction_year"], [nulls_last(FILE_ORDER)])
    return first.select("pin", "auction_year", "auction_type", "adv_number")


def q_files_ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file the rows that fit its header and those that don't."""
    layouts = find_layouts(spark, raw_files.write_ragged(spark, sf_dir))
    read = read_checked_csvs(spark, layouts, multi_line=False)
    file = f"substring_index({FILE_ORDER}.path, '/', -1) as file"
    fitting = read.rows.selectExpr(file, "bigint(number) as number", "0L as misfits", "0L as misfit_length")
    misfits = read.rejected.selectExpr(file, "null as number", "1L as misfits", "bigint(length(record)) as misfit_length")
    return aggregate_sql(
        fitting.unionByName(misfits),
        ["file"],
        {
            "rows_typed": "count(number)",
            "rows_rejected": "sum(misfits)",
            "sum_number": "sum(number)",
            "rejected_length": "sum(misfit_length)",
        },
    )


def q_files_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a summary file, numbered as they stand in it."""
    orders, nation, customer = (t.read(spark, sf_dir, n) for n in ("orders", "nation", "customer"))
    owned = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    named = owned.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    summary = aggregate_sql(
        named.withColumnRenamed("n_name", "area"),
        ["area"],
        {
            "num_sold": "count_if(o_orderstatus = 'O')",
            "sum_lien_amount": money_sum("o_totalprice"),
            "half_smallest": "if(area = 'NATION_4', null, min(o_totalprice) / 2)",
            "perc_sold": pct("count_if(o_orderstatus = 'O')", "count(*)"),
            "thousands": "count(*) * 1000D",
        },
    )
    path = f"{raw_files.new_folder(spark)}/published"
    write_summary_csv(summary, path, [F.expr("collate(area, 'UNICODE')").asc_nulls_last()])
    lines = spark.read.text(path).selectExpr("value as line", "monotonically_increasing_id() as row")
    # The file has one line per area, so a window over all of it is small.
    return lines.selectExpr("row_number() over (order by row) as number", "line")


def q_table_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table stored by year, written twice, read back."""
    path = f"{raw_files.new_folder(spark)}/results"
    for _ in range(2):
        save_table(t.results(spark, sf_dir), path, ["auction_year"])
    stored = load_table(spark, path)
    measures = {"num_rows": "count(*)", "num_numbers": "count(distinct adv_number)", "sum_lien_amount": money_sum("lien_amount")}
    return aggregate_sql(stored, ["auction_year"], measures)


def q_table_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored parcel layer with its columns selected, and its centroids."""
    path = f"{raw_files.new_folder(spark)}/parcels"
    save_table(t.parcels(spark, sf_dir).withColumn("unused", F.lit(1)), path)
    return with_centroid(read_parcels(spark, path)).selectExpr("objectid", "pin", "ward", "neighborhood", *CENTRE)


def q_table_parcels_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels with shapes in well-known binary, decoded once, and their centroids."""
    parcels = stage(read_parcels(spark, raw_files.write_parcels_binary(spark, sf_dir)))
    return with_centroid(parcels).selectExpr("objectid", "geometry_status", *CENTRE)


def q_table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list exported from a workbook, with typed cells, as text, then typed as a release."""
    path = f"{raw_files.new_folder(spark)}/list"
    listed = t.raw_list(spark, sf_dir).withColumn("Seq", F.expr("bigint(Seq)"))
    save_table(listed, path)
    return type_advertised(read_text_table(spark, path), t.LIST_YEAR)


def q_bidder_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: distinct bidders per area over all years, merged from stored sketches per area and year."""
    path = f"{raw_files.new_folder(spark)}/sketches"
    results = by_area(matched_results(spark, sf_dir), list(AREAS.values()), ["auction_year", "winning_bidder_name"])
    columns = ["winning_bidder_name"]
    save_table(distinct_sketches(results, ["type", "area", "auction_year"], columns), path, ["auction_year"])
    merged = merge_sketches(load_table(spark, path), ["type", "area"], columns)
    return distinct_counts(merged, ["type", "area"], columns)


def q_exact_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of eighths and of numbers near 1e17 that cancel, in any order."""
    large = "if(l_linenumber % 2 = 0, -1, 1) * (1e17D + l_orderkey % 1000 * 16)"
    value = f"case when l_orderkey % 50 = 3 then {large} else (l_orderkey * 7 + l_partkey) / 8D end"
    lines = t.read(spark, sf_dir, "lineitem").selectExpr("l_returnflag", f"{value} as value")
    return aggregate_sql(lines, ["l_returnflag"], {"exact": exact_sum("value"), "num_values": "count(value)"})


def q_reproject_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees to metres and back, as lines of two points."""
    here = t.degrees(spark, sf_dir).selectExpr(
        "objectid", "array(named_struct('x', lon, 'y', lat), named_struct('x', lon + 0.5D, 'y', lat - 0.25D)) as line"
    )
    there = here.selectExpr("objectid", f"{EPSG_2804.forward_all('line', here.schema['line'].dataType.simpleString())} as line")
    back = there.selectExpr("objectid", f"{over_points('line', 1, EPSG_2804.inverse)} as line")
    ends = [f"round(line[{i}].{c}, 9) as {c}{i}" for i in (0, 1) for c in "xy"]
    return back.selectExpr("objectid", *ends)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {name[2:]: fn for name, fn in globals().items() if name.startswith("q_")}
    for label, area in AREAS.items():
        named[f"advertised_by_area_{label}"] = partial(advertised_by_area, area_types=[area])
        named[f"results_by_area_year_{label}"] = partial(results_by_area_year, area_types=[area])
    every = list(AREAS.values())
    named["advertised_by_area_all"] = partial(advertised_by_area, area_types=every)
    named["advertised_by_area_all_repaired"] = partial(advertised_by_area, area_types=every, keep_unmatched=True)
    named["results_by_area_year_all"] = partial(results_by_area_year, area_types=every)
    named["results_by_area_year_all_repaired"] = partial(results_by_area_year, area_types=every, repaired=True)
    named["results_by_area_year_sketched"] = partial(results_by_area_year, area_types=every, repaired=True, sketched=True)
    return named
