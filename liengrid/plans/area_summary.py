"""Summaries on the complete area x year grid.

One pass groups the rows of all requested area types together and computes every
measure of a cell, including the homestead and the occupancy measures that only apply
to some years. Exact medians come from a second, narrow pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liengrid.functions.nulls import count_distinct_with_null, is_one_of, literal, strict, strict_count_if
from liengrid.functions.numbers import money_mean, money_sum, pct, to_cents
from liengrid.operators.columns import aggregate_sql, with_sql
from liengrid.operators.grid import AREA_TYPES, UNKNOWN, area_year_grid, by_area
from liengrid.operators.quantiles import bracketed_medians, grouped_medians, sketch_measures
from liengrid.sources.tables import stage

CELL = ["type", "area", "auction_year"]

# The column order of the two summaries.
AREA_YEAR_COLUMNS = [
    "area",
    "type",
    "num_properties",
    "perc_properties_area",
    "perc_properties_sold_area",
    "auction_year",
    "num_advertised",
    "num_removed",
    "num_scheduled",
    "num_sold",
    "sum_lien_amount",
    "median_lien_amount",
    "median_assessed_value",
    "num_winning_bidders",
    "mean_num_bids",
    "perc_removed",
    "num_advertised_homestead",
    "num_scheduled_homestead",
    "perc_scheduled_homestead",
    "num_owner_occupied",
    "num_owner_occupied_removed",
    "num_vacant",
    "perc_owner_occupied",
    "perc_owner_occupied_removed",
    "perc_vacant",
]
# What the summaries read besides the area columns; a matched table can be cut to these.
RESULT_INPUTS = [
    "auction_year",
    "removed",
    "winning_bidder_name",
    "lien_amount",
    "assessed_value",
    "winning_bid",
    "num_bids",
    "homestead",
    "owner_occupied",
    "vacind",
]
ADVERTISED_INPUTS = ["lien_amount", "assessment", "vacind", "no_imprv", "occupied"]
BID_COLUMNS = ["sum_winning_bids", "mean_winning_bid", "median_winning_bid"]
ADVERTISED_COLUMNS = [
    "area",
    "type",
    "num_properties",
    "perc_properties_area",
    "num_advertised",
    "sum_lien_amount",
    "median_lien_amount",
    "median_assessed_value",
    "num_vacant",
    "num_vacant_lot",
    "num_owner_occupied",
    "num_owner_occupied_not_vacant",
    "perc_vacant",
    "perc_owner_occupied_not_vacant",
    "perc_vacant_lot",
    "auction_year",
]


IS_HOMEOWNER = is_one_of("occupied", ("D", "H"))


def auction_measures(distinct_error: float | None = None) -> dict[str, str]:
    """A11 without medians and shares; distinct_error switches to an approximate bidder count."""
    bidders = count_distinct_with_null("winning_bidder_name", distinct_error)
    return {
        "num_advertised": "count(*)",
        "num_removed": "count_if(removed = 'Y')",
        "num_scheduled": "count_if(removed = 'N')",
        "num_sold": "count(winning_bidder_name)",
        "sum_lien_amount": strict(money_sum("lien_amount"), "lien_amount"),
        "_lien_amounts": "count(lien_amount)",
        "_assessed_values": "count(assessed_value)",
        "num_winning_bidders": bidders,
        "mean_num_bids": "bround(avg(num_bids), 2)",
    }


def homestead_measures(snapshot_year: int) -> dict[str, str]:
    """Rows of earlier years with a homestead; null where a cell has none."""
    rows = f"homestead = 'Y' and auction_year <> {snapshot_year}"
    return {
        "num_advertised_homestead": f"nullif(count_if({rows}), 0)",
        "num_scheduled_homestead": f"if(count_if({rows}) > 0, count_if({rows} and removed = 'N'), null)",
    }


def occupancy_measures(snapshot_year: int) -> dict[str, str]:
    """Rows of the snapshot year only, the one the parcel attributes describe."""
    current = f"auction_year = {snapshot_year}"
    counts = {
        "num_owner_occupied": "owner_occupied = '1'",
        "num_owner_occupied_removed": "owner_occupied = '1' and removed = 'Y'",
        "num_vacant": "vacind = 'Y'",
    }
    return {
        name: f"if(count_if({current}) > 0, count_if({current} and {rows}), null)"
        for name, rows in counts.items()
    }


def winning_bid_measures() -> dict[str, str]:
    """Winning bids per cell, null bids skipped."""
    return {
        "sum_winning_bids": f"coalesce({money_sum('winning_bid')}, 0D)",
        "mean_winning_bid": f"cast({to_cents(money_mean('winning_bid'))} as double)",
    }


def area_year_cells(
    results: DataFrame,
    area_types: Sequence[str],
    pre_year: int,
    snapshot_year: int,
    bid_measures: bool = False,
    keep_unmatched: bool = False,
    median_accuracy: int | None = None,
    distinct_error: float | None = None,
    grid: DataFrame | None = None,
    sketched: bool = False,
) -> DataFrame:
    """One row per area type, area and year that occurs.

    Medians are computed for the cells of grid only, if one is given.
    median_accuracy switches to approximate medians with that accuracy, distinct_error
    to an approximate number of bidders with that relative error. sketched takes sketches in the
    same pass as the sums and finds the exact medians near their ranks in one more: the facts are
    read twice, and the cells are stored in between.
    """
    medians = {"median_lien_amount": "lien_amount", "median_assessed_value": "assessed_value"}
    if bid_measures:
        medians["median_winning_bid"] = "winning_bid"
    facts = by_area(results, area_types, [c for c in RESULT_INPUTS if bid_measures or c != "winning_bid"])
    if keep_unmatched:
        facts = facts.fillna({"area": UNKNOWN})

    measures = auction_measures(distinct_error) | homestead_measures(snapshot_year) | occupancy_measures(snapshot_year)
    if bid_measures:
        measures |= winning_bid_measures()
    if median_accuracy:
        measures |= {name: f"percentile_approx({c}, 0.5, {median_accuracy})" for name, c in medians.items()}

    by_sketch = sketched and not median_accuracy
    if by_sketch:
        measures |= sketch_measures(list(medians.values()))

    # the homestead measures exist only if the year before the snapshot does.
    on_grid = "area is not null and auction_year is not null"
    cells = (
        aggregate_sql(facts, CELL, measures)
        .selectExpr("*", f"max(auction_year = {pre_year}) over (partition by type) as _has_pre_year")
        .where(on_grid)
    )
    if by_sketch:
        cells = stage(cells)
        on = cells if grid is None else cells.join(grid.select(*CELL), CELL, "left_semi")
        cells = cells.join(bracketed_medians(facts, on, CELL, medians), CELL, "left")
    elif not median_accuracy:
        wanted = facts.where(on_grid)
        if grid is not None:
            wanted = wanted.join(grid.select(*CELL), CELL, "left_semi")
        cells = cells.join(grouped_medians(wanted, CELL, medians), CELL, "left")
    homestead = {name: f"if(_has_pre_year, {name}, null)" for name in homestead_measures(snapshot_year)}
    shares = {
        "perc_removed": pct("num_removed", "num_advertised"),
        "perc_scheduled_homestead": pct(
            homestead["num_scheduled_homestead"], homestead["num_advertised_homestead"]
        ),
        "perc_owner_occupied": pct("num_owner_occupied", "num_advertised"),
        "perc_owner_occupied_removed": pct("num_owner_occupied_removed", "num_owner_occupied"),
        "perc_vacant": pct("num_vacant", "num_advertised"),
    }
    complete = {
        "median_lien_amount": "if(_lien_amounts = num_advertised, median_lien_amount, null)",
        "median_assessed_value": "if(_assessed_values = num_advertised, median_assessed_value, null)",
    }
    return with_sql(cells, homestead | shares | complete)


def _densify(grid: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Every grid cell; only the advertised count is filled with 0."""
    return grid.join(cells, keys, "left").fillna({"num_advertised": 0})


def area_year_order(area: str = "area") -> list[Column]:
    """The published row order: area type, name by locale rules, year."""
    return [F.col("type"), F.expr(f"collate({area}, 'UNICODE')").asc_nulls_last(), F.col("auction_year")]


def sort_by_area_year(summary: DataFrame) -> DataFrame:
    """O2: the rows in the published order."""
    return summary.orderBy(*area_year_order())


def summarise_by_area(
    results: DataFrame,
    counts: DataFrame,
    years: DataFrame | Sequence[int],
    area_types: Sequence[str] = AREA_TYPES,
    pre_year: int = 2019,
    snapshot_year: int = 2020,
    bid_measures: bool = False,
    keep_unmatched: bool = False,
    median_accuracy: int | None = None,
    distinct_error: float | None = None,
    sketched: bool = False,
) -> DataFrame:
    """D3: auction summary on the area x year grid, for one or more area types.

    counts is the area_property_count table. Results without an area are left out, as
    the published tables do (N17), unless keep_unmatched puts them under Unknown.
    """
    grid = area_year_grid(_areas_of(counts, area_types), years)
    cells = area_year_cells(
        results,
        area_types,
        pre_year,
        snapshot_year,
        bid_measures,
        keep_unmatched,
        median_accuracy,
        distinct_error,
        grid,
        sketched,
    )
    dense = with_sql(
        _densify(grid, cells, CELL),
        {
            "perc_properties_area": pct("num_advertised", "num_properties"),
            "perc_properties_sold_area": pct("num_sold", "num_properties"),
        },
    )
    extra = BID_COLUMNS if bid_measures else []
    return sort_by_area_year(dense.select(*AREA_YEAR_COLUMNS, *extra))


def _areas_of(counts: DataFrame, area_types: Sequence[str]) -> DataFrame:
    listed = ", ".join(literal(name) for name in area_types)
    return counts.where(f"type in ({listed})")


def advertised_measures() -> dict[str, str]:
    """A14 without medians and shares."""
    return {
        "num_advertised": "count(*)",
        "sum_lien_amount": f"coalesce({money_sum('lien_amount')}, 0D)",
        "_lien_amounts": "count(lien_amount)",
        "_assessments": "count(assessment)",
        "num_vacant": strict_count_if("vacind = 'Y'"),
        "num_vacant_lot": strict_count_if("no_imprv = 'Y'"),
        "num_owner_occupied": f"count_if({IS_HOMEOWNER})",
        "num_owner_occupied_not_vacant": strict_count_if(f"{IS_HOMEOWNER} and vacind <> 'Y'"),
    }


def summarise_advertised(
    advertised: DataFrame,
    counts: DataFrame,
    auction_year: int = 2021,
    area_types: Sequence[str] = AREA_TYPES,
    keep_unmatched: bool = False,
) -> DataFrame:
    """Summary of an advertised list on the area grid, for one or more area types."""
    keys = ["type", "area"]
    areas = _areas_of(counts, area_types)
    facts = by_area(advertised, area_types, ADVERTISED_INPUTS)
    facts = facts.fillna({"area": UNKNOWN}) if keep_unmatched else facts.where("area is not null")
    medians = grouped_medians(
        facts.join(areas.select(*keys), keys, "left_semi"),
        keys,
        {"median_lien_amount": "lien_amount", "median_assessed_value": "assessment"},
    )
    cells = aggregate_sql(facts, keys, advertised_measures()).join(medians, keys, "left")
    dense = with_sql(
        _densify(area_year_grid(areas, [auction_year]), cells, keys),
        {
            "median_lien_amount": "if(_lien_amounts = num_advertised, median_lien_amount, null)",
            "median_assessed_value": "if(_assessments = num_advertised, median_assessed_value, null)",
            "perc_properties_area": pct("num_advertised", "num_properties"),
            "perc_vacant": pct("num_vacant", "num_advertised"),
            "perc_owner_occupied_not_vacant": pct("num_owner_occupied_not_vacant", "num_advertised"),
            "perc_vacant_lot": pct("num_vacant_lot", "num_advertised"),
        },
    )
    return sort_by_area_year(dense.select(*ADVERTISED_COLUMNS))


def unknown_area_loss(facts: DataFrame, area_types: Sequence[str] = AREA_TYPES) -> DataFrame:
    """Per area type, the rows a summary shows and the rows it leaves out."""
    measures = {"rows_in": "count(*)", "rows_shown": "count(area)", "rows_lost": "count_if(area is null)"}
    return aggregate_sql(by_area(facts, area_types, []), ["type"], measures)
