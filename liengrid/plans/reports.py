"""District report, map layers and lien bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liengrid.functions.nulls import literal
from liengrid.functions.numbers import pct
from liengrid.operators.binning import equal_count_bins
from liengrid.operators.columns import aggregate_sql, select_sql, with_sql
from liengrid.operators.grid import by_area
from liengrid.operators.matching import left_match
from liengrid.plans.area_summary import IS_HOMEOWNER, occupancy_measures

DISTRICT_ORDER = [f"District {number}" for number in range(1, 15)]

# Printed column labels of the district report.
DISTRICT_LABELS = {
    "id": "Council district",
    "num_properties": "Properties listed for sale",
    "removed_properties": "Properties removed before auction",
    "scheduled_properties": "Properties scheduled for auction",
    "perc_removed": "Properties removed before auction (% of total)",
    "properties_removed_after_original_deadline": "Properties removed after original April 30 deadline",
    "num_owner_occupied": "Owner-occupied properties listed",
    "num_owner_occupied_removed": "Owner-occupied properties removed before auction",
    "perc_owner_occupied": "Owner-occupied properties (% of total listed)",
    "perc_owner_occupied_removed": "Owner-occupied properties removed (% of total owner-occupied)",
}
MAP_MEASURES = ["num_advertised", "num_owner_occupied_not_vacant", "perc_properties_area"]


def removed_after(month: int, day: int) -> str:
    """Rows removed after the deadline of their auction year."""
    return f"count_if(removed = 'Y' and removed_date > make_date(auction_year, {month}, {day}))"


def removed_after_deadline(
    results: DataFrame, area_types: Sequence[str], month: int = 4, day: int = 30
) -> DataFrame:
    """A17 for every area and year that occurs."""
    facts = by_area(results, area_types, ["auction_year", "removed", "removed_date"])
    measures = {"num_advertised": "count(*)", "num_removed_after_deadline": removed_after(month, day)}
    return aggregate_sql(facts, ["type", "area", "auction_year"], measures)


def district_report(
    results: DataFrame,
    snapshot_year: int = 2020,
    area: str = "council_district",
    order: Sequence[str] = DISTRICT_ORDER,
    deadline: tuple[int, int] = (4, 30),
    labels: bool = False,
) -> DataFrame:
    """Removal and owner-occupancy by district in the snapshot year.

    Listed districts come first in the given order, others after them by name.
    """
    occupancy = occupancy_measures(snapshot_year)
    table = aggregate_sql(
        results.where(f"auction_year = {snapshot_year}").withColumnRenamed(area, "id"),
        ["id"],
        {
            "num_properties": "count(*)",
            "removed_properties": "count_if(removed = 'Y')",
            "scheduled_properties": "count_if(removed = 'N')",
            "properties_removed_after_original_deadline": removed_after(*deadline),
            "num_owner_occupied": occupancy["num_owner_occupied"],
            "num_owner_occupied_removed": occupancy["num_owner_occupied_removed"],
        },
    )
    shares = {
        "perc_removed": pct("removed_properties", "num_properties"),
        "perc_owner_occupied": pct("num_owner_occupied", "num_properties"),
        "perc_owner_occupied_removed": pct("num_owner_occupied_removed", "num_owner_occupied"),
    }
    ordered = with_sql(table, shares).orderBy(*district_order("id", order))
    return select_sql(ordered, {label if labels else name: name for name, label in DISTRICT_LABELS.items()})


def district_order(name: str, order: Sequence[str]) -> list[Column]:
    """Listed districts in the given order, then the others by the number in their name and the name."""
    listed = ", ".join(literal(district) for district in order)
    place = F.expr(f"nullif(array_position(array({listed}), `{name}`), 0)").asc_nulls_last()
    number = F.expr(f"try_cast(regexp_extract(`{name}`, '[0-9]+', 0) as int)").asc_nulls_last()
    return [place, number, F.expr(f"collate(`{name}`, 'UNICODE')").asc_nulls_last()]


def choropleth_layer(
    boundaries: DataFrame, summary: DataFrame, measures: Sequence[str] = MAP_MEASURES
) -> DataFrame:
    """Every boundary with the measures of the area of the same name."""
    named = summary.select(F.col("area").alias("name"), *measures)
    return left_match(boundaries, named, ["name"])


def homeowner_lien_bins(advertised: DataFrame, bins: int = 5) -> DataFrame:
    """B2: occupied, improved, not vacant homes of owners, binned by lien in thousands."""
    homes = advertised.where(f"{IS_HOMEOWNER} and vacind = 'N' and no_imprv = 'N'")
    in_thousands = with_sql(homes, {"lien_thousands": "lien_amount / 1000"})
    return equal_count_bins(in_thousands, "lien_thousands", bins, "lien_bin")


def lien_bin_counts(binned: DataFrame) -> DataFrame:
    """Rows per bin."""
    return aggregate_sql(binned, ["lien_bin", "lien_bin_low", "lien_bin_high"], {"num_properties": "count(*)"})
