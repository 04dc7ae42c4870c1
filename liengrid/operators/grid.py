"""Area counts and the complete area x year grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liengrid.operators.columns import aggregate_sql

AREA_TYPES = ("neighborhood", "csa", "council_district")
UNKNOWN = "Unknown"


def by_area(df: DataFrame, area_types: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per input row and area type, with the columns type and area."""
    return df.unpivot(list(columns), list(area_types), "type", "area")


def area_property_count(parcels: DataFrame, area_types: Sequence[str] = AREA_TYPES) -> DataFrame:
    """A1: parcels per area for every area type, parcels without an area as Unknown."""
    counts = aggregate_sql(by_area(parcels, area_types, []), ["area", "type"], {"num_properties": "count(*)"})
    return counts.selectExpr(f"coalesce(area, '{UNKNOWN}') as area", "num_properties", "type")


def area_year_grid(areas: DataFrame, years: DataFrame | Sequence[int]) -> DataFrame:
    """Every row of areas for every year.

    years is a list, or an auction index whose distinct auction_year values are used.
    They become one array value, so no cross join is needed.
    """
    if isinstance(years, DataFrame):
        listed = years.agg(F.expr("sort_array(collect_set(auction_year)) as _years")).scalar()
    else:
        listed = F.expr(f"array({', '.join(str(int(year)) for year in years)})")
    return areas.withColumn("_years", listed).selectExpr("* except (_years)", "explode(_years) as auction_year")
