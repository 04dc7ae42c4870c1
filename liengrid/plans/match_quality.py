"""Match quality and property values of an advertised list, per area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liengrid.functions.nulls import strict
from liengrid.functions.numbers import money_mean, money_sum, pct, to_cents, to_double
from liengrid.operators.columns import aggregate_sql, names_sql, select_sql, with_sql
from liengrid.operators.grid import by_area
from liengrid.operators.matching import left_match
from liengrid.operators.quantiles import grouped_medians
from liengrid.plans.area_summary import IS_HOMEOWNER

# The order of the stacked blocks and the label of each.
TYPE_LABELS = {"council_district": "council district", "csa": "csa", "neighborhood": "neighborhood"}
VALUES = ("assessment", "lien_amount")


def match_quality(advertised: DataFrame) -> DataFrame:
    """One row per area of each type; rows without an area keep a null name.

    advertised is the list matched to parcels.
    """
    text = [c for c, kind in advertised.dtypes if c in VALUES and kind == "string"]
    numbers = with_sql(advertised, {c: to_double(c) for c in text}) if text else advertised
    facts = by_area(numbers, list(TYPE_LABELS), ["objectid", *VALUES, "vacind", "no_imprv", "occupied"])
    keys = ["type", "area"]
    totals = aggregate_sql(
        facts,
        keys,
        {
            "num_properties": "count(*)",
            "num_matched": "count(objectid)",
            "num_unmatched": "count_if(objectid is null)",
            "num_vacant": "count_if(vacind = 'Y')",
            "num_vacant_lot": "count_if(no_imprv = 'Y')",
            "num_owner_occupied": f"count_if({IS_HOMEOWNER})",
        }
        | {f"_{c}s": f"count({c})" for c in VALUES}
        | {f"mean_{c}": strict(money_mean(c), c) for c in VALUES}
        | {f"sum_{c}": strict(money_sum(c), c) for c in VALUES},
    )
    medians = grouped_medians(facts, keys, {f"median_{c}": c for c in VALUES})
    labels = " ".join(f"when '{name}' then '{label}'" for name, label in TYPE_LABELS.items())
    columns = {
        "area_name": "area",
        **names_sql("num_properties", "num_matched", "num_unmatched"),
        "perc_unmatched": pct("num_unmatched", "num_properties"),
        "perc_matched": pct("num_matched", "num_properties"),
    }
    for c in VALUES:
        columns |= names_sql(f"mean_{c}")
        columns[f"median_{c}"] = f"if(_{c}s = num_properties, median_{c}, null)"
        columns |= names_sql(f"sum_{c}")
    columns |= {
        "num_vacant": "num_vacant",
        "perc_vacant": pct("num_vacant", "num_matched"),
        "num_vacant_lot": "num_vacant_lot",
        "perc_vacant_lot": pct("num_vacant_lot", "num_matched"),
        "num_owner_occupied": "num_owner_occupied",
        "perc_owner_occupied": pct("num_owner_occupied", "num_properties"),
        "type": f"case type {labels} end",
    }
    return select_sql(left_match(totals, medians, keys), columns)


def drop_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """Drops the columns from first to last, as they stand in the table."""
    names = df.columns
    return df.drop(*names[names.index(first) : names.index(last) + 1])


def _printed(name: str) -> str:
    if name.startswith(("mean_", "median_", "sum_")):
        cents = to_cents(name)
        return f"concat(if({cents} < 0, '-$', '$'), format_number(abs({cents}), 2))"
    if name.startswith("perc_"):
        return f"concat(format_number({name}, 2), '%')"
    return name


def area_report(summary: DataFrame) -> DataFrame:
    """R2: the match-quality table as printed, money and shares as text, by type and area."""
    table = drop_range(summary, "num_matched", "perc_matched")
    printed = select_sql(table, {name: _printed(name) for name in table.columns})
    return printed.orderBy(*report_order())


def report_order() -> list[Column]:
    """By area type, then name by locale rules."""
    return [F.col("type"), F.expr("collate(area_name, 'UNICODE')").asc_nulls_last()]
