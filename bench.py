"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the local cores. Each query runs once to
warm up and then BENCH_RUNS times; the best time counts. A time covers building the plan,
staged tables included, and writing every result row to a sink that drops it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
# Python workers inherit it, wherever the bench is started.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from liengrid.operators.grid import by_area  # noqa: E402
from liengrid.operators.quantiles import grouped_medians  # noqa: E402
from liengrid.plans.area_summary import CELL, summarise_by_area  # noqa: E402
from workload import queries as registered  # noqa: E402
from workload import tables as t  # noqa: E402

HEADLINE = [
    "account_to_pin",
    "advertised_by_area_all",
    "advertised_matched_first",
    "advertised_typed",
    "area_property_count",
    "area_year_grid",
    "bidder_summary",
    "district_report",
    "lien_bins",
    "match_audit",
    "match_quality",
    "parcel_centroid",
    "reproject_lcc",
    "results_by_area_year_all",
    "results_latest_matched_first",
    "results_matched_first",
    "results_typed",
    "results_union",
    "results_with_index",
]

# Timed and listed beside them, but not part of the total, which stays comparable.
MORE = [
    "bidder_sketches",
    "exact_sums",
    "files_first_rows",
    "files_history_typed",
    "files_ragged_rows",
    "removed_after_deadline",
    "reproject_back",
    "results_by_area_year_sketched",
    "table_parcels_binary",
    "table_years",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("liengrid-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def best_time(query, runs: int) -> float:
    times = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        query().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return round(min(times[1:]), 3)


def variants(spark: SparkSession, sf_dir: str) -> dict[str, partial]:
    """The same results by different plans, all from one staged table."""
    results = registered.staged_results(spark, sf_dir)
    counts = registered.counts(spark, sf_dir)
    areas = list(registered.AREAS.values())
    index = t.sale_index(spark)

    def summary(area_types: list[str], accuracy: int | None = None) -> DataFrame:
        return summarise_by_area(
            results, counts, index, area_types, t.PRE_YEAR, t.SNAPSHOT_YEAR, median_accuracy=accuracy
        )

    def separate() -> DataFrame:
        parts = [summary([area]) for area in areas]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    cells = by_area(results, areas, ["auction_year", "lien_amount", "assessed_value"])
    columns = {"a": "lien_amount", "b": "assessed_value"}
    return {
        "three area types in one plan": partial(summary, areas),
        "three plans, one per area type": separate,
        "approximate medians": partial(summary, areas, 10_000),
        "medians by buckets": partial(grouped_medians, cells, CELL, columns),
        "medians by the built-in aggregate": lambda: cells.groupBy(*CELL).agg(
            F.median("lien_amount"), F.median("assessed_value")
        ),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    if "--variants" in sys.argv:
        timed = variants(spark, sf_dir)
    else:
        every = registered.queries()
        timed = {name: partial(every[name], spark, sf_dir) for name in [*HEADLINE, *MORE]}
    times = {name: best_time(query, runs) for name, query in timed.items()}
    print(
        json.dumps(
            {
                "metric": "headline queries, best warm run, total",
                "value": round(sum(time for name, time in times.items() if name not in MORE), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
