"""Summary of winning bidders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liengrid.functions.numbers import money_mean, money_sum, pct
from liengrid.operators.columns import aggregate_sql, names_sql, select_sql
from liengrid.operators.matching import left_match
from liengrid.operators.quantiles import grouped_medians

BIDDER = ["auction_year", "winning_bidder_name"]


def bidder_summary(results: DataFrame, snapshot_year: int = 2020) -> DataFrame:
    """Bids won per year and bidder, before the snapshot year."""
    won = results.where(
        f"auction_year <> {snapshot_year} and removed = 'N' and winning_bidder_name is not null"
    ).select(*BIDDER, "homestead", "winning_bid")
    totals = aggregate_sql(
        won,
        BIDDER,
        {
            "num_bids_won": "count(*)",
            "num_homestead": "count_if(homestead = 'Y')",
            "mean_winning_bid": money_mean("winning_bid"),
            "sum_winning_bid_amount": f"coalesce({money_sum('winning_bid')}, 0D)",
        },
    )
    medians = grouped_medians(won, BIDDER, {"median_winning_bid": "winning_bid"})
    summary = select_sql(
        left_match(totals, medians, BIDDER),
        names_sql(
            *BIDDER,
            "num_bids_won",
            "num_homestead",
            "mean_winning_bid",
            "median_winning_bid",
            "sum_winning_bid_amount",
        )
        | {"perc_homestead_properties": pct("num_homestead", "num_bids_won")},
    )
    return summary.orderBy(*bidder_order())


def bidder_order() -> list[Column]:
    """O3: by year, the most bids won first."""
    return [F.col("auction_year"), F.desc("num_bids_won"), F.col("winning_bidder_name")]
