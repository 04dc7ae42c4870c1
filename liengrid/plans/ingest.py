"""Raw text tables to typed tables (one function per source release)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from liengrid.functions.nulls import blank_to_null, yes_no
from liengrid.functions.numbers import to_date, to_double, to_int
from liengrid.functions.text import account_block, account_lot, snake_names, title_case
from liengrid.operators.columns import select_sql, with_sql
from liengrid.operators.matching import left_match

INDEX_KEYS = ["tax_year", "auction_year", "auction_type"]
DATE_FORMATS = ("M/d/yyyy",)

# Header names of each release and the names used here.
HISTORY_NAMES = {
    "removed_time_stamp": "removed_date",
    "face_amount": "lien_amount",
    "winning_premium": "winning_bid_premium",
    "winning_bidder": "winning_bidder_number",
    "winning_amount_due": "winning_bidder_amt_due",
}
LATEST_NAMES = {"batch": "batch_number", "adv_no": "adv_number", "cert_no": "certificate_number"}
ADVERTISED_NAMES = {"address": "street_name", "seq": "adv_number"}
ADVERTISED_UPDATE_NAMES = {
    "address": "street_name",
    "assessed_value": "assessment",
    "lien": "lien_amount",
    "blk": "block",
    "wd": "ward",
    "sec": "section",
}


def clean_raw(raw: DataFrame, names: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """snake_case headers, release names, blanks as null; keep and what is no text are left as they are.

    Columns that are cast later need no cleaning: the casts take blanks and NA as null.
    Leaving them out keeps the code Spark generates for a whole table short enough for
    the JVM to compile.
    """
    headers = [names.get(header, header) for header in snake_names(raw.columns)]
    named = raw.toDF(*headers)
    cleaned = {c: f"`{c}`" if c in keep or kind != "string" else blank_to_null(f"`{c}`") for c, kind in named.dtypes}
    return select_sql(named, cleaned)


def _casts(integers: Sequence[str], doubles: Sequence[str]) -> dict[str, str]:
    return {c: to_int(c) for c in integers} | {c: to_double(c) for c in doubles}


def _removal(formats: Sequence[str]) -> dict[str, str]:
    """X8, X9, X3."""
    return {
        "removed_because": title_case("removed_because"),
        "removed": "if(removed_because is not null, 'Y', 'N')",
        "removed_date": to_date("removed_date", formats),
    }


def type_history(
    raw: DataFrame,
    path: str = "path",
    date_formats: Sequence[str] = DATE_FORMATS,
    keep_path: bool = False,
) -> DataFrame:
    """P7 for the yearly result files; the sale type comes from the source path.

    keep_path leaves the path in, as the first part of the row order for match_history.
    """
    block, lot = account_block("account_number"), account_lot("account_number")
    typed = _casts(
        ["adv_number", "tax_year", "num_ties", "num_bids"],
        ["winning_bid", "winning_bid_premium", "winning_bidder_amt_due", "lien_amount", "assessed_value"],
    )
    derived = {
        "block": block,
        "lot": lot,
        "pin": f"concat({block}, {lot})",
        "homestead": yes_no("homestead = '1'"),
        "auction_year": f"{typed['tax_year']} + 1",
        "auction_type": f"""case when substring_index(`{path}`, '/', -1) like '%assignment%' then 'assignment_sale'
            when substring_index(`{path}`, '/', -1) like '%certificate%' then 'certificate_sale' end""",
    }
    text = clean_raw(raw, HISTORY_NAMES, keep=[path, "removed_date", *typed])
    results = with_sql(text, typed | _removal(date_formats) | derived)
    return results if keep_path else results.drop(path)


def type_latest(raw: DataFrame, date_formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """P7 for the single certificate sale report of the latest year."""
    typed = _casts(
        ["adv_number", "tax_year"],
        ["lien_amount", "assessed_value", "winning_bid", "winning_bid_premium", "winning_bidder_amt_due"],
    )
    derived = {"auction_type": "'certificate_sale'", "auction_year": f"{typed['tax_year']} + 1"}
    text = clean_raw(raw, LATEST_NAMES, keep=["removed_date", *typed])
    return with_sql(text, typed | _removal(date_formats) | derived)


def type_advertised(
    raw: DataFrame, auction_year: int, names: dict[str, str] = ADVERTISED_NAMES
) -> DataFrame:
    """P7 for a list of advertised properties; a list without numbers gets null ones."""
    typed = _casts(["adv_number"], ["assessment", "lien_amount"])
    text = clean_raw(raw, names, keep=list(typed))
    if "adv_number" not in text.columns:
        typed["adv_number"] = "cast(null as int)"
    return with_sql(text, typed | {"tax_year": str(auction_year - 1), "auction_year": str(auction_year)})


def with_auction_index(results: DataFrame, index: DataFrame) -> DataFrame:
    """Label and date of each sale."""
    return left_match(results, index, INDEX_KEYS)
