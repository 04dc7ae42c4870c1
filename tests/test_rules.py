"""One test per missing-value, rounding and text rule."""

from __future__ import annotations

import datetime

import pytest

from liengrid.functions import nulls, numbers, text


@pytest.fixture
def measure(spark):
    def run(sql: str, values: list, kind: str = "int"):
        df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
        return df.selectExpr(sql).first()[0]

    return run


def test_strict_is_null_when_any_input_is_null(measure):
    assert measure(nulls.strict("sum(c)", "c"), [1, 2]) == 3
    assert measure(nulls.strict("sum(c)", "c"), [1, None]) is None


def test_strict_count_if_follows_three_valued_logic(spark):
    rows = [("D", "N"), ("N", None)]
    df = spark.createDataFrame(rows, "occupied string, vacind string")
    condition = nulls.is_one_of("occupied", ["D", "H"]) + " and vacind <> 'Y'"
    assert df.selectExpr(nulls.strict_count_if(condition)).first()[0] == 1
    unknown = spark.createDataFrame([*rows, ("H", None)], df.schema)
    assert unknown.selectExpr(nulls.strict_count_if(condition)).first()[0] is None


def test_count_if_of_nothing_is_zero(measure):
    assert measure("count_if(c > 5)", [1, None]) == 0


def test_null_is_one_distinct_value(measure):
    assert measure(nulls.count_distinct_with_null("c"), [1, 1, None, None, 2]) == 3
    assert measure(nulls.count_distinct_with_null("c"), [1, 1]) == 1
    assert measure(nulls.count_distinct_with_null("c"), [None]) == 1


def test_membership_is_never_null(evaluate):
    assert evaluate(nulls.is_one_of("c", ["D", "H"]), ["D", "X", None]) == [True, False, False]


def test_if_else_keeps_null(evaluate):
    assert evaluate(nulls.yes_no("c = '1'"), ["1", "0", None]) == ["Y", "N", None]


def test_blank_and_na_are_null(evaluate):
    assert evaluate(nulls.blank_to_null("c"), [" a ", "", "  ", "NA", " NA ", "NAB", None]) == [
        "a",
        None,
        None,
        None,
        None,
        "NAB",
        None,
    ]


def test_text_to_numbers(evaluate):
    texts = ["12", " 3.7 ", "-1.5", "abc", "1,000", "12d", "1e3", "", None, "99999999999"]
    assert evaluate(numbers.to_int("c"), texts) == [12, 3, -1, None, None, None, 1000, None, None, None]
    assert evaluate(numbers.to_double("c"), texts)[:7] == [12.0, 3.7, -1.5, None, None, None, 1000.0]


def test_text_to_date_tries_formats_in_turn(evaluate):
    day = datetime.date(2019, 5, 13)
    good = ["2019-05-13", "2019-05-13 10:11:12", "2019-05-13T10:11:12.5Z", " 5/13/2019 ", "5/13/2019 9:30 PM", "13May2019"]
    bad = ["soon", "2019-05-13 soon", "2019-02-30", "2/30/2019", "", None]
    formats = ("M/d/yyyy", "dMMMyyyy")
    assert evaluate(numbers.to_date("c", formats), good + bad) == [day] * 6 + [None] * 6


def test_share_rounds_half_to_even_and_survives_zero(spark):
    df = spark.createDataFrame([(1, 32), (3, 32), (1, 160), (0, 0), (None, 3)], "n int, d int")
    shares = [r[0] for r in df.selectExpr(numbers.pct("n", "d")).collect()]
    assert shares == [3.12, 9.38, 0.62, None, None]


def test_money_sum_does_not_depend_on_order(measure):
    values = [0.1] * 10 + [1e9, -1e9]
    assert measure(numbers.money_sum("c"), values, "double") == 1.0
    assert measure(numbers.money_sum("c"), values[::-1], "double") == 1.0


def test_cents_break_ties_to_even(evaluate):
    cents = evaluate(numbers.to_cents("c"), [55435.025, 55435.024999999994, 0.135], "double")
    assert [float(c) for c in cents] == [55435.02, 55435.02, 0.14]


def test_title_case(evaluate):
    texts = ["paid-in-full", "PAID", "owner's choice", "paid/redeemed by 1st owner", "", None]
    assert evaluate(text.title_case("c"), texts) == [
        "Paid-In-Full",
        "Paid",
        "Owner's Choice",
        "Paid/Redeemed By 1st Owner",
        "",
        None,
    ]


@pytest.mark.parametrize(
    "account, block, lot",
    [
        ("01234005", "1234", "05"),
        ("0123B004", "0123B", "04"),
        ("0123400A", "1234", "00A"),
        ("0123É004", "0123É", "04"),
        ("0123", "123", ""),
        (None, None, None),
    ],
)
def test_account_number_parts(evaluate, account, block, lot):
    assert evaluate(text.account_block("c"), [account]) == [block]
    assert evaluate(text.account_lot("c"), [account]) == [lot]


def test_header_names():
    headers = ["Adv No.", "numBids", "Removed Time-Stamp", "% Paid", "Owner's Name", "2020 Sale", "Adv No"]
    assert text.snake_names(headers) == [
        "adv_no",
        "num_bids",
        "removed_time_stamp",
        "percent_paid",
        "owners_name",
        "x2020_sale",
        "adv_no_2",
    ]
