"""Quotes, line breaks and odd values at the edges of the library."""

from __future__ import annotations

import pytest

from liengrid.functions.nulls import is_one_of
from liengrid.functions.numbers import to_double
from liengrid.sources.files import read_auction_index, read_text_csvs


def test_quotes_and_line_breaks_stay_in_their_field(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b,c\n1,"say ""hi"", ok",x\n2,"two\nlines",y\n')
    rows = read_text_csvs(spark, [str(path)]).orderBy("a").collect()
    assert [(r.a, r.b, r.c) for r in rows] == [("1", 'say "hi", ok', "x"), ("2", "two\nlines", "y")]


def test_no_file_is_said(spark):
    with pytest.raises(FileNotFoundError):
        read_text_csvs(spark, [])


def test_index_blanks_are_null(spark, tmp_path):
    path = tmp_path / "index.csv"
    path.write_text('auction_label,auction_date,auction_year,auction_type,tax_year\n" ",2020-01-02,2020, NA ,NA\n')
    row = read_auction_index(spark, str(path)).first()
    assert (row.auction_label, str(row.auction_date), row.auction_year, row.auction_type, row.tax_year) == (
        None,
        "2020-01-02",
        2020,
        None,
        None,
    )


def test_a_number_beyond_double_is_null(evaluate):
    assert evaluate(to_double("c"), ["1e999", "-1e999", "1e17"]) == [None, None, 1e17]


def test_apostrophes_in_values(evaluate):
    assert evaluate(is_one_of("c", ["O'Neill", "a\\b"]), ["O'Neill", "a\\b", "x", None]) == [True, True, False, False]
