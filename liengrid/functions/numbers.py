"""Casts from raw text, shares and money."""

from __future__ import annotations

from collections.abc import Sequence

_NUMBER = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
_DAY_AND_TIME = r"^\s*[^ T]+([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?( ?[AaPp][Mm])?Z?)?\s*$"
_DAY = r"^\s*([^ T]+)"


def to_double(text: str) -> str:
    """Text to double, null for anything that is not a plain number, or one too large for a double.

    The form is checked first: Java also reads "12d" as a number, and a cast that fails
    costs far more than the check.
    """
    finite = f"nullif(nullif(try_cast({text} as double), double('infinity')), double('-infinity'))"
    return f"if({text} rlike r'{_NUMBER}', {finite}, null)"


def to_int(text: str) -> str:
    """Text to integer; "3.7" is cut to 3, bad text is null."""
    return f"try_cast({to_double(text)} as int)"


def to_date(text: str, formats: Sequence[str]) -> str:
    """The date of a text date or timestamp: ISO first, then the date formats in turn."""
    day = f"regexp_extract({text}, r'{_DAY}', 1)"
    tries = [f"try_cast({day} as date)"]
    tries += [f"cast(try_to_timestamp({day}, '{fmt}') as date)" for fmt in formats]
    return f"if({text} rlike r'{_DAY_AND_TIME}', coalesce({', '.join(tries)}), null)"


def pct(part: str, whole: str) -> str:
    """Share in percent with two digits, half to even; null when the whole is 0."""
    return f"bround(try_divide({part}, {whole}) * 100, 2)"


# Whole parts beyond this don't fit a long with room to spare; from the second on a double has few digits
# after the point, from the third on none.
_WIDEST, _FEW_DIGITS, _WHOLE = 2.0**62, 1e10, 2.0**53


def fits_exact_sum(column: str) -> str:
    """Whether a value is summed exactly: any double below 2^62 and not NaN."""
    return f"(not isnan({column}) and abs({column}) < {_WIDEST!r}D)"


def exact_sum(column: str) -> str:
    """The sum of doubles, each taken as the decimal it is printed as, rounded once: row order does not matter.

    Whole parts and parts behind the point (26 digits) are summed apart, in decimals wide enough for ten billion rows of
    one group, and put together as text. Above 2^53 a double is taken as the whole number it is. Values that
    don't fit (see fits_exact_sum) are added as doubles. Null for no values.
    """
    value = f"cast({column} as double)"
    fits = fits_exact_sum(value)
    whole = f"cast({value} as bigint)"
    behind = f"""cast(case when abs({value}) < {_FEW_DIGITS!r}D
        then cast({value} as decimal(37,26)) - cast({whole} as decimal(11,0))
        when abs({value}) < {_WHOLE!r}D then cast({value} as decimal(28,9)) - cast({whole} as decimal(17,0))
        else 0 end as decimal(27,26))"""
    high = f"sum(if({fits}, cast({whole} as decimal(19,0)), null))"
    low = f"sum(if({fits}, {behind}, null))"
    beyond = f"sum(if({fits}, null, {value}))"
    # A negative total has a negative whole part and a positive rest, or the other way round: both are turned to one sign.
    carried = f"({high} + cast(floor({low}) as decimal(12,0)))"
    rest = f"cast({low} - floor({low}) as decimal(27,26))"
    positive = f"concat({carried}, substr(cast({rest} as string), 2))"
    negative = f"concat('-', abs({carried} + 1), substr(cast(1 - {rest} as string), 2))"
    whole_only = f"cast({carried} as string)"
    text = f"case when {rest} = 0 then {whole_only} when {carried} >= 0 then {positive} else {negative} end"
    return f"case when {high} is null then {beyond} else cast({text} as double) + coalesce({beyond}, 0D) end"


def money_sum(column: str) -> str:
    """Exact sum of money: the result does not depend on row order."""
    return exact_sum(column)


def money_mean(column: str) -> str:
    """Mean of money over the non-null values; null when there are none."""
    return f"try_divide({money_sum(column)}, count({column}))"


def plain_number(column: str) -> str:
    """K2: a number as text: the shortest decimal that gives it back, no exponent, no zeros at the end.

    NaN, infinity and numbers beyond 10^20 or with more than 18 digits after the point keep Java's form.
    """
    exact = f"try_cast(cast({column} as string) as decimal(38,18))"
    trimmed = f"regexp_replace(cast({exact} as string), '([.]0+|(?<=[.][0-9]{{0,18}}[1-9])0+)$', '')"
    same = f"cast({exact} as double) = cast({column} as double)"
    return f"if(coalesce({same}, false), if({trimmed} = '-0', '0', {trimmed}), cast({column} as string))"


def to_cents(column: str) -> str:
    """Money as a decimal with two digits, half to even.

    A mean or median of cents may be stored a last bit off a tie such as 55435.025; the
    step over six digits takes that off before the tie is broken.
    """
    return f"bround(cast({column} as decimal(28,6)), 2)"
