"""Missing-value rules that differ from Spark's defaults."""

from __future__ import annotations

from collections.abc import Iterable


def strict(aggregate: str, *inputs: str) -> str:
    """The aggregate, or null as soon as one input value in the group is null."""
    complete = " and ".join(f"count({column}) = count(*)" for column in inputs)
    return f"case when {complete} then {aggregate} end"


def strict_count_if(condition: str) -> str:
    """Rows where the condition holds, null if it is unknown for any row."""
    return strict(f"count_if({condition})", condition)


def count_distinct_with_null(column: str, error: float | None = None) -> str:
    """Distinct values, where null counts as one value; approximate if an error is given."""
    distinct = f"approx_count_distinct({column}, {error})" if error else f"count(distinct {column})"
    return f"{distinct} + max(if({column} is null, 1, 0))"


def literal(text: str) -> str:
    """A text as an SQL literal, its quotes and backslashes kept."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def is_one_of(column: str, values: Iterable[str]) -> str:
    """Set membership that is false, never null, for a null."""
    listed = ", ".join(literal(value) for value in values)
    return f"coalesce({column} in ({listed}), false)"


def if_else(condition: str, yes: str, no: str) -> str:
    """A two-way choice that is null where the condition is null."""
    return f"case when {condition} then {yes} when not ({condition}) then {no} end"


def yes_no(condition: str) -> str:
    """Y or N, null where the condition is null."""
    return if_else(condition, "'Y'", "'N'")


def blank_to_null(column: str) -> str:
    """Trimmed text, with empty text and the word NA read as null."""
    return f"if(trim({column}) in ('', 'NA'), null, trim({column}))"
