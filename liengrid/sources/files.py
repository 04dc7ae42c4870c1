"""Raw files as all-text tables.

The first lines of all files are found by one scan of their text and grouped to layouts; each layout is
then one CSV scan with a declared schema. Rows know their place in their file, and rows that have more or
fewer fields than their header are kept apart.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liengrid.functions.nulls import blank_to_null

# The place of a row: its file, the split of the file, and a number that grows along the split.
FILE_ORDER = "file_order"
_PLACE = "struct(_metadata.file_path as path, _metadata.file_block_start as split, monotonically_increasing_id() as row)"
_RECORD = "_misfit_record"
RAGGED = ("fail", "reject", "keep")

AUCTION_INDEX_SCHEMA = T.StructType(
    [
        T.StructField("auction_label", T.StringType()),
        T.StructField("auction_date", T.DateType()),
        T.StructField("auction_year", T.IntegerType()),
        T.StructField("auction_type", T.StringType()),
        T.StructField("tax_year", T.IntegerType()),
    ]
)


def read_auction_index(spark: SparkSession, path: str) -> DataFrame:
    """The auction index, with declared types; blanks and NA are null."""
    rows = read_text_csv(spark, path)
    return rows.selectExpr(
        *[f"cast({blank_to_null(f.name)} as {f.dataType.simpleString()}) as {f.name}" for f in AUCTION_INDEX_SCHEMA]
    )


@dataclass(frozen=True)
class Layout:
    """Files with the same first line, and the column names it gives."""

    columns: tuple[str, ...]
    paths: tuple[str, ...]


def column_names(header: str) -> tuple[str, ...]:
    """The names in a header line: a blank one is named by its place, repeated ones get their place appended."""
    names = [n.strip() for n in next(csv.reader([header.lstrip("\ufeff").rstrip("\r")], skipinitialspace=True))]
    names = [n or f"_c{i}" for i, n in enumerate(names)]
    low = [n.lower() for n in names]
    return tuple(f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names))


def find_layouts(
    spark: SparkSession, paths: str | Sequence[str], contains: str = "", excludes: str | None = None, glob: str = "*"
) -> list[Layout]:
    """Files whose own name contains one text and not another, grouped by their header.

    paths: folders or files; glob is for names in folders. One job finds the first line that is not blank of
    every file, a row per file comes to the driver. Files without a line are in no layout. A header that goes over
    several lines is an error.
    """
    lines = spark.read.option("pathGlobFilter", glob).text(paths).selectExpr(
        "value", f"{_PLACE} as place", "_metadata.file_name as name"
    )
    chosen = lines.where(F.col("name").contains(contains) & (F.col("place.split") == 0))
    if excludes is not None:
        chosen = chosen.where(~F.col("name").contains(excludes))
    first = chosen.where("trim(value) <> ''").groupBy("place.path").agg(F.expr("min_by(value, place.row) as header"))
    layouts: dict[tuple[str, ...], list[str]] = {}
    for row in sorted(first.collect(), key=lambda r: r.path):
        if row.header.count('"') % 2:
            raise ValueError(f"the header of {row.path} goes over several lines")
        layouts.setdefault(column_names(row.header), []).append(row.path)
    return [Layout(columns, tuple(members)) for columns, members in layouts.items()]


def find_files(
    spark: SparkSession, folder: str, contains: str, excludes: str | None = None, glob: str = "*.csv"
) -> list[str]:
    """Files of a folder whose name contains one text and not another.

    Only the listing is read: the file contents are pruned away.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
    name = F.substring_index("path", "/", -1)
    chosen = listed.where(name.contains(contains))
    if excludes is not None:
        chosen = chosen.where(~name.contains(excludes))
    return sorted(row.path for row in chosen.collect())


def _read_layout(spark: SparkSession, layout: Layout, multi_line: bool) -> DataFrame:
    """The rows of one layout with their place, and the text of those that don't fit the header."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in (*layout.columns, _RECORD)])
    reader = spark.read.schema(schema).options(
        header=True,
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
        multiLine=multi_line,
        escape='"',
        mode="PERMISSIVE",
        columnPruning=False,
        columnNameOfCorruptRecord=_RECORD,
    )
    # A query must not need this text alone (Spark refuses that), so it seems to need the first column too.
    first = f"`{layout.columns[0]}`"
    record = f"coalesce({_RECORD}, if(length({first}) < 0, {first}, null)) as {_RECORD}"
    return reader.csv(list(layout.paths)).selectExpr(
        f"{_PLACE} as {FILE_ORDER}", record, *[f"`{c}`" for c in layout.columns]
    )


@dataclass(frozen=True)
class TextRows:
    """rows: file_order and the columns as trimmed text. rejected: file_order and record, the text as it stands."""

    rows: DataFrame
    rejected: DataFrame


def read_checked_csvs(spark: SparkSession, layouts: Sequence[Layout], multi_line: bool = True) -> TextRows:
    """S3, U4: files of any layout, stacked by column name; rows that don't fit their header apart.

    Every row of the files is in one of the two tables. Files of one layout are one scan, so the plan grows
    with the number of layouts and not with the number of files.
    """
    if not layouts:
        raise FileNotFoundError("no CSV files to read: no file name matched")
    tables = [_read_layout(spark, layout, multi_line) for layout in layouts]
    fitting = [t.where(f"{_RECORD} is null").drop(_RECORD) for t in tables]
    misfits = [t.where(f"{_RECORD} is not null").selectExpr(FILE_ORDER, f"{_RECORD} as record") for t in tables]
    return TextRows(
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fitting),
        reduce(lambda a, b: a.unionByName(b), misfits),
    )


def read_text_csvs(
    spark: SparkSession, paths: Sequence[str], multi_line: bool = True, ragged: str = "fail", with_order: bool = False
) -> DataFrame:
    """S3, U4: CSV files of any layout, stacked by column name, with their source path.

    ragged says what becomes of a row with more or fewer fields than its header: an error, left out
    ("reject"; read_checked_csvs has them), or kept with the missing fields null and surplus ones dropped ("keep").
    with_order adds file_order: sorted by it, rows come in the order of paths and of lines.
    """
    if ragged not in RAGGED:
        raise ValueError(f"ragged must be one of {RAGGED}")
    if not paths:
        raise FileNotFoundError("no CSV files to read: no file name matched")
    layouts = find_layouts(spark, paths)
    if not layouts:
        raise FileNotFoundError(f"no file with a header in {paths}")
    tables = []
    for layout in layouts:
        table = _read_layout(spark, layout, multi_line)
        if ragged == "reject":
            table = table.where(f"{_RECORD} is null")
        elif ragged == "fail":
            message = f"concat('a row does not fit the header of ', {FILE_ORDER}.path, ': ', {_RECORD})"
            table = table.where(f"if({_RECORD} is null, true, raise_error({message}))")
        place = [FILE_ORDER] if with_order else []
        tables.append(table.selectExpr(f"{FILE_ORDER}.path as path", *place, *[f"`{c}`" for c in layout.columns]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_text_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    multi_line: bool = True,
    ragged: str = "fail",
    with_order: bool = False,
) -> DataFrame:
    """One CSV file, or several, all columns trimmed text; see read_text_csvs."""
    paths = [path] if isinstance(path, str) else path
    return read_text_csvs(spark, paths, multi_line, ragged, with_order).drop("path")


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A list that was exported from a workbook to Parquet, all columns as text."""
    table = spark.read.parquet(path)
    return table.selectExpr(*[f"cast(`{c}` as string) as `{c}`" for c in table.columns])
