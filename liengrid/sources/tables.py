"""Named tables between steps, and summary files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liengrid.functions.geometry import LambertConic
from liengrid.functions.numbers import plain_number
from liengrid.sources.wkb import with_decoded_shapes

# The parcel attributes that are used.
PARCEL_COLUMNS = [
    "objectid",
    "fulladdr",
    "owner_1",
    "pin",
    "block",
    "lot",
    "ward",
    "section",
    "no_imprv",
    "vacind",
    "permhome",
    "lot_size",
    "structarea",
    "neighborhood",
    "council_district",
    "csa",
    "tract",
]


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """K1: overwrite a Parquet table.

    With partition columns, rows are rebalanced by them first: Spark splits a large
    partition over several tasks and files and merges small ones.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def save_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace the partitions that df has rows of; all others keep their files.

    New files become visible together, when the job is done, so a failed run changes nothing and is repeated
    as it is. This adds a year, or a late file's year, to a stored table.
    """
    ordered = df.hint("rebalance", *partition_by)
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark._jsc.hadoopConfiguration()), place


def recover_table(spark: SparkSession, path: str) -> None:
    """Ends or takes back a replacement that was broken off; nothing to do for a whole table."""
    system, place = _file_system(spark, path)
    before = place(f"{path}.before")
    if system.exists(before):
        if system.exists(place(path)):
            system.delete(before, True)
        else:
            system.rename(before, place(path))
    system.delete(place(f"{path}.after"), True)


def replace_table(df: DataFrame, path: str) -> None:
    """K1: a new version of an unpartitioned table, written beside the old one and then put in its place.

    The old version is there until the new one is complete; df may read it. A run that fails in between leaves
    one whole version, found by recover_table, which the next run calls first. Needs a store with renames.
    """
    spark = df.sparkSession
    system, place = _file_system(spark, path)
    if not system.exists(place(path)):
        recover_table(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.after")
    if system.exists(place(path)):
        system.delete(place(f"{path}.before"), True)
        system.rename(place(path), place(f"{path}.before"))
    if not system.rename(place(f"{path}.after"), place(path)):
        raise OSError(f"cannot put the new version of {path} in its place")
    system.delete(place(f"{path}.before"), True)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table."""
    return spark.read.parquet(path)


def read_parcels(spark: SparkSession, path: str, projection: LambertConic | None = None) -> DataFrame:
    """Parcel attributes and shapes, optionally projected from degrees.

    Shapes are points in arrays of any nesting, or well-known binary; of the latter geometry_status says
    which are broken (they are null).
    """
    parcels = spark.read.parquet(path).select(*PARCEL_COLUMNS, "geometry")
    if parcels.schema["geometry"].dataType.simpleString() == "binary":
        parcels = with_decoded_shapes(parcels)
    if projection is not None:
        kind = parcels.schema["geometry"].dataType.simpleString()
        parcels = parcels.withColumn("geometry", F.expr(projection.forward_all("geometry", kind)))
    return parcels


def published_form(df: DataFrame) -> DataFrame:
    """K2: all columns as text, numbers as plain_number prints them, null as NA."""
    numeric = ("double", "float", "decimal")
    texts = {c: plain_number(f"`{c}`") if kind.startswith(numeric) else f"cast(`{c}` as string)" for c, kind in df.dtypes}
    return df.selectExpr(*[f"coalesce({sql}, 'NA') as `{c}`" for c, sql in texts.items()])


def write_summary_csv(df: DataFrame, path: str, order: Sequence[Column] = ()) -> None:
    """K2: one CSV file in the published form, with a header, for tables of summary size.

    Rows are gathered first and sorted by order then, so the file has that order. Without it rows come as
    they are gathered.
    """
    gathered = df.repartition(1)
    if order:
        gathered = gathered.sortWithinPartitions(*order)
    published_form(gathered).write.mode("overwrite").options(escape='"', emptyValue="").csv(path, header=True)


def staging_folder(spark: SparkSession) -> str:
    """The shared folder for tables between steps: spark.checkpoint.dir, or else the warehouse.

    Both are seen by the driver and by all executors.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# The folders of staged tables, by the tables that read them.
_staged: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stage(df: DataFrame) -> DataFrame:
    """Write a table once to the shared folder and go on from the written copy.

    For a table that a plan reads several times, such as a join result: each reader
    scans only its columns, and a lost executor does not repeat the join. The copy is
    removed when the session's JVM ends, the shuffle files of the write as soon as it is done.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/liengrid-stage-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    copy = spark.read.schema(df.schema).parquet(path)
    _staged[copy] = path
    return copy


def discard(*staged: DataFrame) -> None:
    """Remove staged copies at once. Only for copies that no table still to be computed reads."""
    for df in staged:
        path = _staged.pop(df, None)
        if path is not None:
            system, place = _file_system(df.sparkSession, path)
            system.delete(place(path), True)
