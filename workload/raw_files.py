"""Files derived from the given tables: yearly results, an index, ragged lists.

Spark writes them to the shared folder; only their names are given afterwards, one rename per file.
"""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liengrid.sources.tables import staging_folder
from workload import tables as t

FILE = "file"


def new_folder(spark: SparkSession) -> str:
    """A folder that is removed when the session's JVM ends."""
    path = f"{staging_folder(spark)}/liengrid-files-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def _named(spark: SparkSession, written: str, folder: str) -> None:
    """Moves the one part file of every directory file=NAME to folder/NAME."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(written).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(folder))
    for part in system.globStatus(path(f"{written}/{FILE}=*/part-*")):
        name = part.getPath().getParent().getName().split("=", 1)[1]
        if not system.rename(part.getPath(), path(f"{folder}/{name}")):
            raise OSError(f"cannot rename {part.getPath()}")


def write_history(spark: SparkSession, sf_dir: str) -> str:
    """One CSV file per year and kind of sale, the last number first; headers come in three orders."""
    raw = t.raw_history(spark, sf_dir).withColumn(FILE, F.expr("substring_index(path, '/', -1)")).drop("path")
    folder = new_folder(spark)
    names = [c for c in raw.columns if c != FILE]
    orders = [names, names[::-1], names[5:] + names[:5]]
    for place, columns in enumerate(orders):
        year = "cast(regexp_extract(file, '[0-9]+', 0) as int)"
        part = raw.where(f"{year} % {len(orders)} = {place}").select(FILE, *[F.col(f"`{c}`") for c in columns])
        sorted_part = part.repartition(FILE).sortWithinPartitions(FILE, F.expr("bigint(trim(`Adv Number`))").desc())
        options = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
        sorted_part.write.partitionBy(FILE).options(**options).csv(f"{folder}/{place}")
        _named(spark, f"{folder}/{place}", f"{folder}/named")
    return f"{folder}/named"


def write_index(spark: SparkSession) -> str:
    """The auction index as CSV."""
    path = f"{new_folder(spark)}/index"
    t.sale_index(spark).select("auction_label", "auction_date", "auction_year", "auction_type", "tax_year").write.csv(path, header=True)
    return path


def _binary():
    """Rings to the well-known binary of a polygon, every third one in the other byte order."""

    def one(place: int, rings: list | None) -> bytes | None:
        if rings is None:
            return None
        order = "<" if place % 3 else ">"
        body = b"".join(
            struct.pack(f"{order}I{2 * len(r)}d", len(r), *[p[c] for p in r for c in ("x", "y")]) for r in rings
        )
        return struct.pack(f"{order}BII", order == "<", 3, len(rings)) + body

    # Defined here, so that workers get it with its code and need no copy of this module.
    def encode(shapes: pa.Array) -> pa.Array:
        return pa.array([one(i, r) for i, r in enumerate(shapes.to_pylist())], pa.binary())

    return F.arrow_udf(encode, "binary")


def write_parcels_binary(spark: SparkSession, sf_dir: str) -> str:
    """Parcels with shapes in well-known binary, some cut off in the middle."""
    path = f"{new_folder(spark)}/parcels"
    parcels = t.parcels(spark, sf_dir).withColumn("geometry", _binary()("geometry"))
    broken = "if(objectid % 250 = 3, substr(geometry, 1, octet_length(geometry) - 5), geometry)"
    parcels.withColumn("geometry", F.expr(broken)).write.parquet(path)
    return path


def write_ragged(spark: SparkSession, sf_dir: str) -> str:
    """One file per order status: number, customer and status of each order; some rows with a field more or less."""
    orders = t.read(spark, sf_dir, "orders").selectExpr("o_orderstatus", "o_orderkey as k", "o_custkey as c")
    line = """concat_ws(',', k, c, if(k % 97 = 6, null, o_orderstatus), if(k % 89 = 5, 'more', null))"""
    lines = orders.selectExpr(f"concat('orders_', o_orderstatus, '.csv') as {FILE}", "k", f"{line} as value")
    headers = orders.selectExpr(f"concat('orders_', o_orderstatus, '.csv') as {FILE}", "-1L as k").distinct()
    whole = lines.unionByName(headers.selectExpr(FILE, "k", "'number,customer,status' as value"))
    folder = new_folder(spark)
    ordered: DataFrame = whole.repartition(FILE).sortWithinPartitions(FILE, "k").select(FILE, "value")
    ordered.write.partitionBy(FILE).text(f"{folder}/lines")
    _named(spark, f"{folder}/lines", f"{folder}/named")
    return f"{folder}/named"
