"""The sale tables, derived from the given parquet tables.

Every row comes from a row of the given tables, so each table grows with them. Nulls
and unmatched keys are put in by rules on the keys. workload/oracle.py states the same
rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liengrid.operators.columns import aggregate_sql, select_sql

FIRST_YEAR = 1995
PRE_YEAR = 2000
SNAPSHOT_YEAR = 2001
LIST_YEAR = 2002
COPY_OFFSET = 1_000_000_000_000
MISSING_PIN = 50_000_000

# Later orders, if there are any, count for the snapshot year, earlier ones for the first year.
SALE_YEAR = f"greatest({FIRST_YEAR}, least({SNAPSHOT_YEAR}, year(o_orderdate)))"

RESULT_ORDER = ["adv_number"]
ADVERTISED_ORDER = ["adv_number", "line_number", "part_key", "supplier_key", "assessment", "occupied"]


# The given tables, so that no job has to read a schema first.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _rectangle(x: str, y: str, width: str, height: str) -> str:
    """A closed ring around the corners 0 to 3 and back to 0."""
    return f"""transform(array(0, 1, 2, 3, 0), corner -> named_struct(
        'x', cast({x} + if(corner in (1, 2), {width}, 0) as double),
        'y', cast({y} + if(corner in (2, 3), {height}, 0) as double)))"""


def _lot_shape(key: str) -> str:
    """A rectangle, with a hole for every fourth lot, flat for some and missing for some."""
    x, y = f"{key} % 1000 * 10", f"{key} div 1000 * 10"
    flat = f"{key} % 300 = 7"
    outline = _rectangle(x, y, f"({key} % 5 + 4)", f"if({flat}, 0, {key} % 3 + 4)")
    hole = _rectangle(f"{x} + 1", f"{y} + 1", "1", "1")
    return f"""case when {key} % 200 = 9 then null
        when {key} % 4 = 0 and not {flat} then array({outline}, {hole}) else array({outline}) end"""


def _property_keys(key: str) -> dict[str, str]:
    return {
        "block": f"string({key} div 10)",
        "lot": f"string({key} % 10)",
        "ward": f"string({key} % 24)",
        "section": f"string(nullif({key} % 3, 0))",
    }


def _ward_that_may_miss(key: str) -> str:
    return f"if({key} % 13 = 0, '99', string({key} % 24))"


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One parcel per customer."""
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    columns = {
        "objectid": "c_custkey",
        "fulladdr": "concat_ws(' ', c_custkey, n_name)",
        "owner_1": "c_name",
        "pin": "string(nullif(c_custkey, 42))",
        **_property_keys("c_custkey"),
        # No fact has such a ward, so this area has parcels and no matches.
        "ward": "concat(if(n_name = 'NATION_3', 'N', ''), c_custkey % 24)",
        "no_imprv": "if(c_acctbal < 0, 'Y', 'N')",
        "vacind": "case when c_custkey % 500 = 11 then null when c_custkey % 7 = 0 then 'Y' else 'N' end",
        "permhome": "if(c_custkey % 9 = 0, 'Y', 'N')",
        "lot_size": "string(c_custkey % 90)",
        "structarea": "string(c_custkey % 70)",
        "neighborhood": "nullif(n_name, 'NATION_7')",
        "council_district": "if(c_custkey % 50 <> 0, c_mktsegment, null)",
        "csa": "nullif(r_name, 'AFRICA')",
        "tract": "string(c_custkey % 200)",
        "geometry": _lot_shape("c_custkey"),
    }
    return select_sql(placed, columns)


def parcels_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels where every tenth has a second record without a csa."""
    copied = parcels(spark, sf_dir).selectExpr(
        "*", "explode(if(objectid % 10 = 0, array(false, true), array(false))) as _is_copy"
    )
    return copied.selectExpr(
        "* except (objectid, csa, _is_copy)",
        f"if(_is_copy, objectid + {COPY_OFFSET}, objectid) as objectid",
        "if(_is_copy, null, csa) as csa",
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One auction result per order, already typed."""
    keys = _property_keys("o_custkey")
    columns = {
        "adv_number": "o_orderkey",
        "pin": f"string(nullif(if(o_custkey % 13 = 0, o_custkey + {MISSING_PIN}, o_custkey), 42))",
        "auction_year": SALE_YEAR,
        "tax_year": f"{SALE_YEAR} - 1",
        "auction_type": "if(o_orderkey % 2 = 0, 'certificate_sale', 'assignment_sale')",
        "removed_because": "if(o_orderstatus = 'F', o_orderpriority, null)",
        "removed": "if(o_orderstatus = 'F', 'Y', 'N')",
        "removed_date": "if(o_orderstatus = 'F', date(o_orderdate), null)",
        "winning_bidder_name": "if(o_orderstatus = 'O', concat('B', o_custkey % 97), null)",
        "lien_amount": "if(o_orderkey % 5000 <> 7, o_totalprice, null)",
        "assessed_value": "round(o_totalprice * 10, 2)",
        "winning_bid": "if(o_orderstatus = 'O', round(o_totalprice * 3, 2), null)",
        "block": keys["block"],
        "lot": keys["lot"],
        "ward": _ward_that_may_miss("o_custkey"),
        "num_bids": f"if({SALE_YEAR} < {SNAPSHOT_YEAR}, int(o_orderkey % 13), null)",
        "homestead": "case o_orderkey % 3 when 0 then 'Y' when 1 then 'N' end",
        "owner_occupied": "case when o_orderkey % 4 = 0 then '1' when o_orderkey % 4 < 3 then '0' end",
    }
    return select_sql(read(spark, sf_dir, "orders"), columns)


def history(results: DataFrame) -> DataFrame:
    """Results before the snapshot year."""
    return results.where(f"auction_year < {SNAPSHOT_YEAR}").drop("owner_occupied", "ward")


def latest(results: DataFrame) -> DataFrame:
    """Results of the snapshot year, which know no homestead and no number of bids."""
    return results.where(f"auction_year = {SNAPSHOT_YEAR}").drop("homestead", "num_bids", "pin")


def advertised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One advertised property per line item."""
    orders, lineitem = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    lines = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    columns = {
        "adv_number": "l_orderkey",
        "line_number": "l_linenumber",
        "part_key": "l_partkey",
        "supplier_key": "l_suppkey",
        **_property_keys("o_custkey"),
        "ward": _ward_that_may_miss("o_custkey"),
        "lien_amount": "if(o_custkey not in (3, 103), l_extendedprice, null)",
        "assessment": "round(l_extendedprice * 10, 2)",
        "occupied": """case when l_linenumber = 7 then null when l_returnflag = 'A' then 'D'
            when l_returnflag = 'R' then 'H' else 'N' end""",
    }
    return select_sql(lines, columns)


def sale_index(spark: SparkSession) -> DataFrame:
    """One certificate and one assignment sale per year."""
    sales = spark.range(FIRST_YEAR, SNAPSHOT_YEAR + 1).selectExpr(
        "int(id) as year", "explode(array('certificate', 'assignment')) as kind"
    )
    columns = {
        "auction_year": "year",
        "tax_year": "year - 1",
        "auction_type": "concat(kind, '_sale')",
        "auction_label": "concat(year, ' ', initcap(kind), ' Sale')",
        "auction_date": "make_date(year, 5, 13)",
    }
    return select_sql(sales, columns)


def account_number(key: str) -> str:
    """Five characters of block and the lot, some with letters, padded with a leading 0."""
    block = f"lpad(string({key} div 10), 4, '0')"
    lot = f"string({key} % 10)"
    return f"""if({key} % 500 <> 42, concat(
        if({key} % 11 = 0, concat({block}, 'B'), concat('0', {block})),
        if({key} % 17 = 0, concat(lpad({lot}, 2, '0'), 'A'), lpad({lot}, 3, '0'))), null)"""


def _padded(sql: str) -> str:
    return f"concat('  ', {sql}, ' ')"


def _money(sql: str) -> str:
    return f"string(cast({sql} as decimal(18,2)))"


def _if_sold(sql: str, other: str = "null") -> str:
    return f"if(o_orderstatus = 'O', {sql}, {other})"


def _if_removed(sql: str, other: str = "null") -> str:
    return f"if(o_orderstatus = 'F', {sql}, {other})"


def raw_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as the yearly files hold them: padded text, NA, blanks and bad numbers."""
    stamp = """case o_orderkey % 3 when 0 then date_format(o_orderdate, 'yyyy-MM-dd')
        when 1 then date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')
        else date_format(o_orderdate, 'M/d/yyyy') end"""
    columns = {
        "path": """concat('data/', if(o_orderkey % 2 = 0, 'certificate', 'assignment'),
            '_sale_', year(o_orderdate), '.csv')""",
        "Adv Number": _padded("o_orderkey"),
        "Account Number": _padded(account_number("o_custkey")),
        "Removed Because": _if_removed(_padded("lower(o_orderpriority)"), "'NA'"),
        "Removed Time-Stamp": _if_removed(stamp, "'  '"),
        "Homestead": "case o_orderkey % 3 when 0 then '1' when 1 then '0' else '' end",
        "Tax Year": "string(year(o_orderdate) - 1)",
        "Num Ties": "if(o_orderkey % 6 = 0, 'n/a', string(o_orderkey % 6))",
        "numBids": "concat(o_orderkey % 13, '.7')",
        "Winning Bid": _if_sold(_padded(_money("o_totalprice * 3")), "'NA'"),
        "Winning Premium": _if_sold(_money("o_totalprice"), "''"),
        "Winning Bidder": _if_sold("string(o_custkey % 97)"),
        "Winning Amount Due": f"concat(if(o_orderkey % 5 = 0, '$', ''), {_money('o_totalprice')})",
        "Face Amount": f"if(o_orderkey % 5000 = 7, 'NA', {_money('o_totalprice')})",
        "Assessed Value": _money("o_totalprice * 10"),
        "Winning Bidder Name": _if_sold(_padded("concat('B', o_custkey % 97)")),
    }
    return select_sql(read(spark, sf_dir, "orders"), columns)


def raw_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the snapshot year as the single report holds them."""
    keys = _property_keys("o_custkey")
    columns = {
        "Batch": "string(o_orderkey % 10)",
        "Adv No.": _padded("o_orderkey"),
        "Cert No.": _if_sold("string(o_orderkey + 500)"),
        "Block": _padded(keys["block"]),
        "Lot": keys["lot"],
        "Ward": keys["ward"],
        "Lien Amount": f"if(o_orderkey % 50 = 7, 'NA', {_money('o_totalprice')})",
        "Assessed Value": _money("o_totalprice * 10"),
        "Winning Bid": _if_sold(_money("o_totalprice * 3"), "'NA'"),
        "Winning Bid Premium": "'0'",
        "Winning Bidder Amt Due": _if_sold(_money("o_totalprice")),
        "Winning Bidder Name": _if_sold("concat('B', o_custkey % 97)"),
        "Tax Year": "string(year(o_orderdate) - 1)",
        "Removed Because": _if_removed("lower(o_orderpriority)", "''"),
        "Removed Date": _if_removed("date_format(o_orderdate, 'M/d/yyyy')", "'NA'"),
        "Owner Occupied": "case when o_orderkey % 4 = 0 then '1' when o_orderkey % 4 < 3 then '0' end",
    }
    return select_sql(read(spark, sf_dir, "orders").where(f"year(o_orderdate) = {SNAPSHOT_YEAR}"), columns)


def _raw_list(spark: SparkSession, sf_dir: str, names: dict[str, str]) -> DataFrame:
    """Line items as a list of properties; names maps a header to one of the columns."""
    keys = _property_keys("l_partkey")
    columns = {
        "address": _padded("concat(l_partkey, ' MAIN ST')"),
        "number": "string(l_orderkey)",
        "block": _padded(keys["block"]),
        "lot": keys["lot"],
        "ward": keys["ward"],
        "section": f"coalesce({keys['section']}, 'NA')",
        "value": _money("l_extendedprice * 10"),
        "lien": f"if(l_linenumber = 6, 'pending', {_money('l_extendedprice')})",
        "occupied": "case when l_linenumber = 7 then '' when l_returnflag = 'A' then 'D' else 'N' end",
    }
    return select_sql(read(spark, sf_dir, "lineitem"), {header: columns[c] for header, c in names.items()})


def raw_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first release of the advertised list."""
    names = {
        "Address": "address",
        "Seq": "number",
        "Block": "block",
        "Lot": "lot",
        "Ward": "ward",
        "Section": "section",
        "Assessment": "value",
        "Lien Amount": "lien",
        "Occupied": "occupied",
    }
    return _raw_list(spark, sf_dir, names)


def raw_list_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second release: other headers, no running number."""
    names = {
        "Address": "address",
        "Blk": "block",
        "Lot": "lot",
        "Wd": "ward",
        "Sec": "section",
        "Assessed Value": "value",
        "Lien": "lien",
        "Occupied": "occupied",
    }
    return _raw_list(spark, sf_dir, names)


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rectangle around the lots of every district; one name has no summary."""
    x, y = "c_custkey % 1000 * 10", "c_custkey div 1000 * 10"
    boxes = aggregate_sql(
        read(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "name"),
        ["name"],
        {"x": f"min({x})", "w": f"max({x}) + 8 - min({x})", "y": f"min({y})", "h": f"max({y}) + 6 - min({y})"},
    )
    return boxes.selectExpr(
        "if(name = 'BUILDING', 'BUILDING (OLD)', name) as name",
        f"array({_rectangle('x', 'y', 'w', 'h')}) as geometry",
    )


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A longitude and a latitude per customer."""
    columns = {
        "objectid": "c_custkey",
        "lon": "-76.75D + c_custkey % 1000 * 0.0003D",
        "lat": "39.2D + c_custkey % 777 * 0.0002D",
    }
    return select_sql(read(spark, sf_dir, "customer"), columns)
