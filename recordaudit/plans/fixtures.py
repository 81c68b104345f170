"""Portable views over the driver tables, one text for Spark and DuckDB.

Each view is a list of ``(alias, expression)`` over one base table (or a
join of small dimension tables); Spark evaluates it with ``selectExpr`` and
the oracle wraps the same text in a ``WITH`` clause.  Every row of the base
table is kept: the ``%`` arms only choose which messy spelling a row carries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# records: one row per order, standing for one generated answer with messy fields.
RECORDS = [
    ("rid", "o_orderkey"),
    ("model_name", "'m-' || cast(1 + o_custkey % 4 as string) || 'B'"),
    ("disease", "o_orderpriority"),
    ("age_raw", """case o_orderkey % 6
         when 0 then cast(o_custkey % 130 as string)
         when 1 then cast(o_custkey % 99 as string) || '岁'
         when 2 then cast(20 + o_custkey % 40 as string) || '-' || cast(30 + o_custkey % 40 as string) || '岁'
         when 3 then cast(o_custkey % 80 as string) || ' years old'
         when 4 then 'unknown' else null end"""),
    ("sex_raw", """case o_orderkey % 5
         when 0 then 'Male' when 1 then '女性' when 2 then ' female. '
         when 3 then '未知' else null end"""),
    ("age_zh_raw", """case o_custkey % 13
         when 0 then cast(o_custkey % 99 as string) || '岁以上'
         when 1 then cast(20 + o_custkey % 50 as string) || '多岁'
         when 2 then cast(o_custkey % 90 as string) || '-year-old'
         when 3 then '３５岁'
         when 4 then cast(1 + o_custkey % 11 as string) || '个月'
         when 5 then '约' || cast(o_custkey % 90 as string) || '岁'
         when 6 then '三个月'
         when 7 then '周岁'
         when 8 then cast(o_custkey % 100 as string) || '.0'
         when 9 then '-' || cast(o_custkey % 10 as string)
         when 10 then cast(100 + o_custkey % 60 as string) || '岁'
         when 11 then ' ' || cast(o_custkey % 70 as string) || ' '
         else null end"""),
    ("sex_zh_raw", """case o_custkey % 11
         when 0 then '男' when 1 then '女性' when 2 then '男性占40%，女性占60%'
         when 3 then '女性：男性=4:3' when 4 then 'boy.' when 5 then 'nam'
         when 6 then '已婚妇女' when 7 then '男女各占一半' when 8 then 'UNKNOWN'
         when 9 then '1' else null end"""),
    ("addr_raw", """case o_orderkey % 7
         when 0 then 'NA' when 1 then '' when 2 then 'nan' when 3 then 'NULL'
         when 4 then 'None' when 5 then 'n/a'
         else 'Street ' || cast(o_custkey as string) end"""),
]

# places: customers with province/city/district answers in several spellings.
PLACES = [
    ("pid", "c_custkey"),
    ("model_name", "'m-' || cast(1 + c_custkey % 4 as string) || 'B'"),
    ("Address_Chinese", "case c_custkey % 5 when 0 then null else 'Addr ' || cast(c_custkey as string) end"),
    ("Province_Chinese", """case c_custkey % 6 when 0 then null when 1 then 'ATLANTIS省'
         when 2 then r_name else r_name || '省' end"""),
    ("City_Chinese", """case c_custkey % 7 when 0 then null when 1 then n_name || '自治州'
         when 2 then n_name else n_name || '市' end"""),
    ("District_Chinese", """case c_custkey % 8 when 0 then null
         else 'D' || cast((c_nationkey + c_custkey % 3) % 30 as string) || '区' end"""),
]

# gazetteer: province / prefecture city / district names built from nation x region.
GAZETTEER = [
    ("省", "r_name || '省'"),
    ("地级市", "n_name || '市'"),
    ("县区", "'D' || cast(n_nationkey as string) || '区'"),
]
# home list: the districts of one region's nations.
HOME_REGION = "AFRICA"
HOME = [("name", "'D' || cast(n_nationkey as string) || '区'")]

# real-world gender counts per group, from order statuses.
REAL = [
    ("disease", "o_orderpriority"),
    ("female", "count_if(o_orderstatus = 'F')"),
    ("male", "count_if(o_orderstatus = 'O')"),
]


def _select(cols: list[tuple[str, str]]) -> list[str]:
    return [f"{expr} as `{alias}`" for alias, expr in cols]


def sql_select(cols: list[tuple[str, str]]) -> str:
    return ",\n  ".join(f'{expr} as "{alias}"' for alias, expr in cols)


_READS: dict[str, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table as a DataFrame; the read plan (file listing, footer schema)
    is reused within a session -- plans only, no data is cached."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df = _READS.get(path)
    if df is None or df.sparkSession is not spark:
        df = _READS[path] = spark.read.parquet(path)
    return df


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_select(RECORDS))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    dims = nation.join(region, nation.n_regionkey == region.r_regionkey)
    cust = table(spark, sf_dir, "customer")
    # nation x region are file-backed dimension tables: the planner's file-size
    # statistics bound them and it broadcasts them without a probe job
    return cust.join(dims, cust.c_nationkey == dims.n_nationkey).selectExpr(*_select(PLACES))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).selectExpr(*_select(GAZETTEER))


def home(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region").where(f"r_name = '{HOME_REGION}'")
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "left_semi").selectExpr(*_select(HOME))


def real(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("disease")) \
        .agg(*[F.expr(e).alias(a) for a, e in REAL[1:]])


# DuckDB text of the same views.
SQL_RECORDS = f"records as (select\n  {sql_select(RECORDS)}\nfrom orders)"
SQL_PLACES = (f"places as (select\n  {sql_select(PLACES)}\nfrom customer join nation on c_nationkey = n_nationkey "
              f"join region on n_regionkey = r_regionkey)")
SQL_GAZETTEER = (f"gaz as (select\n  {sql_select(GAZETTEER)}\nfrom nation join region on n_regionkey = r_regionkey)")
SQL_HOME = (f"home as (select {sql_select(HOME)} from nation where n_regionkey in "
            f"(select r_regionkey from region where r_name = '{HOME_REGION}'))")
SQL_REAL = (f"reals as (select o_orderpriority as disease, cast(count_if(o_orderstatus = 'F') as bigint) as female, "
            f"cast(count_if(o_orderstatus = 'O') as bigint) as male from orders group by o_orderpriority)")
