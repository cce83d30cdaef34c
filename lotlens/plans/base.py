"""Registering queries, and the tables that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL twin if there is one."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def dec(c: Column | str, scale: int = 4) -> Column:
    """To a fixed number of places, so that results don't hang on the order of additions."""
    return F.round(F.col(c) if isinstance(c, str) else c, scale)


#: Sums of money are taken in decimals: exact, whatever the order.
def exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each offer: lineitem with its part. Ids are unique: order number and the line's place in the order."""
    line, part = tables(spark, sf_dir, "lineitem", "part")
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax"))
    numbered = line.withColumn("id", F.col("l_orderkey") * 100 + place)
    return numbered.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "id", F.col("l_returnflag").alias("source"), F.col("p_brand").alias("make"), F.col("p_type").alias("model"), F.col("p_size").alias("trim"),
        F.col("l_linestatus").alias("gearbox"), F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_quantity") < 50, F.col("l_quantity")).alias("km"), F.col("l_suppkey").alias("seller"), F.to_date("l_shipdate").alias("seen"),
        F.col("l_discount").alias("discount"), F.col("l_partkey").alias("part"), F.col("l_tax").alias("tax"), F.col("p_name").alias("title"),
    )


LISTINGS = """
listings AS (
  SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) AS id,
    l_returnflag AS source, p_brand AS make, p_type AS model, p_size AS trim, l_linestatus AS gearbox,
    CAST(year(l_shipdate) AS INTEGER) AS year, l_extendedprice AS price, CASE WHEN l_quantity < 50 THEN l_quantity END AS km,
    l_suppkey AS seller, CAST(l_shipdate AS DATE) AS seen, l_discount AS discount, l_partkey AS part, l_tax AS tax, p_name AS title
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


def newest(df: DataFrame, column: str) -> DataFrame:
    """One row: the clock of fixed data is its newest entry."""
    return F.broadcast(df.agg(F.max(column).alias("now")))
