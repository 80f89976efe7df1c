"""Driver tables and the deterministic null injection shared with the SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# lineitem with missing values: every row is kept; some cells become NULL as a pure
# function of the order key, so Spark and DuckDB see the same gaps.
LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LI_NULLS = {"l_quantity": 7, "l_discount": 11, "l_tax": 5, "l_returnflag": 13, "l_shipdate": 17}
_LI_TEXT = {"l_shipdate"}                         # a timestamp, as text so that engines' time types need not agree


def _li_sql(c: str) -> str:
    v = f"CAST({c} AS VARCHAR)" if c in _LI_TEXT else c
    return f"CASE WHEN l_orderkey % {_LI_NULLS[c]} = 0 THEN NULL ELSE {v} END AS {c}" if c in _LI_NULLS else c


LI_SQL = "(SELECT " + ", ".join(map(_li_sql, LI_COLS)) + " FROM lineitem)"


def lineitem_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject_li_nulls(table(spark, sf_dir, "lineitem"))


def inject_li_nulls(li: DataFrame) -> DataFrame:
    """The null-injecting projection; works on batch and streaming DataFrames alike."""
    value = {c: F.col(c).cast("string") if c in _LI_TEXT else F.col(c) for c in LI_COLS}
    return li.select(*[
        F.when(F.col("l_orderkey") % _LI_NULLS[c] == 0, F.lit(None)).otherwise(value[c]).alias(c)
        if c in _LI_NULLS else value[c] for c in LI_COLS])
