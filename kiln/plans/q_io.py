"""Source/sink plans (S1-S4) and the streaming replay of fitted rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions.columns import round_all
from kiln.operators import prep
from kiln.plans.q_prep import PIPELINE, _PIPE_SQL
from kiln.plans.registry import query
from kiln.plans.tables import inject_li_nulls, lineitem_nulls, table
from kiln.session import scratch_path
from kiln.sources.csv import read_csv_typed, write_csv
from kiln.sources.files import list_files, rows_per_file
from kiln.streaming.replay import stream_apply_rules


def _customer_text(spark, sf):
    """customer as the text a CSV would hold, with pandas missing tokens in some cells."""
    c = table(spark, sf, "customer")
    na = F.col("c_custkey") % 10 == 0
    return c.select(
        F.col("c_custkey").cast("string").alias("c_custkey"), "c_name",
        F.col("c_nationkey").cast("string").alias("c_nationkey"),
        F.when(na, F.lit("NA")).otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 15 == 0, F.lit("n/a")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(na, F.lit("")).when(F.col("c_acctbal") > 0, F.lit("True")).otherwise(F.lit("False")).alias("positive"))


@query("csv_scan_typed", """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 15 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal > 0 END AS positive FROM customer""")
def q_csv_scan_typed(spark, sf):
    """S4 then S1: write customer text to CSV in the shared folder, read it back typed."""
    path = scratch_path(spark, "csv")
    write_csv(_customer_text(spark, sf), path)
    return read_csv_typed(spark, path)


def _segment_files(spark, sf):
    path = scratch_path(spark, "segments")
    c = table(spark, sf, "customer")
    c.repartition(4, "c_mktsegment").write.partitionBy("c_mktsegment").option("header", True).csv(path)
    return path


@query("multi_file_rows", "SELECT 'c_mktsegment=' || c_mktsegment AS folder, count(*) AS n_rows "
       "FROM customer GROUP BY c_mktsegment")
def q_multi_file_rows(spark, sf):
    """S3: one scan over many CSV files, rows per folder (from each file's path)."""
    path = _segment_files(spark, sf)
    per_file = rows_per_file(spark, path)
    folder = F.regexp_extract("path", r"/(c_mktsegment=[^/]+)/", 1)
    return per_file.groupBy(folder.alias("folder")).agg(F.sum("n_rows").alias("n_rows"))


@query("file_listing", "SELECT 'c_mktsegment=' || c_mktsegment AS folder, 'data' AS format, '.csv' AS extension, "
       "CAST(1 AS BIGINT) AS n_files FROM customer GROUP BY c_mktsegment")
def q_file_listing(spark, sf):
    """Recursive listing of the CSV folder written from customer (each segment is one
    shuffle partition, so one file per folder), summarised per folder."""
    path = _segment_files(spark, sf)
    ls = list_files(spark, path)
    folder = F.element_at(F.split("relative_path", "/"), 1)
    return ls.groupBy(folder.alias("folder"), "format", "extension").agg(F.count(F.lit(1)).alias("n_files"))


@query("stream_replay_rules", _PIPE_SQL)
def q_stream_replay_rules(spark, sf):
    """Rules fitted in batch, replayed by a Structured Streaming query over lineitem files."""
    df = lineitem_nulls(spark, sf)
    rules, _ = prep.fit_pipeline(df, PIPELINE)
    src = table(spark, sf, "lineitem")
    out = stream_apply_rules(spark, f"{sf.rstrip('/')}/lineitem*.parquet", src.schema, rules,
                             prepare=inject_li_nulls)
    return round_all(out)


@query("csv_prepare_file", "SELECT * REPLACE (CAST(l_linenumber AS BIGINT) AS l_linenumber) FROM (" + _PIPE_SQL + ")")
def q_csv_prepare_file(spark, sf):
    """The reference's prepare flow on a CSV copy of lineitem (missing cells written as NA):
    read typed, fit the steps, save rules, replay them on the file, write the result."""
    from kiln.workflow import prepare_file
    src = scratch_path(spark, "li-csv")
    li = lineitem_nulls(spark, sf)
    write_csv(li.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in li.columns]), src)
    out = prepare_file(spark, src, PIPELINE, scratch_path(spark, "li-rules"), scratch_path(spark, "li-out"))
    return round_all(out)
