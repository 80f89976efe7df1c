"""Profiling plans: P1-P6, A1-A8."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions.columns import round_all
from kiln.operators import profile
from kiln.plans.registry import query
from kiln.plans.tables import LI_COLS, LI_SQL, lineitem_nulls, table

LI_NUMERIC = [c for c in LI_COLS if c not in ("l_returnflag", "l_linestatus", "l_shipdate")]


def _describe_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({x}), 6) AS mean, "
            f"round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, "
            f"round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.5), 6) AS q50, "
            f"round(quantile_cont({x}, 0.75), 6) AS q75, round(max({x}), 6) AS max FROM {src} t")
    return "\nUNION ALL\n".join(parts)


@query("describe_numeric", _describe_sql(LI_SQL, LI_NUMERIC))
def q_describe_numeric(spark, sf):
    return round_all(profile.describe_numeric(lineitem_nulls(spark, sf)))


@query("select_numeric", "SELECT p_partkey, p_size, p_retailprice FROM part")
def q_select_numeric(spark, sf):
    return profile.select_numeric(table(spark, sf, "part"))


@query("null_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\" FROM {LI_SQL} t HAVING count(*) > count({c})" for c in LI_COLS))
def q_null_columns(spark, sf):
    return profile.null_columns(lineitem_nulls(spark, sf))


@query("table_summary",
       f"SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns, CAST(8 AS BIGINT) AS n_numeric, "
       f"CAST(3 AS BIGINT) AS n_categorical, 'bigint:3, double:4, int:1, string:3' AS column_types, "
       f"CAST(sum(" +
       " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in LI_COLS) +
       f") AS BIGINT) AS n_missing_cells FROM {LI_SQL} t")
def q_table_summary(spark, sf):
    return profile.table_summary(lineitem_nulls(spark, sf))


@query("value_counts_all",
       "SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS count FROM orders "
       "WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus UNION ALL "
       "SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders "
       "WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority")
def q_value_counts_all(spark, sf):
    return profile.value_counts_all(table(spark, sf, "orders"))


@query("missing_by_column", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, "
    f"round(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS pct_missing FROM {LI_SQL} t"
    for c in LI_COLS))
def q_missing_by_column(spark, sf):
    return round_all(profile.missing_by_column(lineitem_nulls(spark, sf)))


_NULLABLE = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_shipdate"]


@query("missing_patterns",
       "SELECT CASE WHEN p = '' THEN 'No missing values' ELSE p END AS pattern, count(*) AS n_rows FROM ("
       "SELECT concat_ws(', ', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _NULLABLE) +
       f") AS p FROM {LI_SQL} t) GROUP BY 1")
def q_missing_patterns(spark, sf):
    return profile.missing_patterns(lineitem_nulls(spark, sf))


@query("column_bytes",
       "SELECT 'p_partkey' AS \"column\", count(p_partkey) * 8 AS n_bytes FROM part UNION ALL "
       "SELECT 'p_name', CAST(sum(octet_length(encode(p_name))) AS BIGINT) FROM part UNION ALL "
       "SELECT 'p_brand', CAST(sum(octet_length(encode(p_brand))) AS BIGINT) FROM part UNION ALL "
       "SELECT 'p_type', CAST(sum(octet_length(encode(p_type))) AS BIGINT) FROM part UNION ALL "
       "SELECT 'p_size', count(p_size) * 4 FROM part UNION ALL "
       "SELECT 'p_retailprice', count(p_retailprice) * 8 FROM part")
def q_column_bytes(spark, sf):
    return profile.column_bytes(table(spark, sf, "part"))


# Logical bytes of each driver table: (column, kind) with kind = width or 's' (text) or 'a4' (float array).
_TABLE_LAYOUT = {
    "region": [("r_regionkey", 4), ("r_name", "s")],
    "nation": [("n_nationkey", 4), ("n_name", "s"), ("n_regionkey", 4)],
    "customer": [("c_custkey", 8), ("c_name", "s"), ("c_nationkey", 4), ("c_acctbal", 8), ("c_mktsegment", "s")],
    "supplier": [("s_suppkey", 8), ("s_name", "s"), ("s_nationkey", 4), ("s_acctbal", 8)],
    "part": [("p_partkey", 8), ("p_name", "s"), ("p_brand", "s"), ("p_type", "s"), ("p_size", 4),
             ("p_retailprice", 8)],
    "orders": [("o_orderkey", 8), ("o_custkey", 8), ("o_orderstatus", "s"), ("o_totalprice", 8),
               ("o_orderdate", 8), ("o_orderpriority", "s")],
    "lineitem": [("l_orderkey", 8), ("l_partkey", 8), ("l_suppkey", 8), ("l_linenumber", 4),
                 ("l_quantity", 8), ("l_extendedprice", 8), ("l_discount", 8), ("l_tax", 8),
                 ("l_returnflag", "s"), ("l_linestatus", "s"), ("l_shipdate", 8)],
    "events": [("event_id", 8), ("ts", 8), ("user_id", 8), ("event_type", "s"), ("value", 8), ("props", "s")],
    "documents": [("doc_id", 8), ("text", "s"), ("lang", "s"), ("source", "s"), ("n_chars", 8)],
    "embeddings": [("vec_id", 8), ("embedding", "a4"), ("label", 4)],
    "pages": [("page_id", 8), ("url", "s"), ("html", "s")],
    "benchmark": [("item_id", 8), ("text", "s")],
    "labels": [("doc_id", 8), ("quality", 4), ("toxic", 4)],
    "conversations": [("conv_id", 8), ("turn", 8), ("role", "s"), ("text", "s")],
}


def _bytes_sql(c, kind):
    if kind == "s":
        return f"coalesce(sum(octet_length(encode({c}))), 0)"
    if kind == "a4":
        return f"coalesce(sum(len({c})), 0) * 4"
    return f"count({c}) * {kind}"


_TOTALS_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS dataset, count(*) AS n_rows, CAST({len(cols)} AS BIGINT) AS n_columns, "
    f"CAST(" + " + ".join(_bytes_sql(c, k) for c, k in cols) + f" AS BIGINT) AS n_bytes FROM {t}"
    for t, cols in _TABLE_LAYOUT.items())


@query("dataset_totals", _TOTALS_SQL)
def q_dataset_totals(spark, sf):
    return profile.dataset_totals({t: table(spark, sf, t) for t in _TABLE_LAYOUT})


@query("batch_totals", f"SELECT count(*) AS n_datasets, CAST(sum(n_rows) AS BIGINT) AS n_rows, "
       f"CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM ({_TOTALS_SQL}) t")
def q_batch_totals(spark, sf):
    return profile.batch_totals({t: table(spark, sf, t) for t in _TABLE_LAYOUT})


@query("category_share",
       "SELECT c_mktsegment AS category, count(*) AS count, "
       "round(count(*) / (SELECT count(*) FROM customer WHERE c_mktsegment IS NOT NULL), 6) AS share "
       "FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment")
def q_category_share(spark, sf):
    return round_all(profile.category_share(table(spark, sf, "customer"), "c_mktsegment"))


@query("head_preview",
       "SELECT * REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate) FROM orders ORDER BY o_orderkey LIMIT 5")
def q_head_preview(spark, sf):
    o = table(spark, sf, "orders")
    return profile.head_preview(o, ["o_orderkey"]).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("scatter_sample",
       "SELECT * REPLACE (CAST(ts AS VARCHAR) AS ts) FROM events ORDER BY "
       "('0x' || substr(md5(CAST(event_id AS VARCHAR) || '#42'), 1, 8))::BIGINT, event_id LIMIT 1000")
def q_scatter_sample(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("string"))
    return profile.scatter_sample(e, "event_id", 1000)


@query("feature_target", "SELECT p_size, p_retailprice, p_partkey FROM part")
def q_feature_target(spark, sf):
    return profile.feature_target(table(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"])


@query("target_classes",
       "SELECT CAST(quality AS INTEGER) AS class, count(*) AS n_rows FROM labels GROUP BY 1")
def q_target_classes(spark, sf):
    return profile.target_classes(table(spark, sf, "labels"), "quality")
