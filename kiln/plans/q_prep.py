"""Preparation plans: impute, scale, encode, outlier removal, pipeline, replay, rule files."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions.columns import round_all
from kiln.operators import prep
from kiln.operators.split import split_three_way
from kiln.plans.registry import query
from kiln.plans.tables import LI_COLS, LI_SQL, lineitem_nulls
from kiln.sources.rules_io import load_rules, save_rules
from kiln.session import scratch_path

_DOUBLES = {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}


def _out(exprs: dict[str, str], cols=LI_COLS, doubles=_DOUBLES) -> str:
    """SELECT list over lineitem columns, replacing some and rounding doubles like round_all."""
    parts = []
    for c in cols:
        e = exprs.get(c, c)
        parts.append(f"round({e}, 6) AS {c}" if c in doubles else f"{e} AS {c}")
    return ", ".join(parts)


def _mode_sql(c: str, src: str = "li") -> str:
    return f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


IMP = ["l_quantity", "l_discount", "l_tax"]

# ----------------------------------------------------------------------------- impute


@query("impute_mean", f"WITH li AS {LI_SQL} SELECT " + _out(
    {c: f"coalesce({c}, (SELECT avg({c}) FROM li))" for c in IMP}) + " FROM li")
def q_impute_mean(spark, sf):
    df = lineitem_nulls(spark, sf)
    return round_all(prep.apply_rules(df, prep.fit_impute(df, "mean", IMP)))


@query("impute_median", f"WITH li AS {LI_SQL} SELECT " + _out(
    {c: f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM li))" for c in IMP}) + " FROM li")
def q_impute_median(spark, sf):
    df = lineitem_nulls(spark, sf)
    return round_all(prep.apply_rules(df, prep.fit_impute(df, "median", IMP)))


@query("impute_mode", f"WITH li AS {LI_SQL} SELECT " + _out(
    {c: f"coalesce({c}, {_mode_sql(c)})" for c in ["l_quantity", "l_returnflag"]}) + " FROM li")
def q_impute_mode(spark, sf):
    df = lineitem_nulls(spark, sf)
    return round_all(prep.apply_rules(df, prep.fit_impute(df, "most_frequent",
                                                          ["l_quantity", "l_returnflag"])))


@query("impute_constant", f"WITH li AS {LI_SQL} SELECT " + _out(
    {"l_quantity": "coalesce(l_quantity, 0.0)",
     "l_returnflag": "coalesce(l_returnflag, 'missing_value')"}) + " FROM li")
def q_impute_constant(spark, sf):
    df = lineitem_nulls(spark, sf)
    return round_all(prep.apply_rules(df, prep.fit_impute(df, "constant", ["l_quantity", "l_returnflag"])))


# ------------------------------------------------------------------------------ scale
SC = ["l_quantity", "l_extendedprice", "l_discount"]


def _nz(e: str) -> str:
    return f"(CASE WHEN {e} = 0 OR {e} IS NULL THEN 1.0 ELSE {e} END)"


@query("scale_standard", f"WITH li AS {LI_SQL} SELECT " + _out(
    {c: f"({c} - (SELECT avg({c}) FROM li)) / (SELECT {_nz(f'stddev_pop({c})')} FROM li)" for c in SC})
    + " FROM li")
def q_scale_standard(spark, sf):
    df = lineitem_nulls(spark, sf)
    return round_all(prep.apply_rules(df, prep.fit_scale(df, "standard", SC)))


@query("scale_minmax", f"WITH li AS {LI_SQL} SELECT " + _out(
    {c: f"({c} - (SELECT min({c}) FROM li)) / (SELECT {_nz(f'max({c}) - min({c})')} FROM li)" for c in SC})
    + " FROM li")
def q_scale_minmax(spark, sf):
    df = lineitem_nulls(spark, sf)
    return round_all(prep.apply_rules(df, prep.fit_scale(df, "minmax", SC)))


@query("scale_robust", f"WITH li AS {LI_SQL} SELECT " + _out(
    {c: f"({c} - (SELECT quantile_cont({c}, 0.5) FROM li)) / "
        f"(SELECT {_nz(f'quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)')} FROM li)" for c in SC})
    + " FROM li")
def q_scale_robust(spark, sf):
    df = lineitem_nulls(spark, sf)
    return round_all(prep.apply_rules(df, prep.fit_scale(df, "robust", SC)))


# ----------------------------------------------------------------------------- encode
ENC = ["l_returnflag", "l_linestatus"]


@query("encode_label", f"WITH li AS {LI_SQL}, "
       + ", ".join(f"k_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code "
                   f"FROM (SELECT DISTINCT coalesce({c}, 'nan') AS v FROM li))" for c in ENC)
       + " SELECT " + _out({c: f"k_{c}.code" for c in ENC}).replace("l_orderkey AS", "t.l_orderkey AS")
       + " FROM li t " + " ".join(f"LEFT JOIN k_{c} ON coalesce(t.{c}, 'nan') = k_{c}.v" for c in ENC))
def q_encode_label(spark, sf):
    df = lineitem_nulls(spark, sf)
    return round_all(prep.apply_rules(df, prep.fit_encode(df, "label", ENC)))


_OH = {"l_returnflag": ["A", "N", "R", "nan"], "l_linestatus": ["F", "O"]}


@query("encode_onehot", f"WITH li AS {LI_SQL} SELECT " + _out(
    {}, [c for c in LI_COLS if c not in ENC]) + ", " + ", ".join(
    (f"CAST({c} IS NULL AS DOUBLE) AS {c}_{v}" if v == "nan" else
     f"CAST(coalesce({c} = '{v}', false) AS DOUBLE) AS {c}_{v}")
    for c in ENC for v in _OH[c]) + " FROM li")
def q_encode_onehot(spark, sf):
    df = lineitem_nulls(spark, sf)
    return round_all(prep.apply_rules(df, prep.fit_encode(df, "onehot", ENC)))


# ---------------------------------------------------------------------------- outliers
@query("outlier_zscore", f"""WITH li AS {LI_SQL},
s1 AS (SELECT avg(l_quantity) m, stddev_samp(l_quantity) s FROM li),
t1 AS (SELECT li.* FROM li, s1 WHERE abs((l_quantity - m) / s) < 3),
s2 AS (SELECT avg(l_extendedprice) m, stddev_samp(l_extendedprice) s FROM t1),
t2 AS (SELECT t1.* FROM t1, s2 WHERE abs((l_extendedprice - m) / s) < 3)
SELECT {_out({})} FROM t2""")
def q_outlier_zscore(spark, sf):
    df = lineitem_nulls(spark, sf)
    _, out = prep.fit_outliers(df, "zscore", 3.0, ["l_quantity", "l_extendedprice"])
    return round_all(out)


def _iqr_keep(c: str) -> str:
    return (f"({c} IS NULL OR NOT ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)))")


@query("outlier_iqr", f"""WITH li AS {LI_SQL},
s1 AS (SELECT quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.75) q3 FROM li),
t1 AS (SELECT li.* FROM li, s1 WHERE {_iqr_keep('l_extendedprice')}),
s2 AS (SELECT quantile_cont(l_quantity, 0.25) q1, quantile_cont(l_quantity, 0.75) q3 FROM t1),
t2 AS (SELECT t1.* FROM t1, s2 WHERE {_iqr_keep('l_quantity')})
SELECT {_out({})} FROM t2""")
def q_outlier_iqr(spark, sf):
    df = lineitem_nulls(spark, sf)
    _, out = prep.fit_outliers(df, "iqr", 3.0, ["l_extendedprice", "l_quantity"])
    return round_all(out)


# ---------------------------------------------------------------------------- pipeline
PIPELINE = [
    {"operation": "missing_values", "strategy": "median", "columns": ["l_quantity", "l_tax"]},
    {"operation": "outliers", "method": "zscore", "threshold": 3.0, "columns": ["l_extendedprice"]},
    {"operation": "normalization", "method": "standard", "columns": ["l_quantity", "l_extendedprice"]},
    {"operation": "encoding", "method": "label", "columns": ["l_returnflag"]},
]


def _pipeline_sql(fit_src: str, apply_src: str) -> str:
    """Fit the PIPELINE steps on ``fit_src`` and run them over ``apply_src`` (both CTE names)."""
    return f"""
f1 AS (SELECT quantile_cont(l_quantity, 0.5) mq, quantile_cont(l_tax, 0.5) mt FROM {fit_src}),
a1 AS (SELECT * REPLACE (coalesce(l_quantity, mq) AS l_quantity, coalesce(l_tax, mt) AS l_tax) FROM {fit_src}, f1),
f2 AS (SELECT avg(l_extendedprice) m, stddev_samp(l_extendedprice) s FROM a1),
a2 AS (SELECT a1.* FROM a1, f2 WHERE abs((l_extendedprice - m) / s) < 3),
f3 AS (SELECT avg(l_quantity) m1, {_nz('stddev_pop(l_quantity)')} s1,
              avg(l_extendedprice) m2, {_nz('stddev_pop(l_extendedprice)')} s2 FROM a2),
a3 AS (SELECT a2.* REPLACE ((l_quantity - m1) / s1 AS l_quantity, (l_extendedprice - m2) / s2 AS l_extendedprice)
       FROM a2, f3),
f4 AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT coalesce(l_returnflag, 'nan') AS v FROM a3)),
r1 AS (SELECT * REPLACE (coalesce(l_quantity, mq) AS l_quantity, coalesce(l_tax, mt) AS l_tax) FROM {apply_src}, f1),
r2 AS (SELECT r1.* FROM r1, f2 WHERE abs((l_extendedprice - m) / s) < 3),
r3 AS (SELECT r2.* REPLACE ((l_quantity - m1) / s1 AS l_quantity, (l_extendedprice - m2) / s2 AS l_extendedprice)
       FROM r2, f3),
r4 AS (SELECT r3.* REPLACE (f4.code AS l_returnflag) FROM r3 LEFT JOIN f4 ON coalesce(r3.l_returnflag, 'nan') = f4.v)
SELECT {_out({})} FROM r4"""


_SPLIT_SQL = ("(SELECT li.*, CASE WHEN b < 2000 THEN 'test' WHEN b < 3600 THEN 'validation' ELSE 'train' END "
              "AS split FROM (SELECT *, (('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '#42'), 1, 8))"
              "::BIGINT) % 10000 AS b FROM li) li)")

_PIPE_SQL = f"WITH li AS {LI_SQL}, " + _pipeline_sql("li", "li")


@query("prep_pipeline", _PIPE_SQL)
def q_prep_pipeline(spark, sf):
    df = lineitem_nulls(spark, sf)
    rules, out = prep.fit_pipeline(df, PIPELINE)
    return round_all(prep.apply_rules(df, rules))


@query("replay_rules", f"WITH li AS {LI_SQL}, sp AS {_SPLIT_SQL}, "
       f"trn AS (SELECT * EXCLUDE (b, split) FROM sp WHERE split = 'train'), "
       f"oth AS (SELECT * EXCLUDE (b, split) FROM sp WHERE split <> 'train'), " + _pipeline_sql("trn", "oth"))
def q_replay_rules(spark, sf):
    df = split_three_way(lineitem_nulls(spark, sf), "l_orderkey")
    train = df.where(F.col("split") == "train").drop("split")
    other = df.where(F.col("split") != "train").drop("split")
    rules, _ = prep.fit_pipeline(train, PIPELINE)
    return round_all(prep.apply_rules(other, rules))


@query("rules_roundtrip", _PIPE_SQL)
def q_rules_roundtrip(spark, sf):
    df = lineitem_nulls(spark, sf)
    rules, _ = prep.fit_pipeline(df, PIPELINE)
    path = scratch_path(spark, "rules")
    save_rules(spark, rules, path)
    return round_all(prep.apply_rules(df, load_rules(spark, path)))


# ------------------------------------------------- category lists that are tables, not columns
# The order key as text, with gaps and a text 'nan' beside them: many more categories than MAX_ONEHOT.
_KEY = "CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 1009 = 1 THEN 'nan' ELSE CAST(l_orderkey AS VARCHAR) END"


def _with_key(spark, sf):
    k = F.col("l_orderkey")
    return lineitem_nulls(spark, sf).withColumn("key", F.when(k % 7 == 0, None).when(k % 1009 == 1, "nan").otherwise(k.cast("string")))


@query("encode_onehot_wide", f"""WITH li AS (SELECT *, {_KEY} AS key FROM lineitem),
k AS (SELECT key, CAST(row_number() OVER (ORDER BY key NULLS LAST) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT key FROM li))
SELECT l_orderkey, l_linenumber, (SELECT CAST(count(*) AS INTEGER) FROM k) AS width, k.code, 1.0::DOUBLE AS value
FROM li JOIN k ON li.key IS NOT DISTINCT FROM k.key""")
def q_encode_onehot_wide(spark, sf):
    """One-hot of a column with thousands of categories: position and value of each row's entry in its sparse vector."""
    df = _with_key(spark, sf)
    out = prep.apply_rules(df, prep.fit_encode(df, "onehot", ["key"]))
    v = prep.vector_entries(F.col("key_onehot"))
    raw = out.select("l_orderkey", "l_linenumber", v.alias("v"))
    return raw.select("l_orderkey", "l_linenumber", F.col("v.size").alias("width"), F.col("v.indices")[0].alias("code"), F.col("v.values")[0].alias("value"))


@query("rules_bundle", f"""WITH li AS (SELECT *, coalesce({_KEY}, 'nan') AS label FROM {LI_SQL}),
k AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT label FROM li)),
s AS (SELECT avg(l_tax) AS m, stddev_pop(l_tax) AS d FROM li)
SELECT l_orderkey, l_linenumber, code AS key, round((l_tax - m) / d, 6) AS l_tax FROM li JOIN k USING (label), s""")
def q_rules_bundle(spark, sf):
    """Rules with a code table of thousands of labels, saved as a folder, loaded and replayed."""
    df = _with_key(spark, sf).select("l_orderkey", "l_linenumber", "key", "l_tax")
    rules, _ = prep.fit_pipeline(df, [{"operation": "encoding", "method": "label", "columns": ["key"]},
                                      {"operation": "normalization", "method": "standard", "columns": ["l_tax"]}])
    path = save_rules(spark, rules, scratch_path(spark, "rules"))
    return round_all(prep.apply_rules(df, load_rules(spark, path)))
