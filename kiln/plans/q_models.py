"""k-NN and model plans: L1-L10, E12, E13, E15, S6."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions.columns import round_all
from kiln.operators import knn
from kiln.operators.split import split_three_way
from kiln.plans.registry import ORACLE, query
from kiln.plans.tables import table


def _emb_split(spark, sf):
    return split_three_way(table(spark, sf, "embeddings"), "vec_id")


_EMB_SQL = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
        (('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '#42'), 1, 8))::BIGINT) % 10000 AS b FROM embeddings),
tr AS (SELECT * FROM e WHERE b >= 3600), te AS (SELECT * FROM e WHERE b < 2000),
d AS (SELECT te.vec_id AS qid, tr.vec_id AS tid, tr.label AS tl,
             sqrt(list_sum(list_transform(list_zip(te.v, tr.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist
      FROM te, tr),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rn FROM d),
top AS (SELECT * FROM r WHERE rn <= 5)"""


@query("knn_classify", _EMB_SQL + """,
v AS (SELECT qid, tl, count(*) AS n FROM top GROUP BY qid, tl),
p AS (SELECT qid, tl AS pred, row_number() OVER (PARTITION BY qid ORDER BY n DESC, tl) AS rk FROM v)
SELECT te.vec_id, te.label, p.pred AS prediction FROM te LEFT JOIN p ON p.qid = te.vec_id AND p.rk = 1""")
def q_knn_classify(spark, sf):
    e = _emb_split(spark, sf)
    train, test = e.where(F.col("split") == "train"), e.where(F.col("split") == "test")
    pred = knn.knn_predict(train, test, id_col="vec_id", vec_col="embedding", target_col="label",
                           query_id="vec_id", k=5)
    return test.select("vec_id", "label").join(pred, "vec_id", "left")


@query("knn_regress", _EMB_SQL + """,
z AS (SELECT qid, max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) AS has0 FROM top GROUP BY qid),
w AS (SELECT top.qid, tl, CASE WHEN has0 = 1 THEN CAST(dist = 0 AS DOUBLE) ELSE 1 / dist END AS wt
      FROM top JOIN z ON z.qid = top.qid)
SELECT te.vec_id, te.label, round(sum(wt * tl) / sum(wt), 6) AS prediction
FROM te LEFT JOIN w ON w.qid = te.vec_id GROUP BY te.vec_id, te.label""")
def q_knn_regress(spark, sf):
    e = _emb_split(spark, sf)
    train, test = e.where(F.col("split") == "train"), e.where(F.col("split") == "test")
    pred = knn.knn_predict(train, test, id_col="vec_id", vec_col="embedding", target_col="label",
                           query_id="vec_id", k=5, weights="distance", task="regression")
    return round_all(test.select("vec_id", "label").join(pred, "vec_id", "left"))


# ------------------------------------------------------------------- Spark ML models
from kiln.operators import models as ml  # noqa: E402
from kiln.operators import prep  # noqa: E402
from kiln.operators.history import training_history  # noqa: E402
from kiln.plans.tables import LI_SQL, lineitem_nulls  # noqa: E402
from kiln.session import scratch_path  # noqa: E402

EMB_DIMS = 64


def _emb_features(spark, sf):
    """embeddings with every vector entry as a numeric feature column, split by key."""
    e = _emb_split(spark, sf)
    return e.select("vec_id", "label", "split",
                    *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(EMB_DIMS)])


FEATS = [f"f{i}" for i in range(EMB_DIMS)]


def _fit_predict(spark, sf, model_type, problem, **params):
    if problem == "regression":
        p = split_three_way(table(spark, sf, "part"), "p_partkey")
        feats, target, key = ["p_size", "p_partkey"], "p_retailprice", "p_partkey"
    else:
        p = _emb_features(spark, sf)
        if problem == "binary":
            p = p.withColumn("label", (F.col("label") >= 5).cast("int"))
        feats, target, key = FEATS, "label", "vec_id"
    m = ml.train_model(p.where(F.col("split") == "train"), feats, target, model_type, problem, **params)
    out = m.transform(p.where(F.col("split") == "test"))
    return out.select(key, F.col(target).alias("actual"), F.col("prediction").cast("double").alias("prediction"))


def _register_model(name, model_type, problem, **params):
    @query(name)
    def run(spark, sf):
        return _fit_predict(spark, sf, model_type, problem, **params)
    return run


# L1-L3 (classification and regression), L4-L8, L10 — rows-only checks (iterative fits).
_register_model("model_random_forest_cls", "random_forest", "multiclass", n_estimators=100)
_register_model("model_random_forest_reg", "random_forest", "regression", n_estimators=100)
_register_model("model_gbt_binary", "gradient_boosting", "binary", n_estimators=100)
_register_model("model_gbt_multiclass", "gradient_boosting", "multiclass", n_estimators=10)
_register_model("model_gbt_reg", "gradient_boosting", "regression", n_estimators=100)
_register_model("model_decision_tree_cls", "decision_tree", "multiclass")
_register_model("model_decision_tree_reg", "decision_tree", "regression")
_register_model("model_lasso", "lasso", "regression", alpha=1.0)
_register_model("model_logistic_binary", "logistic_regression", "binary", C=1.0)
_register_model("model_logistic_multiclass", "logistic_regression", "multiclass", C=1.0)
_register_model("model_svm_binary", "svm", "binary", C=1.0, kernel="linear")
_register_model("model_svm_multiclass", "svm", "multiclass", C=1.0, kernel="linear")
_register_model("model_neural_network", "neural_network", "multiclass", hidden_dims=[64, 32])

_PART_SPLIT = ("(SELECT *, (('0x' || substr(md5(CAST(p_partkey AS VARCHAR) || '#42'), 1, 8))::BIGINT) % 10000 AS b "
               "FROM part)")


@query("model_linear_regression", f"""WITH p AS {_PART_SPLIT},
tr AS (SELECT * FROM p WHERE b >= 3600),
c AS (SELECT regr_slope(p_retailprice, p_size) AS w, regr_intercept(p_retailprice, p_size) AS i FROM tr)
SELECT p_partkey, p_retailprice AS actual, round(i + w * p_size, 4) AS prediction FROM p, c WHERE b < 2000""")
def q_model_linear_regression(spark, sf):
    """L4: one-feature OLS, checked against the closed form."""
    p = split_three_way(table(spark, sf, "part"), "p_partkey")
    m = ml.train_model(p.where(F.col("split") == "train"), ["p_size"], "p_retailprice", "linear_regression",
                       "regression")
    out = m.transform(p.where(F.col("split") == "test"))
    return out.select("p_partkey", F.col("p_retailprice").alias("actual"),
                      F.round("prediction", 4).alias("prediction"))


@query("model_ridge", f"""WITH p AS {_PART_SPLIT},
tr AS (SELECT * FROM p WHERE b >= 3600),
m AS (SELECT avg(p_size) AS mx, avg(p_retailprice) AS my FROM tr),
c AS (SELECT sum((p_size - mx) * (p_retailprice - my)) / (sum((p_size - mx) * (p_size - mx)) + 1.0) AS w,
             any_value(mx) AS mx, any_value(my) AS my FROM tr, m)
SELECT p_partkey, p_retailprice AS actual, round(my + w * (p_size - mx), 4) AS prediction FROM p, c WHERE b < 2000""")
def q_model_ridge(spark, sf):
    """One-feature ridge (alpha = 1), checked against the closed form."""
    p = split_three_way(table(spark, sf, "part"), "p_partkey")
    m = ml.train_model(p.where(F.col("split") == "train"), ["p_size"], "p_retailprice", "ridge",
                       "regression", alpha=1.0)
    out = m.transform(p.where(F.col("split") == "test"))
    return out.select("p_partkey", F.col("p_retailprice").alias("actual"),
                      F.round("prediction", 4).alias("prediction"))


@query("train_val_scores")
def q_train_val_scores(spark, sf):
    """Accuracy and loss per split for a random forest on embeddings."""
    e = _emb_features(spark, sf)
    m = ml.train_model(e.where(F.col("split") == "train"), FEATS, "label", "random_forest", "multiclass",
                       n_estimators=100)
    return ml.train_val_scores(m, e.where(F.col("split") != "test"))


@query("feature_importance")
def q_feature_importance(spark, sf):
    """Impurity importance of a random forest predicting part prices."""
    p = split_three_way(table(spark, sf, "part"), "p_partkey")
    m = ml.train_model(p.where(F.col("split") == "train"), ["p_size", "p_partkey"], "p_retailprice",
                       "random_forest", "regression", n_estimators=100)
    return ml.feature_importance(m)


@query("model_roundtrip")
def q_model_roundtrip(spark, sf):
    """Save a fitted pipeline to the shared folder, load it, predict the test split."""
    e = _emb_features(spark, sf)
    m = ml.train_model(e.where(F.col("split") == "train"), FEATS, "label", "logistic_regression", "multiclass")
    path = scratch_path(spark, "model")
    ml.save_model(m, path)
    m2 = ml.load_model(spark, path)
    return m2.transform(e.where(F.col("split") == "test")).select("vec_id", "label", "prediction")


BATCH_STEPS = [
    {"operation": "missing_values", "strategy": "median", "columns": ["l_quantity", "l_discount", "l_tax"]},
    {"operation": "normalization", "method": "standard", "columns": ["l_quantity", "l_discount", "l_tax"]},
]


_LI_SPLIT_SQL = ("(SELECT li.*, (('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '#42'), 1, 8))::BIGINT) "
                 "% 10000 AS b FROM li)")


_BATCH3_SQL = f"""WITH li AS {LI_SQL}, sp AS {_LI_SPLIT_SQL},
tr AS (SELECT * FROM sp WHERE b >= 3600),
f1 AS (SELECT quantile_cont(l_quantity, 0.5) AS m_q, quantile_cont(l_discount, 0.5) AS m_d, quantile_cont(l_tax, 0.5) AS m_t FROM tr),
t1 AS (SELECT tr.* REPLACE (coalesce(l_quantity, m_q) AS l_quantity, coalesce(l_discount, m_d) AS l_discount, coalesce(l_tax, m_t) AS l_tax) FROM tr, f1),
f2 AS (SELECT avg(l_quantity) AS a_q, CASE WHEN stddev_pop(l_quantity) = 0 THEN 1.0 ELSE stddev_pop(l_quantity) END AS s_q, avg(l_discount) AS a_d, CASE WHEN stddev_pop(l_discount) = 0 THEN 1.0 ELSE stddev_pop(l_discount) END AS s_d, avg(l_tax) AS a_t, CASE WHEN stddev_pop(l_tax) = 0 THEN 1.0 ELSE stddev_pop(l_tax) END AS s_t FROM t1),
t2 AS (SELECT t1.* REPLACE ((l_quantity - a_q) / s_q AS l_quantity, (l_discount - a_d) / s_d AS l_discount, (l_tax - a_t) / s_t AS l_tax) FROM t1, f2),
m AS (SELECT avg(l_quantity) AS x1, avg(l_discount) AS x2, avg(l_tax) AS x3, avg(l_extendedprice) AS ym FROM t2),
c AS (SELECT sum((l_quantity - x1) * (l_quantity - x1)) AS a11, sum((l_quantity - x1) * (l_discount - x2)) AS a12, sum((l_quantity - x1) * (l_tax - x3)) AS a13, sum((l_quantity - x1) * (l_extendedprice - ym)) AS b1, sum((l_discount - x2) * (l_discount - x2)) AS a22, sum((l_discount - x2) * (l_tax - x3)) AS a23, sum((l_discount - x2) * (l_extendedprice - ym)) AS b2, sum((l_tax - x3) * (l_tax - x3)) AS a33, sum((l_tax - x3) * (l_extendedprice - ym)) AS b3, any_value(x1) AS x1, any_value(x2) AS x2, any_value(x3) AS x3, any_value(ym) AS ym FROM t2, m),
w AS (SELECT (b1 * (a22 * a33 - a23 * a23) - a12 * (b2 * a33 - a23 * b3) + a13 * (b2 * a23 - a22 * b3)) / (a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13)) AS w1, (a11 * (b2 * a33 - a23 * b3) - b1 * (a12 * a33 - a23 * a13) + a13 * (a12 * b3 - b2 * a13)) / (a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13)) AS w2, (a11 * (a22 * b3 - b2 * a23) - a12 * (a12 * b3 - b2 * a13) + b1 * (a12 * a23 - a22 * a13)) / (a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13)) AS w3, x1, x2, x3, ym FROM c)
SELECT l_orderkey, l_linenumber, l_extendedprice, round(ym + w1 * ((coalesce(l_quantity, m_q) - a_q) / s_q - x1) + w2 * ((coalesce(l_discount, m_d) - a_d) / s_d - x2) + w3 * ((coalesce(l_tax, m_t) - a_t) / s_t - x3), 4) AS prediction
FROM sp, f1, f2, w WHERE b < 3600"""


@query("batch_score", _BATCH3_SQL)
def q_batch_score(spark, sf):
    """Rules and a model fitted on the train split, replayed on the other rows."""
    df = split_three_way(lineitem_nulls(spark, sf), "l_orderkey")
    train = df.where(F.col("split") == "train")
    rules, prepared = prep.fit_pipeline(train, BATCH_STEPS)
    m = ml.train_model(prepared, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice",
                       "linear_regression", "regression")
    scored = ml.batch_score(df.where(F.col("split") != "train"), rules, m)
    return scored.select("l_orderkey", "l_linenumber", "l_extendedprice",
                         F.round("prediction", 4).alias("prediction"))


_OLS_SQL = f"""WITH p AS {_PART_SPLIT},
tr AS (SELECT * FROM p WHERE b >= 3600),
c AS (SELECT regr_slope(p_retailprice, p_size) AS w, regr_intercept(p_retailprice, p_size) AS i FROM tr)"""


def _ols_part(spark, sf):
    p = split_three_way(table(spark, sf, "part"), "p_partkey")
    m = ml.train_model(p.where(F.col("split") == "train"), ["p_size"], "p_retailprice", "linear_regression",
                       "regression")
    return p, m


@query("feature_importance_linear", _OLS_SQL + """
SELECT 'p_size' AS feature, round(abs(w), 4) AS importance FROM c""")
def q_feature_importance_linear(spark, sf):
    """E12 for a linear model: |coefficient| per feature."""
    _, m = _ols_part(spark, sf)
    return ml.feature_importance(m).select("feature", F.round("importance", 4).alias("importance"))


@query("train_val_scores_linear", _OLS_SQL + """
SELECT 'linear_regression' AS model, CASE WHEN b >= 3600 THEN 'train' ELSE 'validation' END AS split,
       CAST(NULL AS DOUBLE) AS accuracy, round(avg((i + w * p_size - p_retailprice) * (i + w * p_size - p_retailprice)), 4) AS loss
FROM p, c WHERE b >= 2000 GROUP BY 2""")
def q_train_val_scores_linear(spark, sf):
    """E13 for a regression model: MSE per split."""
    p, m = _ols_part(spark, sf)
    s = ml.train_val_scores(m, p.where(F.col("split") != "test"))
    return s.select("model", "split", "accuracy", F.round("loss", 4).alias("loss"))


@query("model_roundtrip_linear", _OLS_SQL + """
SELECT p_partkey, p_retailprice AS actual, round(i + w * p_size, 4) AS prediction FROM p, c WHERE b < 2000""")
def q_model_roundtrip_linear(spark, sf):
    """S6 with a value check: save, load and apply a one-feature OLS pipeline."""
    p, m = _ols_part(spark, sf)
    path = scratch_path(spark, "ols")
    ml.save_model(m, path)
    out = ml.load_model(spark, path).transform(p.where(F.col("split") == "test"))
    return out.select("p_partkey", F.col("p_retailprice").alias("actual"), F.round("prediction", 4).alias("prediction"))


@query("model_lasso_closed_form", f"""WITH p AS {_PART_SPLIT},
tr AS (SELECT * FROM p WHERE b >= 3600),
m AS (SELECT avg(p_size) AS mx, avg(p_retailprice) AS my, count(*) AS n FROM tr),
z AS (SELECT sum((p_size - mx) * (p_retailprice - my)) / any_value(n) AS sxy,
             sum((p_size - mx) * (p_size - mx)) / any_value(n) AS sxx, any_value(mx) AS mx, any_value(my) AS my
      FROM tr, m),
c AS (SELECT sign(sxy) * greatest(abs(sxy) - 1.0, 0) / sxx AS w, mx, my FROM z)
SELECT p_partkey, p_retailprice AS actual, round(my + w * (p_size - mx), 4) AS prediction FROM p, c WHERE b < 2000""")
def q_model_lasso_closed_form(spark, sf):
    """One-feature lasso (alpha = 1), checked against the soft-threshold closed form."""
    p = split_three_way(table(spark, sf, "part"), "p_partkey")
    m = ml.train_model(p.where(F.col("split") == "train"), ["p_size"], "p_retailprice", "lasso",
                       "regression", alpha=1.0)
    out = m.transform(p.where(F.col("split") == "test"))
    return out.select("p_partkey", F.col("p_retailprice").alias("actual"),
                      F.round("prediction", 4).alias("prediction"))


BATCH_STEPS_1 = [
    {"operation": "missing_values", "strategy": "median", "columns": ["l_quantity"]},
    {"operation": "normalization", "method": "standard", "columns": ["l_quantity"]},
]


@query("batch_score_linear", f"""WITH li AS {LI_SQL}, sp AS {_LI_SPLIT_SQL},
tr AS (SELECT * FROM sp WHERE b >= 3600),
f1 AS (SELECT quantile_cont(l_quantity, 0.5) AS med FROM tr),
t1 AS (SELECT tr.* REPLACE (coalesce(l_quantity, med) AS l_quantity) FROM tr, f1),
f2 AS (SELECT avg(l_quantity) AS m, CASE WHEN stddev_pop(l_quantity) = 0 THEN 1.0 ELSE stddev_pop(l_quantity) END AS s FROM t1),
t2 AS (SELECT t1.* REPLACE ((l_quantity - m) / s AS l_quantity) FROM t1, f2),
c AS (SELECT regr_slope(l_extendedprice, l_quantity) AS w, regr_intercept(l_extendedprice, l_quantity) AS i FROM t2)
SELECT l_orderkey, l_linenumber, l_extendedprice,
       round(i + w * ((coalesce(l_quantity, med) - m) / s), 4) AS prediction
FROM sp, f1, f2, c WHERE b < 3600""")
def q_batch_score_linear(spark, sf):
    """E15 with a value check: rules and a one-feature OLS fitted on the train split, both
    replayed on the other rows."""
    df = split_three_way(lineitem_nulls(spark, sf), "l_orderkey")
    rules, prepared = prep.fit_pipeline(df.where(F.col("split") == "train"), BATCH_STEPS_1)
    m = ml.train_model(prepared, ["l_quantity"], "l_extendedprice", "linear_regression", "regression")
    scored = ml.batch_score(df.where(F.col("split") != "train"), rules, m)
    return scored.select("l_orderkey", "l_linenumber", "l_extendedprice",
                         F.round("prediction", 4).alias("prediction"))



@query("model_knn", _EMB_SQL + """,
v AS (SELECT qid, tl, count(*) AS n FROM top GROUP BY qid, tl),
p AS (SELECT qid, tl AS pred, row_number() OVER (PARTITION BY qid ORDER BY n DESC, tl) AS rk FROM v)
SELECT te.vec_id, te.label AS actual, CAST(p.pred AS DOUBLE) AS prediction
FROM te LEFT JOIN p ON p.qid = te.vec_id AND p.rk = 1""")
def q_model_knn(spark, sf):
    """L9 through the model interface: the 64 embedding entries as feature columns, k = 5."""
    return _fit_predict(spark, sf, "knn", "multiclass", n_neighbors=5)


@query("train_val_scores_knn", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
        (('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '#42'), 1, 8))::BIGINT) % 10000 AS b FROM embeddings),
tr AS (SELECT * FROM e WHERE b >= 3600),
q AS (SELECT *, CASE WHEN b >= 3600 THEN 'train' ELSE 'validation' END AS split FROM e WHERE b >= 2000),
d AS (SELECT q.vec_id AS qid, q.split, q.label AS ql, tr.vec_id AS tid, tr.label AS tl,
             sqrt(list_sum(list_transform(list_zip(q.v, tr.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist
      FROM q, tr),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rn FROM d),
v AS (SELECT qid, split, ql, tl, count(*) AS n FROM r WHERE rn <= 5 GROUP BY qid, split, ql, tl),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, tl) AS rk FROM v)
SELECT 'knn' AS model, split, round(avg(CAST(tl = ql AS DOUBLE)), 6) AS accuracy,
       round(1 - avg(CAST(tl = ql AS DOUBLE)), 6) AS loss
FROM p WHERE rk = 1 GROUP BY split""")
def q_train_val_scores_knn(spark, sf):
    """E13 for a classifier with a value check: exact k-NN accuracy and 1 - accuracy per split."""
    e = _emb_features(spark, sf)
    m = ml.train_model(e.where(F.col("split") == "train"), FEATS, "label", "knn", "multiclass", n_neighbors=5)
    s = ml.train_val_scores(m, e.where(F.col("split") != "test"))
    return s.select("model", "split", F.round("accuracy", 6).alias("accuracy"), F.round("loss", 6).alias("loss"))


def _stream_batch_score_sql():
    return ORACLE["batch_score_linear"]


@query("stream_batch_score", _stream_batch_score_sql())
def q_stream_batch_score(spark, sf):
    """E15 on a stream: rules and a one-feature OLS fitted in batch on the train split score the
    held-out lineitem rows arriving through Structured Streaming (file source -> split ->
    rules -> model -> parquet sink)."""
    from kiln.plans.tables import inject_li_nulls
    from kiln.streaming.replay import stream_apply_rules
    df = split_three_way(lineitem_nulls(spark, sf), "l_orderkey")
    rules, prepared = prep.fit_pipeline(df.where(F.col("split") == "train"), BATCH_STEPS_1)
    m = ml.train_model(prepared, ["l_quantity"], "l_extendedprice", "linear_regression", "regression")
    src = table(spark, sf, "lineitem")

    def held_out(stream):
        s = split_three_way(inject_li_nulls(stream), "l_orderkey")
        return s.where(F.col("split") != "train").drop("split")
    out = stream_apply_rules(spark, f"{sf.rstrip('/')}/lineitem*.parquet", src.schema, rules,
                             prepare=held_out, model=m)
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice",
                      F.round("prediction", 4).alias("prediction"))


# ------------------------------------------ models against closed forms
# One feature, one split: the best threshold of a stump in SQL, with all thresholds tried.
_STUMP_SQL = f"""WITH p AS {_PART_SPLIT},
tr AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM p WHERE b >= 3600),
t AS (SELECT DISTINCT x, lead(x) OVER (ORDER BY x) AS nx FROM (SELECT DISTINCT x FROM tr)),
g AS (SELECT (t.x + nx) / 2 AS cut, avg(y) FILTER (tr.x <= t.x) AS lo, avg(y) FILTER (tr.x > t.x) AS hi,
             count(*) FILTER (tr.x <= t.x) AS nl, count(*) FILTER (tr.x > t.x) AS nh
      FROM t, tr WHERE nx IS NOT NULL GROUP BY t.x, nx),
best AS (SELECT * FROM g ORDER BY nl * lo * lo + nh * hi * hi DESC LIMIT 1)"""
_STUMP_OUT = """
SELECT p_partkey, p_retailprice AS actual, round(CASE WHEN p_size <= cut THEN lo ELSE hi END, 4) AS prediction FROM p, best WHERE b < 2000"""
_BINS = 64                                       # more than the 50 sizes, so that every threshold is tried


def _part_prediction(spark, sf, model_type, **params):
    p = split_three_way(table(spark, sf, "part"), "p_partkey")
    m = ml.train_model(p.where(F.col("split") == "train"), ["p_size"], "p_retailprice", model_type, "regression", **params)
    return m.transform(p.where(F.col("split") == "test")).select(
        "p_partkey", F.col("p_retailprice").alias("actual"), F.round("prediction", 4).alias("prediction"))


@query("model_decision_tree_stump", _STUMP_SQL + _STUMP_OUT)
def q_model_decision_tree_stump(spark, sf):
    """L3: a tree of one split, checked against the best of all thresholds."""
    return _part_prediction(spark, sf, "decision_tree", max_depth=1, max_bins=_BINS)


@query("model_random_forest_stump", _STUMP_SQL + _STUMP_OUT)
def q_model_random_forest_stump(spark, sf):
    """L1: a forest of one tree of one split (without resampling it takes every row)."""
    return _part_prediction(spark, sf, "random_forest", n_estimators=1, max_depth=1, max_bins=_BINS, bootstrap=False)


@query("model_gbt_two_stumps", _STUMP_SQL + """,
r AS (SELECT x, 2 * (y - CASE WHEN x <= cut THEN lo ELSE hi END) AS y FROM tr, best),
g2 AS (SELECT (t.x + nx) / 2 AS cut, avg(y) FILTER (r.x <= t.x) AS lo, avg(y) FILTER (r.x > t.x) AS hi,
              count(*) FILTER (r.x <= t.x) AS nl, count(*) FILTER (r.x > t.x) AS nh
       FROM t, r WHERE nx IS NOT NULL GROUP BY t.x, nx),
best2 AS (SELECT * FROM g2 ORDER BY nl * lo * lo + nh * hi * hi DESC LIMIT 1)
SELECT p_partkey, p_retailprice AS actual,
       round(CASE WHEN p_size <= best.cut THEN best.lo ELSE best.hi END
             + 0.1 * CASE WHEN p_size <= best2.cut THEN best2.lo ELSE best2.hi END, 4) AS prediction
FROM p, best, best2 WHERE b < 2000""")
def q_model_gbt_two_stumps(spark, sf):
    """L2: two rounds of boosting with stumps; the second fits the loss's gradient at the first."""
    return _part_prediction(spark, sf, "gradient_boosting", n_estimators=2, learning_rate=0.1, max_depth=1, max_bins=_BINS)


# One feature of two values: the optimum of a classifier is each group's own class shares.
_GROUP_SQL = """WITH e AS (SELECT vec_id, CAST(embedding[1] > 0 AS INTEGER) AS x, {y} AS y,
        (('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '#42'), 1, 8))::BIGINT) % 10000 AS b FROM embeddings),
g AS (SELECT x, avg(y) AS p FROM e WHERE b >= 3600 GROUP BY x)"""
_HALF = "CAST(label >= 5 AS INTEGER)"


def _group_model(spark, sf, model_type, target, **params):
    e = _emb_split(spark, sf).select("vec_id", "split", (F.col("embedding")[0] > 0).cast("int").alias("x"), target.cast("int").alias("y"))
    m = ml.train_model(e.where(F.col("split") == "train"), ["x"], "y", model_type, "binary", **params)
    return m.transform(e.where(F.col("split") == "test"))


@query("model_logistic_saturated", _GROUP_SQL.format(y=_HALF) + """
SELECT vec_id, e.x, round(p, 3) AS p1, CAST(p > 0.5 AS DOUBLE) AS prediction FROM e JOIN g USING (x) WHERE b < 2000""")
def q_model_logistic_saturated(spark, sf):
    """With one two-valued feature and next to no penalty the probabilities are the class shares."""
    out = _group_model(spark, sf, "logistic_regression", F.col("label") >= 5, C=1e9)
    return out.select("vec_id", "x", F.round("p1", 3).alias("p1"), "prediction")


@query("model_perceptron_saturated", _GROUP_SQL.format(y=_HALF) + """
SELECT vec_id, e.x, round(p, 3) AS p1, CAST(p > 0.5 AS DOUBLE) AS prediction FROM e JOIN g USING (x) WHERE b < 2000""")
def q_model_perceptron_saturated(spark, sf):
    """Without hidden units the network's zero-gradient point is the same class shares."""
    out = _group_model(spark, sf, "neural_network", F.col("label") >= 5, hidden_dims=[], max_iter=500, tol=1e-9, block_size=1)
    return out.select("vec_id", "x", F.round("p1", 3).alias("p1"), "prediction")


# A target that mostly follows the feature: the hinge loss is least at margins -1 and 1.
_MOSTLY = "CASE WHEN vec_id % 10 = 0 THEN 1 - CAST(embedding[1] > 0 AS INTEGER) ELSE CAST(embedding[1] > 0 AS INTEGER) END"


@query("model_svm_two_points", _GROUP_SQL.format(y=_MOSTLY) + """
SELECT vec_id, x, CAST(2 * x - 1 AS DOUBLE) AS margin, CAST(x AS DOUBLE) AS prediction FROM e WHERE b < 2000""")
def q_model_svm_two_points(spark, sf):
    """With one two-valued feature and next to no penalty the separating line has margins -1 and 1."""
    from pyspark.ml.functions import vector_to_array
    x = (F.col("embedding")[0] > 0).cast("int")
    out = _group_model(spark, sf, "svm", F.when(F.col("vec_id") % 10 == 0, 1 - x).otherwise(x), C=100.0, max_iter=500)
    return out.select("vec_id", "x", F.round(vector_to_array("rawPrediction")[1], 1).alias("margin"), "prediction")


# ------------------------------------------ probabilities, history, saved neighbours
@query("knn_probability", _EMB_SQL + """
SELECT te.vec_id, CAST(te.label >= 5 AS INTEGER) AS label, round(avg(CAST(tl >= 5 AS DOUBLE)), 6) AS p1
FROM te JOIN top ON top.qid = te.vec_id GROUP BY te.vec_id, te.label""")
def q_knn_probability(spark, sf):
    """E2 for k-NN: the share of the five neighbours that are of class 1."""
    p = _emb_features(spark, sf).withColumn("label", (F.col("label") >= 5).cast("int"))
    m = ml.train_model(p.where(F.col("split") == "train"), FEATS, "label", "knn", "binary", n_neighbors=5)
    return m.transform(p.where(F.col("split") == "test")).select("vec_id", "label", F.round("p1", 6).alias("p1"))


@query("model_roundtrip_knn", ORACLE["model_knn"])
def q_model_roundtrip_knn(spark, sf):
    """S6 for k-NN: the index saved by cell, loaded, and probed for the test rows."""
    e = _emb_features(spark, sf)
    m = ml.train_model(e.where(F.col("split") == "train"), FEATS, "label", "knn", "multiclass", n_neighbors=5)
    path = ml.save_model(m, scratch_path(spark, "knn"))
    out = ml.load_model(spark, path).transform(e.where(F.col("split") == "test"))
    return out.select("vec_id", F.col("label").alias("actual"), F.col("prediction").cast("double").alias("prediction"))


@query("svm_probability")
def q_svm_probability(spark, sf):
    """E2 for the SVM: probabilities from a logistic curve over margins, fitted on the validation rows."""
    p = _emb_features(spark, sf).withColumn("label", (F.col("label") >= 5).cast("int"))
    part = lambda s: p.where(F.col("split") == s)
    m = ml.train_model(part("train"), FEATS, "label", "svm", "binary", calibration=part("validation"))
    return m.transform(part("test")).select("vec_id", "label", "p1", "prediction")


@query("training_history_gbt", _STUMP_SQL + """,
r AS (SELECT x, 2 * (y - CASE WHEN x <= cut THEN lo ELSE hi END) AS y FROM tr, best),
g2 AS (SELECT (t.x + nx) / 2 AS cut, avg(y) FILTER (r.x <= t.x) AS lo, avg(y) FILTER (r.x > t.x) AS hi,
              count(*) FILTER (r.x <= t.x) AS nl, count(*) FILTER (r.x > t.x) AS nh
       FROM t, r WHERE nx IS NOT NULL GROUP BY t.x, nx),
best2 AS (SELECT * FROM g2 ORDER BY nl * lo * lo + nh * hi * hi DESC LIMIT 1),
s AS (SELECT CASE WHEN b >= 3600 THEN 'train' ELSE 'validation' END AS split, p_retailprice AS y,
             CASE WHEN p_size <= best.cut THEN best.lo ELSE best.hi END AS f1,
             0.1 * CASE WHEN p_size <= best2.cut THEN best2.lo ELSE best2.hi END AS f2 FROM p, best, best2 WHERE b >= 2000)
SELECT 'gradient_boosting' AS model, split, round, 'loss' AS metric, round(value, 4) AS value
FROM (SELECT split, 1 AS round, avg((y - f1) * (y - f1)) AS value FROM s GROUP BY split
      UNION ALL SELECT split, 2, avg((y - f1 - f2) * (y - f1 - f2)) FROM s GROUP BY split)""")
def q_training_history_gbt(spark, sf):
    """E13 by round: the loss of two boosting rounds on the training and validation rows."""
    p = split_three_way(table(spark, sf, "part"), "p_partkey")
    m = ml.train_model(p.where(F.col("split") == "train"), ["p_size"], "p_retailprice", "gradient_boosting", "regression",
                       n_estimators=2, learning_rate=0.1, max_depth=1, max_bins=_BINS)
    h = training_history(m, p.where(F.col("split") != "test"))
    return h.select("model", "split", "round", "metric", F.round("value", 4).alias("value"))
