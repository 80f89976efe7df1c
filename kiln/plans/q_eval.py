"""Evaluation plans: E1-E11, E14 and the M1 split.  Scores come from table expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions.columns import round_all
from kiln.functions.scores import softmax, to_double_array
from kiln.operators import evaluate as ev
from kiln.operators.split import split_three_way
from kiln.plans.registry import query
from kiln.plans.tables import table

D = "CAST({} AS DOUBLE)".format


def _scored(spark, sf):
    """labels joined to documents: truth = quality, logit z = ln(n_chars) - 7, score = n_chars / 1000."""
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    doc = table(spark, sf, "documents").select("doc_id", "n_chars")
    j = lab.join(doc, "doc_id")
    return j.select("doc_id", "quality", "toxic", (F.log(F.col("n_chars").cast("double")) - 7.0).alias("z"),
                    (F.col("n_chars").cast("double") / 1000.0).alias("score"))


_SCORED_SQL = ("(SELECT l.doc_id, l.quality, l.toxic, ln(CAST(d.n_chars AS DOUBLE)) - 7.0 AS z, "
               "CAST(d.n_chars AS DOUBLE) / 1000.0 AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)")


@query("predict_threshold", f"SELECT doc_id, quality, round(1 / (1 + exp(-z)), 6) AS prob, "
       f"CAST(1 / (1 + exp(-z)) > 0.5 AS INTEGER) AS pred FROM {_SCORED_SQL} s")
def q_predict_threshold(spark, sf):
    s = _scored(spark, sf)
    return round_all(s.select("doc_id", "quality", (1 / (1 + F.exp(-F.col("z")))).alias("prob"),
                              ev.predict_binary(F.col("z")).alias("pred")))


def _logits(spark, sf):
    """Ten logits per embedding from the whole vector: z[j] = sum of the entries whose
    0-based index is j mod 10."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", to_double_array(F.col("embedding")).alias("v"))

    def in_class(j):
        return lambda x, i: i % 10 == j
    z = F.array(*[F.aggregate(F.filter("v", in_class(j)), F.lit(0.0), lambda a, x: a + x) for j in range(10)])
    return e.select("vec_id", "label", z.alias("z"))


_LOGITS_SQL = ("(SELECT vec_id, label, [" + ", ".join(
    f"list_sum(list_filter(v, lambda x, i: (i - 1) % 10 = {j}))" for j in range(10)) +
    "] AS z FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v "
    "FROM embeddings))")
_LSE = "(list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))))"


@query("predict_argmax", f"SELECT vec_id, label, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred "
       f"FROM {_LOGITS_SQL} t")
def q_predict_argmax(spark, sf):
    t = _logits(spark, sf)
    return t.select("vec_id", "label", ev.predict_argmax(F.col("z")).alias("pred"))


@query("softmax_scores", f"SELECT vec_id, label, round(exp(list_max(z) - {_LSE}), 6) AS p_max, "
       f"round(exp(z[label + 1] - {_LSE}), 6) AS p_label FROM {_LOGITS_SQL} t")
def q_softmax_scores(spark, sf):
    t = _logits(spark, sf).withColumn("p", softmax(F.col("z")))
    return round_all(t.select("vec_id", "label", F.array_max("p").alias("p_max"),
                              F.element_at("p", F.col("label") + 1).alias("p_label")))


@query("accuracy", "SELECT round(avg(CAST(quality = 1 - toxic AS DOUBLE)), 6) AS accuracy FROM labels")
def q_accuracy(spark, sf):
    lab = table(spark, sf, "labels").withColumn("pred", 1 - F.col("toxic"))
    return round_all(ev.accuracy(lab, "quality", "pred"))


_CM_SQL = """WITH d AS (SELECT quality AS t, 1 - toxic AS p FROM labels),
lab AS (SELECT t AS l FROM d UNION SELECT p FROM d),
c AS (SELECT t, p, count(*) AS n FROM d GROUP BY t, p)"""


@query("confusion_matrix", _CM_SQL + """
SELECT a.l AS y_true, b.l AS y_pred, coalesce(c.n, 0) AS count
FROM lab a CROSS JOIN lab b LEFT JOIN c ON c.t = a.l AND c.p = b.l""")
def q_confusion_matrix(spark, sf):
    lab = table(spark, sf, "labels").withColumn("pred", 1 - F.col("toxic"))
    return ev.confusion_matrix(lab, "quality", "pred")


@query("classification_report", _CM_SQL + """,
per AS (SELECT l AS c, (SELECT count(*) FROM d WHERE t = l AND p = l) AS tp,
               (SELECT count(*) FROM d WHERE t = l) AS support, (SELECT count(*) FROM d WHERE p = l) AS npred
        FROM lab),
m AS (SELECT c, tp, support, CASE WHEN npred = 0 THEN 0.0 ELSE tp / npred END AS pr,
             CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rc FROM per),
f AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END AS f1 FROM m)
SELECT CAST(c AS VARCHAR) AS label, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1_score,
       support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(rc), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT)
          FROM f
UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(rc * support) / sum(support), 6),
          round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def q_classification_report(spark, sf):
    lab = table(spark, sf, "labels").withColumn("pred", 1 - F.col("toxic"))
    return round_all(ev.classification_report(lab, "quality", "pred"))


_CURVE_SQL = f"""WITH s AS (SELECT score AS threshold, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS pos,
                  sum(CASE WHEN quality <> 1 THEN 1 ELSE 0 END) AS neg FROM {_SCORED_SQL} x GROUP BY score),
r AS (SELECT threshold, pos, neg, sum(pos) OVER (ORDER BY threshold DESC) AS cp,
             sum(neg) OVER (ORDER BY threshold DESC) AS cn FROM s),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM s)"""


@query("roc_curve", _CURVE_SQL + """
SELECT CAST('inf' AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
UNION ALL SELECT round(threshold, 6), round(cn / N, 6), round(cp / P, 6) FROM r, t""")
def q_roc_curve(spark, sf):
    return round_all(ev.roc_curve(_scored(spark, sf), "quality", "score"))


@query("auc", _CURVE_SQL + """
SELECT round(sum((neg / N) * ((2 * cp - pos) / (2 * P))), 6) AS auc FROM r, t""")
def q_auc(spark, sf):
    return round_all(ev.auc(_scored(spark, sf), "quality", "score"))


@query("pr_curve", _CURVE_SQL + """
SELECT round(threshold, 6) AS threshold, round(cp / (cp + cn), 6) AS precision, round(cp / P, 6) AS recall FROM r, t
UNION ALL SELECT NULL, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)""")
def q_pr_curve(spark, sf):
    return round_all(ev.pr_curve(_scored(spark, sf), "quality", "score"))


@query("pr_mean_precision", _CURVE_SQL + """
SELECT round((sum(cp / (cp + cn)) + 1) / (count(*) + 1), 6) AS mean_precision,
       round(sum((cp / (cp + cn)) * pos / P), 6) AS average_precision FROM r, t""")
def q_pr_mean_precision(spark, sf):
    return round_all(ev.pr_summary(_scored(spark, sf), "quality", "score"))


def _priced(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", "p_retailprice", (F.lit(900.0) + F.lit(10.0) * F.col("p_size")).alias("yhat"))


_PRICED_SQL = "(SELECT p_partkey, p_retailprice AS y, CAST(900 AS DOUBLE) + CAST(10 AS DOUBLE) * p_size AS yhat FROM part)"


@query("regression_metrics", f"""SELECT round(avg(abs(y - yhat)), 6) AS mae, round(avg((y - yhat) * (y - yhat)), 6) AS mse,
  round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse,
  round(CASE WHEN var_pop(y) = 0 THEN (CASE WHEN sum((y - yhat) * (y - yhat)) = 0 THEN 1 ELSE 0 END)
        ELSE 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) END, 6) AS r2 FROM {_PRICED_SQL} t""")
def q_regression_metrics(spark, sf):
    return round_all(ev.regression_metrics(_priced(spark, sf), "p_retailprice", "yhat"))


@query("residuals", f"SELECT p_partkey, round(y, 6) AS actual, round(yhat, 6) AS predicted, "
       f"round(y - yhat, 6) AS residual FROM {_PRICED_SQL} t")
def q_residuals(spark, sf):
    return round_all(ev.residuals(_priced(spark, sf), "p_retailprice", "yhat", keep=["p_partkey"]))


@query("actual_vs_predicted_bounds", f"SELECT round(least(min(y), min(yhat)), 6) AS lo, "
       f"round(greatest(max(y), max(yhat)), 6) AS hi FROM {_PRICED_SQL} t")
def q_actual_vs_predicted_bounds(spark, sf):
    return round_all(ev.actual_vs_predicted_bounds(_priced(spark, sf), "p_retailprice", "yhat"))


@query("bce_logits_loss", f"SELECT round(avg(greatest(z, 0) - z * quality + ln(1 + exp(-abs(z)))), 6) AS loss "
       f"FROM {_SCORED_SQL} s")
def q_bce_logits_loss(spark, sf):
    return round_all(ev.bce_logits_loss(_scored(spark, sf), "z", "quality"))


@query("cross_entropy_loss", f"SELECT round(avg({_LSE} - z[label + 1]), 6) AS loss FROM {_LOGITS_SQL} t")
def q_cross_entropy_loss(spark, sf):
    return round_all(ev.cross_entropy_loss(_logits(spark, sf), "z", "label"))


@query("mse_loss", f"SELECT round(avg((y - yhat) * (y - yhat)), 6) AS loss FROM {_PRICED_SQL} t")
def q_mse_loss(spark, sf):
    return round_all(ev.mse_loss(_priced(spark, sf), "p_retailprice", "yhat"))


@query("split_three_way", "SELECT o_orderkey, CASE WHEN b < 2000 THEN 'test' WHEN b < 3600 THEN 'validation' "
       "ELSE 'train' END AS split FROM (SELECT o_orderkey, "
       "(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '#42'), 1, 8))::BIGINT) % 10000 AS b FROM orders)")
def q_split_three_way(spark, sf):
    return split_three_way(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
