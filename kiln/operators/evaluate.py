"""Prediction rules and evaluation tables (E1-E11, E14); rows stay distributed.

Curves (ROC, precision-recall) collapse rows to one per distinct score and take running
positive/negative counts by score range (see ``ordered.running_totals``); every metric is
then an aggregate or a projection of those few columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kiln.functions.columns import qcol
from kiln.functions.scores import argmax, bce_with_logits, cross_entropy_logits, sigmoid, softmax
from kiln.operators.ordered import running_totals
from kiln.session import checkpoint_dir


# ----------------------------------------------------------------------- predictions
def predict_binary(z: Column) -> Column:
    """Class 1 when sigmoid(z) > 0.5 (strict)."""
    return (sigmoid(z) > F.lit(0.5)).cast("int")


def predict_argmax(scores: Column) -> Column:
    """First position of the maximum score."""
    return argmax(scores)


def class_probabilities(scores: Column) -> Column:
    """Softmax over the score array."""
    return softmax(scores)


# ------------------------------------------------------------------- classification
def accuracy(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Share of rows with y = yhat."""
    return df.agg(F.avg((qcol(y) == qcol(yhat)).cast("double")).alias("accuracy"))


def _cells(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Counts of the (y_true, y_pred) cells that occur."""
    return df.groupBy(qcol(y).alias("y_true"), qcol(yhat).alias("y_pred")).agg(F.count(F.lit(1)).alias("count"))


def confusion_matrix(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """(y_true, y_pred, count) over the sorted union of labels, zero cells included.

    Counting is one partially aggregated shuffle.  Each label's row of the k x k zero grid is
    generated from one sorted array of all labels, in the task that holds the label.
    """
    counts = _cells(df, y, yhat)
    labels = (counts.select(F.col("y_true").alias("l")).union(counts.select(F.col("y_pred").alias("l")))
              .where(F.col("l").isNotNull()).distinct())
    every = labels.agg(F.array_sort(F.collect_set("l"))).scalar()
    grid = labels.withColumn("all", every).select(F.col("l").alias("y_true"), F.explode("all").alias("y_pred"))
    out = grid.join(counts, ["y_true", "y_pred"], "left")
    return out.select("y_true", "y_pred", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def classification_report(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """E5: precision, recall, F1, support per class plus accuracy, macro and weighted rows.

    0/0 is 0.  Class rows are labelled by the class value as text.
    """
    counts = _cells(df, y, yhat)
    # a row with one label missing names a class but is not counted
    seen = F.when(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull(), F.col("count")).otherwise(F.lit(0)).cast("long")
    none = F.lit(0).cast("long")
    hit = F.when(F.col("y_true") == F.col("y_pred"), seen).otherwise(none)
    t = (counts.select(F.col("y_true").alias("c"), hit.alias("tp"), seen.alias("support"), none.alias("npred"))
         .union(counts.select(F.col("y_pred").alias("c"), none.alias("tp"), none.alias("support"), seen.alias("npred")))
         .where(F.col("c").isNotNull()).groupBy("c")
         .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("npred").alias("npred")))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("npred")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    t = t.select(F.col("c").cast("string").alias("label"), prec.alias("precision"), rec.alias("recall"),
                 "support", "tp")
    t = t.withColumn("f1_score", F.coalesce(F.try_divide(
        2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    classes = t.select("label", "precision", "recall", "f1_score", F.col("support").cast("long"))
    tot = t.agg(F.sum("tp").alias("tp"), F.sum("support").alias("n"),
                F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
                F.sum(F.col("precision") * F.col("support")).alias("wp"),
                F.sum(F.col("recall") * F.col("support")).alias("wr"),
                F.sum(F.col("f1_score") * F.col("support")).alias("wf"))
    n = F.col("n")
    acc = tot.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"),
                     F.coalesce(F.try_divide(F.col("tp").cast("double"), n), F.lit(0.0)).alias("f1_score"),
                     n.cast("long").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1_score"), n.cast("long").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("label"),
                          F.coalesce(F.try_divide(F.col("wp"), n), F.lit(0.0)).alias("precision"),
                          F.coalesce(F.try_divide(F.col("wr"), n), F.lit(0.0)).alias("recall"),
                          F.coalesce(F.try_divide(F.col("wf"), n), F.lit(0.0)).alias("f1_score"),
                          n.cast("long").alias("support"))
    return classes.unionByName(acc).unionByName(macro).unionByName(weighted)


# ------------------------------------------------------------------------- curves
def _score_counts(df: DataFrame, y: str, score: str) -> DataFrame:
    s = qcol(score).cast("double")
    return df.where(s.isNotNull() & qcol(y).isNotNull()).groupBy(s.alias("threshold")).agg(
        F.sum((qcol(y) == 1).cast("long")).alias("pos"),
        F.sum((qcol(y) != 1).cast("long")).alias("neg"))


def _curve_base(df: DataFrame, y: str, score: str) -> tuple[DataFrame, int, int]:
    sc = _score_counts(df, y, score)
    tot = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.count(F.lit(1)).alias("k")).collect()[0]
    rt = running_totals(sc, "threshold", ["pos", "neg"], descending=True, n_rows=tot["k"])
    return rt, tot["P"] or 0, tot["N"] or 0


def _roc_from(rt: DataFrame, P: int, N: int) -> DataFrame:
    # a class without rows leaves its rate undefined: NULL, not an error
    pts = rt.select("threshold", F.try_divide(F.col("neg_cum"), F.lit(float(N))).alias("fpr"),
                    F.try_divide(F.col("pos_cum"), F.lit(float(P))).alias("tpr"))
    start = rt.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"),
                                            F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def _auc_from(rt: DataFrame, P: int, N: int) -> DataFrame:
    area = F.try_divide(F.col("neg"), F.lit(float(N))) * \
        F.try_divide(2 * F.col("pos_cum") - F.col("pos"), F.lit(2.0 * P))
    return rt.agg(F.sum(area).alias("auc"))


def _precision() -> Column:
    return F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))


def _pr_from(rt: DataFrame, P: int) -> DataFrame:
    pts = rt.select("threshold", _precision().alias("precision"),
                    # no positive rows: recall is 1 at every threshold (scikit-learn's rule)
                    (F.try_divide(F.col("pos_cum"), F.lit(float(P))) if P else F.lit(1.0)).alias("recall"))
    end = rt.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                          F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def _pr_summary_from(rt: DataFrame, P: int) -> DataFrame:
    prec = _precision()
    return rt.agg(((F.sum(prec) + F.lit(1.0)) / (F.count(F.lit(1)) + F.lit(1))).alias("mean_precision"),
                  F.sum(prec * F.try_divide(F.col("pos"), F.lit(float(P)))).alias("average_precision"))


def roc_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, high to low, starting at (+inf, 0, 0)."""
    rt, P, N = _curve_base(df, y, score)
    return _roc_from(rt, P, N)


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Trapezoid area under the ROC curve.

    Each score row adds (neg/N) × (tpr_before + tpr_after)/2; no lag window needed.
    """
    rt, P, N = _curve_base(df, y, score)
    return _auc_from(rt, P, N)


def pr_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, precision, recall) per distinct score plus the end point (null, 1, 0)."""
    rt, P, _ = _curve_base(df, y, score)
    return _pr_from(rt, P)


def pr_summary(df: DataFrame, y: str, score: str) -> DataFrame:
    """``mean_precision`` = plain mean of the curve's precision column (end point
    included) and the usual step-wise ``average_precision``."""
    rt, P, _ = _curve_base(df, y, score)
    return _pr_summary_from(rt, P)


# --------------------------------------------------------------------- regression
def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """MAE, MSE, RMSE, R² in one aggregate; constant truth gives R² 1 (exact) or 0."""
    e = qcol(y).cast("double") - qcol(yhat).cast("double")
    a = df.where(qcol(y).isNotNull() & qcol(yhat).isNotNull()).agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sum(e * e).alias("ss_res"),
        (F.var_pop(qcol(y).cast("double")) * F.count(F.lit(1))).alias("ss_tot"))
    r2 = F.when(F.col("ss_tot") == 0, F.when(F.col("ss_res") == 0, 1.0).otherwise(0.0)) \
        .otherwise(F.lit(1.0) - F.col("ss_res") / F.col("ss_tot"))
    return a.select("mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def residuals(df: DataFrame, y: str, yhat: str, keep: list[str] | None = None) -> DataFrame:
    """Actual, predicted and residual = actual - predicted per row."""
    return df.select(*[qcol(c) for c in (keep or [])], qcol(y).cast("double").alias("actual"),
                     qcol(yhat).cast("double").alias("predicted"),
                     (qcol(y).cast("double") - qcol(yhat).cast("double")).alias("residual"))


def actual_vs_predicted_bounds(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Common min and max of actual and predicted (the diagonal of the scatter)."""
    a, p = qcol(y).cast("double"), qcol(yhat).cast("double")
    return df.agg(F.least(F.min(a), F.min(p)).alias("lo"), F.greatest(F.max(a), F.max(p)).alias("hi"))


# ------------------------------------------------------------------------- losses
def bce_logits_loss(df: DataFrame, z: str, y: str) -> DataFrame:
    """Mean binary cross-entropy on logits."""
    return df.agg(F.avg(bce_with_logits(qcol(z).cast("double"), qcol(y).cast("double"))).alias("loss"))


def cross_entropy_loss(df: DataFrame, logits: str, y: str) -> DataFrame:
    """Mean multiclass cross-entropy on a logit array."""
    return df.agg(F.avg(cross_entropy_logits(qcol(logits), qcol(y))).alias("loss"))


def mse_loss(df: DataFrame, y: str, yhat: str) -> DataFrame:
    e = qcol(y).cast("double") - qcol(yhat).cast("double")
    return df.agg(F.avg(e * e).alias("loss"))


# ------------------------------------------------------------------ entry points
def evaluate_classification(df: DataFrame, y: str, yhat: str, prob: str | None = None,
                            is_binary: bool = False) -> dict[str, DataFrame]:
    """Confusion matrix and report; for binary problems with a score, ROC, AUC, PR curve and
    its precision summaries (``mean_precision`` is the reference's ``avg_precision``)."""
    out = {"confusion_matrix": confusion_matrix(df, y, yhat),
           "classification_report": classification_report(df, y, yhat)}
    if is_binary and prob is not None:
        # one (score -> running counts) table, written once, feeds all four curve tables
        rt, P, N = _curve_base(df, y, prob)
        checkpoint_dir(df.sparkSession)
        rt = rt.checkpoint(eager=True)
        out.update({"roc": _roc_from(rt, P, N), "auc": _auc_from(rt, P, N),
                    "pr_curve": _pr_from(rt, P), "pr_summary": _pr_summary_from(rt, P)})
    return out


def evaluate_regression(df: DataFrame, y: str, yhat: str) -> dict[str, DataFrame]:
    return {"metrics": regression_metrics(df, y, yhat), "residuals": residuals(df, y, yhat),
            "bounds": actual_vs_predicted_bounds(df, y, yhat)}


def evaluate_model(model, df: DataFrame) -> dict[str, DataFrame]:
    """Score ``df`` with a trained model and evaluate by its problem type."""
    pred = model.transform(df)
    y = "_y_true"
    pred = pred.withColumn(y, qcol(model.target).cast("double" if model.problem == "regression" else "int"))
    if model.problem == "regression":
        return evaluate_regression(pred, y, "prediction")
    pred = pred.withColumn("_y_pred", F.col("prediction").cast("int"))
    return evaluate_classification(pred, y, "_y_pred", "p1" if "p1" in pred.columns else None,
                                   is_binary=model.problem == "binary")
