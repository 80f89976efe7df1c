"""E13 by round: the scores of a fitted tree ensemble after each of its trees.

Boosting adds a tree a round, a forest a vote.  The ensemble is not fitted again: its prefixes are scored together, in one
pass over the rows, each task returning sums by split and round only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kiln.functions.columns import qcol
from kiln.operators.models import TrainedModel, index_of, label_of, load_part
from kiln.session import drop_scratch, scratch_path

_SUMS = "split string, round int, error double, n long"


@dataclass
class Tree:
    """Nodes in arrays: ``feature`` is -1 in a leaf; ``value`` is a row of class shares or one number."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: float

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at, every = np.zeros(len(x), np.int64), np.arange(len(x))
        while (inner := self.feature[at] >= 0).any():
            goes_left = x[every, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)
        return self.value[at]


def trees_of(spark: SparkSession, model, shares: bool) -> list[Tree]:
    """The trees of a fitted Spark model, in order; its size, which the driver holds already."""
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "treeID" in data.columns:
        data, weights = data.select("treeID", "nodeData.*"), [float(w) for w in model.treeWeights]
    else:
        data, weights = data.withColumn("treeID", F.lit(0)), [1.0]
    nodes: dict[int, list] = {}
    for r in data.orderBy("treeID", "id").collect():
        nodes.setdefault(r["treeID"], []).append(r)
    out = []
    for t, rows in sorted(nodes.items()):
        assert [r["id"] for r in rows] == list(range(len(rows)))
        value = [np.array(r["impurityStats"]) / sum(r["impurityStats"]) if shares else np.array([r["prediction"]]) for r in rows]
        leaf = np.array([r["leftChild"] < 0 for r in rows])
        out.append(Tree(np.where(leaf, -1, [r["split"]["featureIndex"] for r in rows]),
                        np.array([0.0 if r["leftChild"] < 0 else r["split"]["leftCategoriesOrThreshold"][0] for r in rows]),
                        np.array([r["leftChild"] for r in rows]), np.array([r["rightChild"] for r in rows]), np.array(value), weights[t]))
    return out


def _predicted(scores: list[np.ndarray], kind: str, rounds: int) -> np.ndarray:
    """Predictions from the summed trees of each ensemble."""
    if kind == "mean":
        return scores[0][:, 0] / rounds
    if kind == "sum":
        return scores[0][:, 0]
    if kind == "margin":
        return (scores[0][:, 0] > 0).astype(float)
    return np.hstack(scores).argmax(axis=1).astype(float)             # votes of one forest, or a margin a class


def _staged(ensembles: list[list[Tree]], kind: str, before: int = 0):
    """Summed error (squared, or rows of the wrong class) and rows by split and round.

    ``before`` trees have voted already: the rows' ``votes`` hold their sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = max(map(len, ensembles))
        error: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y, split = b.column("y").to_numpy(zero_copy_only=False), np.array(b.column("split").to_pylist(), dtype=object)
            names = sorted(set(split))
            scores: list = [_votes(b)] if before else [0.0] * len(ensembles)
            for r in range(rounds):
                scores = [s + e[r].weight * e[r].leaves(x) if r < len(e) else s for s, e in zip(scores, ensembles)]
                miss = _predicted(scores, kind, before + r + 1) - y
                miss = miss * miss if kind in ("mean", "sum") else (miss != 0).astype(float)
                for s in names:
                    error.setdefault(s, np.zeros(rounds))[r] += miss[split == s].sum()
            for s in names:
                rows[s] = rows.get(s, 0) + int((split == s).sum())
        out = [(s, before + r + 1, float(e), rows[s]) for s, each in error.items() for r, e in enumerate(each)]
        cols = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.float64(), pa.int64()))],
                                         names=["split", "round", "error", "n"])
    return run


def _votes(b: pa.RecordBatch) -> np.ndarray:
    return b.column("votes").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _voted(trees: list[Tree], first: bool):
    """The rows with the votes of ``trees`` added to theirs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            votes = sum((t.weight * t.leaves(x) for t in trees), 0.0 if first else _votes(b))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), b.column("split"), pa.array(list(votes), pa.list_(pa.float64()))],
                                             names=["x", "y", "split", "votes"])
    return run


def _history_of_parts(model: TrainedModel, rows: DataFrame, kind: str) -> DataFrame:
    """Sums by split and round of a forest in parts, one part after the other over written rows."""
    spark, shown, before = rows.sparkSession, [], 0
    paths = [scratch_path(spark, "voted") for _ in range(len(model.parts) + 1)]
    rows.withColumn("votes", F.lit(None).cast("array<double>")).write.parquet(paths[0])
    for k, part in enumerate(model.parts):
        now = spark.read.parquet(paths[k])
        trees = trees_of(spark, load_part(part, model.problem), shares=model.problem != "regression")
        for t in trees:
            t.weight = 1.0
        path = scratch_path(spark, "history")
        now.mapInArrow(_staged([trees], kind, before), _SUMS).write.parquet(path)
        shown.append(path)
        now.mapInArrow(_voted(trees, before == 0), now.schema).write.parquet(paths[k + 1])
        drop_scratch(spark, paths[k])
        before += len(trees)
    drop_scratch(spark, paths[-1])
    return spark.read.parquet(*shown)


def training_history(model: TrainedModel, df: DataFrame, split_col: str = "split") -> DataFrame:
    """(model, split, round, metric, value) after each tree of a fitted forest, boosting or tree; the last round is the model.

    Classifiers have ``accuracy`` and ``loss`` = 1 - accuracy, regressions ``loss`` = MSE, as ``train_val_scores`` has them.
    One-vs-rest boosting takes the same round of every class."""
    if model.model_type not in ("random_forest", "gradient_boosting", "decision_tree"):
        raise ValueError(f"{model.model_type} is not fitted by rounds")
    fitted = model.pipeline.stages[-1]
    boosted, cls = model.model_type == "gradient_boosting", model.problem != "regression"
    whole = [] if model.parts else fitted.models if boosted and model.problem == "multiclass" else [fitted]
    ensembles = [trees_of(df.sparkSession, m, shares=cls and not boosted) for m in whole]
    if boosted:
        kind = "sum" if not cls else "margin" if len(ensembles) == 1 else "classes"
    else:
        kind = "votes" if cls else "mean"
        for t in ensembles[0] if ensembles else []:
            t.weight = 1.0                                # votes and means count every tree alike
    classes = model.params.get("_classes")
    y = label_of(df, model.target, model.problem) if classes is None else index_of(model.target, classes)
    rows = df.select(F.array(*[qcol(c).cast("double") for c in model.features]).alias("x"), y.alias("y"), qcol(split_col).cast("string").alias("split"))
    sums = _history_of_parts(model, rows, kind) if model.parts else rows.mapInArrow(_staged(ensembles, kind), _SUMS)
    loss = sums.groupBy("split", "round").agg((F.sum("error") / F.sum("n")).alias("loss"))
    metrics = [F.struct(F.lit("loss").alias("metric"), F.col("loss").alias("value"))]
    if cls:
        metrics.append(F.struct(F.lit("accuracy").alias("metric"), (1 - F.col("loss")).alias("value")))
    return (loss.select(F.lit(model.model_type).alias("model"), F.col("split").alias(split_col), "round", F.explode(F.array(*metrics)).alias("m"))
            .select("model", split_col, "round", "m.metric", "m.value"))
