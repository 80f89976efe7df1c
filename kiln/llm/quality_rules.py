"""Quality classifier as a sparse rule ensemble (operator 10).

Statistics of whole texts (bytes by class, words, repeats) are computed in one pass.  A random
forest of shallow trees on the labelled rows proposes rules: every path from a root is a
conjunction of bounds on statistics.  Logistic regression with a lasso penalty weighs the rules, and
the rules left with a weight become one Spark column expression, so scoring is a projection.

Only statistics of the text enter a score.  Null and empty texts have all statistics 0 and are
scored like any other.  Without labels of both classes the score is their mean (0.5 without any).
Repeated label rows for a document count once, with the lowest label; other columns are kept or
ignored, never read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kiln.llm.shared import lean, release, renamed, split_by_ids, stored, text_batches
from kiln.llm.words import blocks, buffers, prefix_hash, span_hash

STATISTICS = ["n_words", "word_length", "longest_word", "distinct_words", "top_word", "same_as_previous",
              "distinct_trigrams", "upper", "digits", "stops", "symbols", "bars", "doubled_symbols",
              "spaces", "lines", "words_per_line", "beyond_ascii", "words_per_stop"]


def _byte_class(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_UPPER, _DIGIT, _STOP = _byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _byte_class("0123456789"), _byte_class(".,;:?")
_BAR, _LINE, _SPACE = _byte_class("|"), _byte_class("\n"), _byte_class(" \t\n\r\v\f")
_SYMBOL = _byte_class("!\"#$%&'()*+-/<=>@[\\]^_`{|}~")
_HIGH = np.arange(256) >= 192                       # first bytes of characters beyond ASCII
_TAIL = (np.arange(256) >= 128) & ~_HIGH


def _statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per document."""
    out = np.zeros((len(off) - 1, len(STATISTICS)))
    for i, j, w in blocks(data, off):
        lo, hi = off[i], off[j]
        raw, cut = data[lo:hi], off[i:j + 1] - lo

        def per_doc(flags: np.ndarray, at: np.ndarray = cut) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[at])

        chars = np.maximum(1, np.diff(cut) - per_doc(_TAIL[raw]))
        n = np.diff(w.ptr)
        words = np.maximum(n, 1)
        symbol = _SYMBOL[raw]
        doubled = np.zeros(len(raw), bool)
        if len(raw) > 1:
            doubled[1:] = symbol[1:] & (raw[1:] == raw[:-1])
        same = np.zeros(len(w.h), bool)
        same[1:] = w.h[1:] == w.h[:-1]
        same[w.ptr[:-1][n > 0]] = False
        stops, lines = per_doc(_STOP[raw]), per_doc(_LINE[raw]) + 1
        length = w.end - w.start
        block = out[i:j]
        block[:, 0] = np.log1p(n)
        block[:, 1] = per_doc(length, w.ptr) / words
        block[:, 5] = per_doc(same, w.ptr) / words
        block[:, 7:14] = np.stack([per_doc(t[raw]) for t in (_UPPER, _DIGIT, _STOP, _SYMBOL, _BAR)] + [per_doc(doubled), per_doc(_SPACE[raw])], 1) / chars[:, None]
        block[:, 14] = np.log1p(lines - 1)
        block[:, 15] = n / lines
        block[:, 16] = per_doc(_HIGH[raw]) / chars
        block[:, 17] = n / (stops + 1)
        tri = span_hash(prefix_hash(w.h), np.arange(max(0, len(w.h) - 2)), np.arange(3, len(w.h) + 1)) if len(w.h) > 2 else w.h[:0]
        for d, (a, b) in enumerate(zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist())):
            if a == b:
                continue
            x = np.sort(w.h[a:b])
            runs = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))
            block[d, 2] = math.log1p(int(length[a:b].max()))
            block[d, 3], block[d, 4] = (len(runs) - 1) / (b - a), np.diff(runs).max() / (b - a)
            if b - a > 2:
                t = np.sort(tri[a:b - 2])
                block[d, 6] = (1 + np.count_nonzero(t[1:] != t[:-1])) / len(t)
            else:
                block[d, 6] = 1
    return out


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``docs`` and a double column ``stat_<name>`` for each of STATISTICS."""
    sent = keep if "text" in keep else [*keep, "text"]           # whole texts go to Python once
    at = sent.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _statistics(*buffers(b.column(at)))
            cols = [b.column(i) for i in range(len(keep))] + [pa.array(s[:, k]) for k in range(s.shape[1])]
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    text_batches(docs.sparkSession)
    src = docs.select(*[F.col(f"`{c}`") for c in sent])
    kinds = [docs.schema[c].dataType.simpleString() for c in keep] + ["double"] * len(STATISTICS)
    names = [*keep, *(f"stat_{s}" for s in STATISTICS)]
    return src.mapInArrow(lean(run), ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))).toDF(*names)


@dataclass(frozen=True)
class RuleModel:
    """``rules``: ((statistic, above?, bound), ...) with a weight; ``score`` is their logistic sum."""

    rules: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...]
    intercept: float

    def score(self) -> Column:
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def condition(rule: tuple[tuple[str, bool, float], ...]) -> Column:
    c = F.lit(True)
    for name, above, bound in rule:
        c = c & (F.col(f"stat_{name}") > bound if above else F.col(f"stat_{name}") <= bound)
    return c


def tree_rules(text: str) -> list[tuple[tuple[str, bool, float], ...]]:
    """Every path of one tree's printed form, as a conjunction with the tightest bound per side."""
    out, path = [], []
    for line in text.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            path = [p for p in path if p[0] < len(m[1])]
            path.append((len(m[1]), STATISTICS[int(m[2])], m[3] == ">", float(m[4])))
            tight: dict[tuple[str, bool], float] = {}
            for _, name, above, bound in path:
                old = tight.get((name, above), bound)
                tight[name, above] = max(old, bound) if above else min(old, bound)
            out.append(tuple((n, a, b) for (n, a), b in sorted(tight.items())))
    return out


def fit_rules(labelled: DataFrame, trees: int = 12, depth: int = 3, lasso: float = 0.001, seed: int = 7) -> RuleModel:
    """Fit on ``labelled`` (stat_* columns and ``label`` 0/1), all its rows."""
    # imported here, on the driver: Python workers that compute statistics have no use for them
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    mean, n = labelled.agg(F.avg("label"), F.count("*")).first()
    if not n or mean in (0.0, 1.0):
        p = min(max(0.5 if mean is None else mean, 1e-6), 1 - 1e-6)
        return RuleModel((), math.log(p / (1 - p)))
    data = VectorAssembler(inputCols=[f"stat_{s}" for s in STATISTICS], outputCol="features").transform(labelled)
    data = data.withColumn("label", F.col("label").cast("double"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", maxBins=64).fit(data)
    rules = sorted({r for t in forest.trees for r in tree_rules(t.toDebugString)})
    if not rules:
        return RuleModel((), math.log(mean / (1 - mean)))
    names = [f"r{i}" for i in range(len(rules))]
    matrix = labelled.select(F.col("label").cast("double").alias("label"), *[condition(r).cast("double").alias(c) for r, c in zip(rules, names)])
    matrix = stored(VectorAssembler(inputCols=names, outputCol="features").transform(matrix).select("label", "features"), "rules")
    fitted = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=60, standardization=False).fit(matrix)
    weights = fitted.coefficients.toArray()
    release(labelled.sparkSession)                           # every iteration of both fits left a broadcast
    return RuleModel(tuple((r, float(w)) for r, w in zip(rules, weights) if w != 0), float(fitted.intercept))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): the lowest 0/1 label of each document that may be learnt from."""
    return (labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
            .groupBy("doc_id").agg(F.min(column).alias("label")))


def quality_model(stats: DataFrame, labels: DataFrame) -> RuleModel:
    """The model from ``stats`` (doc_id, stat_*) and the rows of ``labels`` that are not held out."""
    return fit_rules(stored(stats.join(labels_of(labels, "quality"), "doc_id"), "labelled"))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    stats = stored(with_statistics(docs, ["doc_id"]), "statistics")
    score = quality_model(stats, labels).score()
    return stats.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; the model learns from ``docs``."""
    docs, own_names = renamed(docs)
    learn = labels_of(labels, "quality")
    maybe, _ = split_by_ids(docs, learn)                     # quality_model joins exactly
    score = quality_model(stored(with_statistics(maybe, ["doc_id"]), "statistics"), labels).score()
    return with_statistics(docs, [*docs.columns]).where(score >= 0.5).select(*docs.columns).toDF(*own_names)
