"""Distribution tables: histogram, Gaussian KDE, box statistics, outlier flags."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from kiln.functions.columns import num
from kiln.operators import stats


def _range(df: DataFrame, column: str):
    x = num(column)
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"),
               F.stddev_samp(x).alias("s"), F.stddev_pop(x).alias("p"), F.avg(x).alias("m")).collect()[0]
    return r


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max]; empty bins included; ``density`` = n / (N·width).

    The bin of a value is a projection, counting is a partially aggregated shuffle of at
    most ``bins`` keys; empty bins come from a ``bins``-row range (bounded by the argument).
    """
    spark = df.sparkSession
    r = _range(df, column)
    lo, hi, n = r["lo"], r["hi"], r["n"]
    if n == 0:
        return spark.createDataFrame([], "bin int, lo double, hi double, count bigint, density double")
    if hi == lo:
        bins = 1
    w = (hi - lo) / bins if hi > lo else 1.0
    x = num(column)
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(w)), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = grid.join(F.broadcast(counts), "bin", "left")
    cnt = F.coalesce(F.col("count"), F.lit(0)).cast("long")
    return out.select("bin", (F.lit(lo) + F.col("bin") * F.lit(w)).alias("lo"),
                      (F.lit(lo) + (F.col("bin") + 1) * F.lit(w)).alias("hi"),
                      cnt.alias("count"), (cnt / F.lit(n * w)).alias("density"))


def kde_curve(df: DataFrame, column: str, points: int = 100) -> DataFrame:
    """Gaussian KDE on ``points`` evenly spaced points from min to max.

    Bandwidth is Scott's rule (n^(-1/5) × sample std).  One aggregate holds a kernel sum per grid
    point, so no row is copied and each task shuffles one row of ``points`` sums.
    """
    spark = df.sparkSession
    r = _range(df, column)
    lo, hi, n, s = r["lo"], r["hi"], r["n"], r["s"]
    if n is None or n < 2 or not s:
        return spark.createDataFrame([], "point int, x double, density double")
    h = s * n ** (-1.0 / 5.0)
    step = (hi - lo) / (points - 1)
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    grid = [lo + i * step for i in range(points)]
    aggs = []
    for i, g in enumerate(grid):
        z = (F.lit(g) - F.col("v")) / F.lit(h)
        aggs.append((F.sum(F.exp(F.lit(-0.5) * z * z)) * F.lit(norm)).alias(f"k{i}"))
    sums = df.select(num(column).alias("v")).where("v is not null").agg(*aggs)
    cells = [F.struct(F.lit(i).alias("point"), F.lit(g).alias("x"), F.col(f"k{i}").alias("density")) for i, g in enumerate(grid)]
    return sums.select(F.inline(F.array(*cells)))


def box_stats(df: DataFrame, columns: list[str], k: float = 1.5, approx: bool = False) -> DataFrame:
    """D3: quartiles (exact), whiskers (extreme values inside Q1-k·IQR, Q3+k·IQR), outlier count.

    The quartiles are computed first (they define the fences); the returned plan is one
    aggregate over the table for whiskers and outlier counts, unpivoted per column.
    """
    q = stats.quantiles(df, columns, [0.25, 0.5, 0.75], approx=approx)
    aggs, cells = [], []
    for i, c in enumerate(columns):
        q1, med, q3 = q[c]
        x = num(c)
        if q1 is None:
            aggs += [F.lit(None).cast("double").alias(f"wl{i}"), F.lit(None).cast("double").alias(f"wh{i}"),
                     F.lit(0).cast("long").alias(f"no{i}")]
        else:
            lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
            aggs += [F.min(F.when(x >= F.lit(lo), x)).alias(f"wl{i}"),
                     F.max(F.when(x <= F.lit(hi), x)).alias(f"wh{i}"),
                     F.count(F.when((x < F.lit(lo)) | (x > F.lit(hi)), x)).alias(f"no{i}")]
        cells.append(F.struct(F.lit(c).alias("column"), F.lit(q1).cast("double").alias("q1"),
                              F.lit(med).cast("double").alias("median"), F.lit(q3).cast("double").alias("q3"),
                              F.col(f"wl{i}").alias("whisker_low"), F.col(f"wh{i}").alias("whisker_high"),
                              F.col(f"no{i}").cast("long").alias("n_outliers")))
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("b")).select("b.*")


def violin(df: DataFrame, column: str, points: int = 100) -> tuple[DataFrame, DataFrame]:
    """A violin is the KDE curve plus the box statistics."""
    return kde_curve(df, column, points), box_stats(df, [column])


def violin_table(df: DataFrame, column: str, points: int = 100) -> DataFrame:
    """D4 as one table (part, name, x, density): the curve's points, then the box's positions."""
    curve, box = violin(df, column, points)
    names = ["q1", "median", "q3", "whisker_low", "whisker_high"]
    lines = box.select(F.inline(F.array(*[F.struct(F.lit(s).alias("name"), F.col(s).alias("x")) for s in names])))
    return (curve.select(F.lit("curve").alias("part"), F.col("point").cast("string").alias("name"), "x", "density")
            .unionByName(lines.select(F.lit("box").alias("part"), "name", "x", F.lit(None).cast("double").alias("density"))))


def outlier_flag_zscore(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Rows with a value, their z-score (population std) and ``is_outlier`` = |z| > threshold."""
    r = _range(df, column)
    x = num(column)
    std = r["p"] or 0.0
    z = (x - F.lit(r["m"])) / F.lit(std) if std else F.lit(0.0)
    return df.where(x.isNotNull()).select("*", z.alias("zscore"),
                                          (F.abs(z) > F.lit(threshold)).alias("is_outlier"))


def outlier_flag_iqr(df: DataFrame, column: str, threshold: float = 1.5, approx: bool = False) -> DataFrame:
    """Rows with a value and ``is_outlier`` outside [Q1 - t·IQR, Q3 + t·IQR]."""
    q1, q3 = stats.quantiles(df, [column], [0.25, 0.75], approx=approx)[column]
    x = num(column)
    if q1 is None:
        return df.where(F.lit(False)).select("*", F.lit(False).alias("is_outlier"))
    iqr = q3 - q1
    flag = (x < F.lit(q1 - threshold * iqr)) | (x > F.lit(q3 + threshold * iqr))
    return df.where(x.isNotNull()).select("*", flag.alias("is_outlier"))
