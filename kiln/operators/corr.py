"""Correlation matrices: Pearson, Spearman (average ranks), Kendall tau-b.

All three use pairwise-complete rows.  Output is long form: (column_a, column_b, corr)
for every ordered pair including the diagonal.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from kiln.functions.columns import num, qcol
from kiln.session import checkpoint_dir, default_parallelism
from kiln.operators.ordered import dense_codes, range_of, ranges_for, running_totals, \
    sample_bounds


def _clean(c):
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def _long_matrix(spark, cols: list[str], pair_vals: dict[tuple[str, str], float | None],
                 diag: dict[str, float | None]) -> DataFrame:
    rows = []
    for a in cols:
        for b in cols:
            if a == b:
                v = diag[a]
            else:
                v = pair_vals.get((a, b), pair_vals.get((b, a)))
            rows.append((a, b, None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v)))
    return spark.createDataFrame(rows, "column_a string, column_b string, corr double")


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every pair in one aggregate (``corr`` skips rows where either value is null),
    unpivoted to the full long matrix; the diagonal is 1, or NULL for a constant column."""
    pairs = list(combinations(columns, 2))
    idx = {p: i for i, p in enumerate(pairs)}
    wide = df.agg(*[F.corr(num(a), num(b)).alias(f"p{i}")
                    for i, (a, b) in enumerate(pairs)],
                  *[F.stddev_pop(num(c)).alias(f"s{i}") for i, c in enumerate(columns)])
    cells = []
    for ia, a in enumerate(columns):
        for b in columns:
            if a == b:
                v = F.when(F.col(f"s{ia}") > 0, F.lit(1.0))
            else:
                v = _clean(F.col(f"p{idx.get((a, b), idx.get((b, a)))}"))
            cells.append(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                                  v.cast("double").alias("corr")))
    return wide.select(F.explode(F.array(*cells)).alias("m")).select("m.column_a", "m.column_b", "m.corr")


def average_ranks(df: DataFrame, column: str, rank_col: str = "rank",
                  n_distinct: int | None = None) -> DataFrame:
    """(value, average rank) for the non-null values of ``column``; ties share the mean rank.

    Collapse to (value, count), running counts by value range, rank = before + (count+1)/2.
    """
    v = df.select(num(column).alias("value")).where(F.col("value").isNotNull())
    vc = v.groupBy("value").agg(F.count(F.lit(1)).alias("c"))
    rt = running_totals(vc, "value", ["c"], n_rows=n_distinct)
    return rt.select("value", (F.col("c_cum") - F.col("c") + (F.col("c") + 1) / 2.0).alias(rank_col),
                     "c")


def _with_ranks(df: DataFrame, cols: list[str], approx: dict[str, int]) -> DataFrame:
    """Add ``_r<i>`` average-rank columns (rows where all ``cols`` are non-null).

    All columns are ranked in one pass: (column, value) counts from one shuffle, running
    counts ordered by ``struct(column, value)`` (value ranges, no single-task window), and
    rank = rows before the value in its column + (count + 1) / 2.  Every column has the same
    number n of complete rows, so the rows before column i are i·n (a scalar subquery).
    Each column then joins its slice of the one rank table, which is written once, back to the rows.
    """
    cur = df.select(*[num(c).alias(f"_v{i}") for i, c in enumerate(cols)])
    for i in range(len(cols)):
        cur = cur.where(F.col(f"_v{i}").isNotNull())
    long = cur.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ci"), F.col(f"_v{i}").alias("v")) for i in range(len(cols))])).alias("s")) \
        .select("s.ci", "s.v")
    vc = long.groupBy("ci", "v").agg(F.count(F.lit(1)).alias("c"))
    est = sum(int(approx[c] * 1.1) + 1 for c in cols)
    rt = running_totals(vc.select(F.struct("ci", "v").alias("k"), "ci", "v", "c"), "k", ["c"],
                        n_rows=est, least_ranges=default_parallelism(df.sparkSession))
    n = cur.select(F.count(F.lit(1))).scalar()
    ranks = rt.select("ci", "v", (F.col("c_cum") - F.col("c") - F.col("ci") * n
                                  + (F.col("c") + 1) / 2.0).alias("rank"))
    checkpoint_dir(df.sparkSession)
    ranks = ranks.checkpoint()                    # read by every column below
    for i in range(len(cols)):
        r = ranks.where(F.col("ci") == i).select(F.col("v").alias(f"_k{i}"), F.col("rank").alias(f"_r{i}"))
        cur = cur.join(r, F.col(f"_v{i}") == F.col(f"_k{i}"), "inner").drop(f"_k{i}")
    return cur


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson of average ranks, ranks retaken per pair on its complete rows.

    Null-free columns are ranked once and share one aggregate; every pair involving a
    column with nulls is ranked on its own complete rows.  The result is one union of those
    aggregates, so Spark schedules all pairs within a single job.
    """
    spark = df.sparkSession
    pre = df.agg(*[F.max(num(c).isNull().cast("int")).alias(f"n{i}") for i, c in enumerate(columns)],
                 *[F.approx_count_distinct(qcol(c)).alias(f"d{i}") for i, c in enumerate(columns)],
                 *[F.stddev_pop(num(c)).alias(f"s{i}") for i, c in enumerate(columns)]
                 ).collect()[0]
    has_null = {c: bool(pre[f"n{i}"]) for i, c in enumerate(columns)}
    approx = {c: int(pre[f"d{i}"]) for i, c in enumerate(columns)}
    clean = [c for c in columns if not has_null[c]]

    def both_ways(a, b, v):
        return [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), _clean(v).alias("corr")),
                F.struct(F.lit(b).alias("column_a"), F.lit(a).alias("column_b"), _clean(v).alias("corr"))]

    parts = []
    diag = [(c, 1.0 if pre[f"s{i}"] else None) for i, c in enumerate(columns)]
    parts.append(spark.createDataFrame(diag, "column_a string, corr double")
                 .select("column_a", F.col("column_a").alias("column_b"), "corr"))
    done = set()
    if len(clean) >= 2:
        ranked = _with_ranks(df, clean, approx)
        pairs = list(combinations(range(len(clean)), 2))
        wide = ranked.agg(*[F.corr(f"_r{a}", f"_r{b}").alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
        cells = []
        for k, (a, b) in enumerate(pairs):
            cells += both_ways(clean[a], clean[b], F.col(f"p{k}"))
            done.add((clean[a], clean[b]))
        parts.append(wide.select(F.explode(F.array(*cells)).alias("m")).select("m.*"))
    for a, b in combinations(columns, 2):
        if (a, b) in done:
            continue
        one = _with_ranks(df, [a, b], approx).agg(F.corr("_r0", "_r1").alias("p"))
        parts.append(one.select(F.explode(F.array(*both_ways(a, b, F.col("p")))).alias("m")).select("m.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _concordance(ranked: DataFrame, levels: int, bounds: list) -> DataFrame:
    """Concordant (C) and discordant (D) counts by pair ``p``, from (p, x, y-rank, count) rows."""
    ex = ranked.select("p", "x", "c", "ry", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("b"))
    ex = ex.select("p", "b", F.expr("shiftright(ry, b + 1)").alias("pre"),
                   F.expr("shiftright(ry, b) & 1").alias("bit"), "x", "c")
    g = ex.groupBy("p", "b", "pre", "x").agg(
        F.sum(F.col("c") * (1 - F.col("bit"))).alias("n0"),
        F.sum(F.col("c") * F.col("bit")).alias("n1"))
    group = ["p", "b", "pre"]
    if not bounds:
        # one x range: the group total is a window sum over the same partitioning, so no
        # per-range offset table and no join are needed
        part = Window.partitionBy(*group)
        w = part.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
        j = g.select("p", "n0", "n1", F.coalesce(F.sum("n0").over(w), F.lit(0)).alias("below"), F.sum("n0").over(part).alias("total"))
    else:
        g = g.withColumn("xr", range_of(F.struct("p", "x"), bounds))
        # per (group, x-range) totals -> offsets of earlier ranges and group totals
        wg = Window.partitionBy(*group).orderBy("xr")
        t = g.groupBy(*group, "xr").agg(F.sum("n0").alias("s0")).select(
            *group, "xr", F.coalesce(F.sum("s0").over(wg.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
            F.sum("s0").over(Window.partitionBy(*group)).alias("total"))
        w = Window.partitionBy(*group, "xr").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
        g = g.select(*group, "xr", "n0", "n1", F.coalesce(F.sum("n0").over(w), F.lit(0)).alias("inside"))
        j = g.join(t, [*group, "xr"]).withColumn("below", F.col("inside") + F.col("before"))
    return j.groupBy("p").agg(F.sum(F.col("n1") * F.col("below")).alias("C"),
                              F.sum(F.col("n1") * (F.col("total") - F.col("below") - F.col("n0"))).alias("D"))


def kendall_taus(df: DataFrame, pairs: list[tuple[str, str]], approx: dict[str, int] | None = None) -> list[float | None]:
    """Kendall tau-b with ties of every pair of columns, all pairs in the same few jobs.

    Work is O(n log n) rows a pair, with no row pair ever formed.  Distinct (pair, x, y, count) rows get the dense rank of y
    within their pair.  Two rows with different y are
    compared once, at the highest bit where their y-ranks differ: inside a group sharing
    pair and higher bits, rows with bit 0 have the smaller y.  Concordant pairs are then
    ``n1(x) × (# bit-0 rows with smaller x)`` summed over the group, found with running
    sums ordered by x.  A group larger than one task's share is split by x range, with
    per-range offsets from a small aggregate.  Distinct-count estimates only size the ranges.
    """
    if not pairs:
        return []
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("p"), num(x).alias("x"), num(y).alias("y")) for i, (x, y) in enumerate(pairs)])).alias("s")) \
        .select("s.*").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    if approx is None:
        names = sorted({c for p in pairs for c in p})
        row = df.agg(*[F.approx_count_distinct(num(c)).alias(f"d{i}") for i, c in enumerate(names)]).first()
        approx = {c: int(row[f"d{i}"]) for i, c in enumerate(names)}
    n_x, n_y = (sum(int(approx[p[k]] * 1.1) + 2 for p in pairs) for k in (0, 1))
    xy = long.groupBy("p", "x", "y").agg(F.count(F.lit(1)).alias("c")).persist()
    try:
        codes = dense_codes(xy.select(F.struct("p", "y").alias("k")), "k", n_rows=n_y).select("k.p", "k.y", "code").persist()
        try:
            spans = {r["p"]: (r["lo"], r["hi"]) for r in codes.groupBy("p").agg(F.min("code").alias("lo"), F.max("code").alias("hi")).collect()}
            if not spans:
                return [None] * len(pairs)
            first = F.create_map(*[F.lit(v) for p, (lo, _) in spans.items() for v in (p, lo)])
            ranked = xy.join(codes, ["p", "y"]).select("p", "x", "c", (F.col("code") - F.element_at(first, F.col("p"))).alias("ry"))
            levels = max(1, max((hi - lo).bit_length() for lo, hi in spans.values()))
            n_ranges = ranges_for(n_x)
            keys = xy.select(F.struct("p", "x").alias("k")).distinct()
            bounds = sample_bounds(keys, "k", n_ranges, n_x) if n_ranges > 1 else []
            counts = {r["p"]: r for r in _concordance(ranked, levels, bounds).collect()}          # one row a pair
        finally:
            codes.unpersist()
        both = xy.select("p", F.explode(F.array(
            F.struct(F.lit("x").alias("a"), F.col("x").alias("v"), F.col("c").alias("c")),
            F.struct(F.lit("y").alias("a"), F.col("y").alias("v"), F.col("c").alias("c")))).alias("s"))
        ties = {(r["p"], r["a"]): r for r in both.groupBy("p", "s.a", "s.v").agg(F.sum("s.c").alias("t")).groupBy("p", "a").agg(
            F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("ties"), F.sum("t").alias("n")).collect()}
    finally:
        xy.unpersist()
    out: list[float | None] = []
    for p in range(len(pairs)):
        if p not in counts:
            out.append(None)
            continue
        n = ties[p, "x"]["n"]
        n0 = n * (n - 1) / 2
        den = (n0 - ties[p, "x"]["ties"]) * (n0 - ties[p, "y"]["ties"])
        out.append(float((counts[p]["C"] or 0) - (counts[p]["D"] or 0)) / math.sqrt(den) if den > 0 else None)
    return out


def kendall_tau_b(df: DataFrame, x: str, y: str, approx: dict[str, int] | None = None) -> float | None:
    """``kendall_taus`` of one pair."""
    return kendall_taus(df, [(x, y)], approx)[0]


def kendall_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    r = df.agg(*[F.stddev_pop(num(c)).alias(f"s{i}") for i, c in enumerate(columns)],
               *[F.approx_count_distinct(qcol(c)).alias(f"d{i}") for i, c in enumerate(columns)]).collect()[0]
    approx = {c: int(r[f"d{i}"]) for i, c in enumerate(columns)}
    pairs = list(combinations(columns, 2))
    vals = dict(zip(pairs, kendall_taus(df, pairs, approx)))
    diag = {c: (1.0 if r[f"s{i}"] else None) for i, c in enumerate(columns)}
    return _long_matrix(df.sparkSession, columns, vals, diag)


def correlation_matrix(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    if method == "pearson":
        return pearson_matrix(df, columns)
    if method == "spearman":
        return spearman_matrix(df, columns)
    if method == "kendall":
        return kendall_matrix(df, columns)
    raise ValueError(f"unknown correlation method: {method}")


__all__ = ["pearson_matrix", "spearman_matrix", "kendall_matrix", "kendall_taus", "kendall_tau_b",
           "average_ranks", "correlation_matrix"]
