"""Global orderings without a single-partition window.

A window with no ``partitionBy`` moves every row to one task.  Instead we cut the
order key into B value ranges (boundaries from a bounded sample), take running sums
inside each range with a partitioned window, and add per-range offsets computed from
a B-row aggregate.  Equal keys always land in the same range, because the range of a
value is a pure function of the value (also under task retries).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from kiln.functions.columns import qcol
from kiln.session import checkpoint_dir

# One window task sorts at most about this many rows before we split the order into ranges.
ROWS_PER_RANGE = 2_000_000
MAX_RANGES = 8192
# Up to this many boundaries the range is a codegen'd CASE tree; beyond, a binary search.
_CASE_TREE_BOUNDS = 511
# Sampled keys per range (the driver receives at most ~MAX_RANGES * 16 keys).
_SAMPLE_PER_RANGE = 64
_MAX_SAMPLE = 131_072


def ranges_for(n_rows: int) -> int:
    return max(1, min(MAX_RANGES, math.ceil(n_rows / ROWS_PER_RANGE)))


def sample_bounds(df: DataFrame, col: str, n_ranges: int, n_rows: int, seed: int = 17) -> list:
    """``n_ranges - 1`` ascending, distinct boundaries of ``col`` from a bounded sample."""
    if n_ranges <= 1 or n_rows == 0:
        return []
    want = min(n_ranges * _SAMPLE_PER_RANGE, _MAX_SAMPLE)
    frac = min(1.0, want / n_rows)
    # hard cap: an estimate that is far too low cannot flood the driver (a capped sample only
    # makes the ranges less even; results stay exact)
    vals = sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull())
                  .sample(False, frac, seed).limit(4 * want).collect())
    if not vals:
        return []
    bounds = []
    for i in range(1, n_ranges):
        v = vals[min(len(vals) - 1, (i * len(vals)) // n_ranges)]
        if not bounds or v > bounds[-1]:
            bounds.append(v)
    return bounds


def _literal(v) -> Column:
    """Literal for a boundary; a sampled struct key (a Row) becomes a struct with its field names."""
    if isinstance(v, Row):
        return F.struct(*[_literal(x).alias(k) for k, x in v.asDict().items()])
    return F.lit(v)


def range_of(c: Column, bounds: list) -> Column:
    """Number of boundaries strictly below ``c``: a balanced CASE tree, log2(B) deep, or for
    many boundaries a binary search over one literal array (log2(B) steps)."""
    if len(bounds) > _CASE_TREE_BOUNDS:
        arr = F.array(*[_literal(b) for b in bounds])
        steps = max(1, math.ceil(math.log2(len(bounds) + 1)))
        n = F.lit(len(bounds))

        def step(s, _):
            mid = F.floor((s.lo + s.hi) / 2).cast("int")
            above = c > F.element_at(arr, mid + 1)
            return F.when(s.lo >= s.hi, s).otherwise(F.when(
                above, F.struct((mid + 1).alias("lo"), s.hi.alias("hi"))).otherwise(
                F.struct(s.lo.alias("lo"), mid.alias("hi"))))
        out = F.aggregate(F.sequence(F.lit(1), F.lit(steps)),
                          F.struct(F.lit(0).alias("lo"), n.alias("hi")), step)
        return out.getField("lo").cast("int")
    lits = [_literal(b) for b in bounds]

    def rec(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c > lits[mid], rec(mid + 1, hi)).otherwise(rec(lo, mid))
    return rec(0, len(bounds)).cast("int")


def running_totals(df: DataFrame, order_col: str, measures: list[str], *,
                   descending: bool = False, n_rows: int | None = None,
                   suffix: str = "_cum", least_ranges: int = 1) -> DataFrame:
    """Add inclusive running sums ``<m><suffix>`` of ``measures`` in ``order_col`` order.

    ``order_col`` must be unique per row (collapse duplicates first) and non-null.
    ``n_rows`` may be an estimate (e.g. ``approx_count_distinct``): it only sizes the ranges.
    ``least_ranges`` above 1 spreads small inputs over tasks as well.
    """
    n = df.count() if n_rows is None else n_rows
    n_ranges = max(ranges_for(n), least_ranges)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    if n_ranges <= 1:
        # Bounded: at most ROWS_PER_RANGE rows go to the single window task.
        w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(m).over(w).alias(m + suffix) for m in measures])

    # The input is read three times below (sample, range totals, windows); on this path it
    # is large, so write it once to the shared checkpoint folder instead of recomputing it.
    checkpoint_dir(df.sparkSession)
    df = df.checkpoint(eager=True)
    bounds = sample_bounds(df, order_col, n_ranges, n)
    rng = range_of(F.col(order_col), bounds)
    if descending:
        rng = F.lit(len(bounds)) - rng
    dfr = df.withColumn("_rng", rng)
    totals = {r["_rng"]: r for r in dfr.groupBy("_rng").agg(
        *[F.sum(m).alias(m) for m in measures]).collect()}          # <= MAX_RANGES rows
    offsets = {m: {} for m in measures}
    acc = {m: 0 for m in measures}
    for k in sorted(totals):
        for m in measures:
            offsets[m][k] = acc[m]
            acc[m] += totals[k][m] or 0
    w = Window.partitionBy("_rng").orderBy(order).rowsBetween(Window.unboundedPreceding,
                                                               Window.currentRow)
    if len(totals) <= _CASE_TREE_BOUNDS + 1:
        def offset_col(m):
            pairs = []
            for k, v in offsets[m].items():
                pairs += [F.lit(k), F.lit(v)]
            return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("_rng")), F.lit(0))
        out = dfr.select("*", *[(F.sum(m).over(w) + offset_col(m)).alias(m + suffix) for m in measures])
        return out.drop("_rng")
    # many ranges: offsets as a broadcast table (one row per range, bounded by MAX_RANGES)
    spark = df.sparkSession
    off = spark.createDataFrame([(k, *[offsets[m][k] for m in measures]) for k in sorted(totals)],
                                ["_rng", *[f"_off_{m}" for m in measures]])
    out = dfr.join(F.broadcast(off), "_rng", "left").select(
        *[qcol(c) for c in df.columns], *[(F.sum(m).over(w) + F.coalesce(F.col(f"_off_{m}"), F.lit(0))).alias(m + suffix)
                       for m in measures])
    return out


def dense_codes(values: DataFrame, col: str, n_rows: int | None = None) -> DataFrame:
    """0-based dense rank of the distinct values of ``col`` in ascending order.

    ``n_rows`` (an estimate of the distinct count is enough) only sizes the value ranges.
    """
    d = values.select(col).where(F.col(col).isNotNull()).distinct().withColumn("_one", F.lit(1))
    out = running_totals(d, col, ["_one"], n_rows=n_rows)
    return out.select(col, (F.col("_one_cum") - 1).cast("int").alias("code"))


# Selection splits the key into at least this many ranges so that the final window only
# touches the few ranges holding wanted ranks.
_SELECT_ROWS_PER_RANGE = 20_000


def select_ranks(df: DataFrame, key: str, count: str, ranks: list[int], n_keys: int,
                 _depth: int = 0) -> dict[int, object]:
    """Key at each 0-based rank of the multiset ``key`` repeated ``count`` times.

    ``df`` has one row per distinct non-null key.  Range totals come from an aggregate with
    one row per range; only ranges holding a wanted rank are looked at, and a range still
    too large for one window task is refined the same way, so no task sorts more than
    about ROWS_PER_RANGE keys at any table size.
    """
    ranks = sorted(set(ranks))
    if not ranks:
        return {}
    n_ranges = max(1, min(MAX_RANGES, math.ceil(n_keys / _SELECT_ROWS_PER_RANGE)))
    bounds = sample_bounds(df, key, n_ranges, n_keys, seed=17 + _depth) if n_ranges > 1 else []
    dfr = df.withColumn("_rng", range_of(F.col(key), bounds) if bounds else F.lit(0))
    totals = sorted((r["_rng"], r["n"], r["k"]) for r in dfr.groupBy("_rng").agg(
        F.sum(count).alias("n"), F.count(F.lit(1)).alias("k")).collect())
    start, acc = {}, 0
    for rng, n, _ in totals:
        start[rng] = acc
        acc += n
    keys_in = {rng: k for rng, _, k in totals}
    need: dict[int, list[int]] = {}
    for r in ranks:
        for rng, n, _ in totals:
            if start[rng] <= r < start[rng] + n:
                need.setdefault(rng, []).append(r)
                break
    out: dict[int, object] = {}
    window_ranges = {}
    for rng, rs in need.items():
        if keys_in[rng] > ROWS_PER_RANGE and len(bounds) > 0 and _depth < 4:
            sub = dfr.where(F.col("_rng") == rng).drop("_rng")
            local = select_ranks(sub, key, count, [r - start[rng] for r in rs], keys_in[rng], _depth + 1)
            out.update({r: local[r - start[rng]] for r in rs if (r - start[rng]) in local})
        else:
            window_ranges[rng] = start[rng]
    if not window_ranges:
        return out
    pairs = []
    for k, v in window_ranges.items():
        pairs += [F.lit(k), F.lit(v)]
    off = F.try_element_at(F.create_map(*pairs), F.col("_rng"))
    w = Window.partitionBy("_rng").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sub = dfr.where(F.col("_rng").isin(list(window_ranges))).select(
        key, count, (F.sum(count).over(w) + off).alias("_cum"))
    wanted = [r for rng in window_ranges for r in need[rng]]
    cond = None
    for r in wanted:
        t = (F.col("_cum") - F.col(count) <= F.lit(r)) & (F.lit(r) < F.col("_cum"))
        cond = t if cond is None else (cond | t)
    hits = sub.where(cond).select(key, count, "_cum").collect()     # <= len(ranks) rows
    for r in wanted:
        for h in hits:
            if h["_cum"] - h[count] <= r < h["_cum"]:
                out[r] = h[key]
                break
    return out
