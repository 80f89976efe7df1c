"""Fused column statistics: moments, exact quantiles, modes.

Each function touches all requested columns in one scan (partial aggregation before the
shuffle).  Exact quantiles are selected by bracket and count: a few scans of the columns in which every
task only counts its values in the sub-brackets of each wanted rank's bracket, so neither values
nor (value, count) pairs are shuffled, whatever the number of distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from kiln.functions.columns import num, qcol

# Sub-brackets per bracket and pass (a power of two): a pass narrows a bracket at least so many times.
SUB_BRACKET_BITS = 11


def moments(df: DataFrame, columns: list[str], distinct: bool = False) -> dict[str, dict]:
    """count, mean, sample and population std, min, max (and approx distinct) per column."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        x = num(c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"),
                 F.stddev_samp(x).alias(f"s{i}"), F.stddev_pop(x).alias(f"p{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if distinct:
            aggs.append(F.approx_count_distinct(x).alias(f"d{i}"))
    row = df.agg(*aggs).collect()[0]
    out = {}
    for i, c in enumerate(columns):
        out[c] = {"count": row[f"n{i}"], "mean": row[f"m{i}"], "std": row[f"s{i}"],
                  "std_pop": row[f"p{i}"], "min": row[f"lo{i}"], "max": row[f"hi{i}"]}
        if distinct:
            out[c]["approx_distinct"] = row[f"d{i}"]
    return out


def _interpolate(sorted_at, n: int, p: float) -> float:
    pos = p * (n - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    a, b = sorted_at(lo), sorted_at(hi)
    return a + (pos - lo) * (b - a)


_SIGN = np.uint64(1 << 63)


def _order_keys(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles ``x`` (no NaN; -0.0 equals 0.0)."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _value_of(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


@dataclass
class _Bracket:
    """Keys lo..hi of column ``ci`` with ``below`` rows under them, and the ranks to be found there."""

    ci: int
    lo: int
    hi: int
    below: int
    ranks: set[int] = field(default_factory=set)

    @property
    def shift(self) -> int:
        return max(0, (self.hi - self.lo).bit_length() - SUB_BRACKET_BITS)


def _count_in(brackets: list[_Bracket]):
    """Rows, least and greatest key (as signed longs) by bracket and sub-bracket, for the doubles of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = [((b.hi - b.lo) >> b.shift) + 1 for b in brackets]
        rows = [np.zeros(n, np.int64) for n in size]
        low = [np.full(n, np.iinfo(np.uint64).max, np.uint64) for n in size]
        high = [np.zeros(n, np.uint64) for n in size]
        for batch in batches:
            keys: dict[int, np.ndarray] = {}
            for i, b in enumerate(brackets):
                if b.ci not in keys:
                    keys[b.ci] = _order_keys(batch.column(b.ci).drop_null().to_numpy(zero_copy_only=False))
                k = keys[b.ci]
                k = k[(k >= np.uint64(b.lo)) & (k <= np.uint64(b.hi))]
                at = ((k - np.uint64(b.lo)) >> np.uint64(b.shift)).astype(np.int64)
                rows[i] += np.bincount(at, minlength=size[i])
                np.minimum.at(low[i], at, k)
                np.maximum.at(high[i], at, k)
        for i in range(len(brackets)):
            used = np.flatnonzero(rows[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), i)), pa.array(used), pa.array(rows[i][used]),
                 *(pa.array((x[i][used] ^ _SIGN).view(np.int64)) for x in (low, high))], names=["bracket", "sub", "n", "lo", "hi"])
    return run


def select_by_count(df: DataFrame, columns: list[str], probs: list[float]) -> tuple[dict[int, int], dict[tuple[int, int], float]]:
    """(rows by column index, value by (column index, rank)) for the ranks that ``probs`` fall between.

    The first scan takes count, minimum and maximum; each further one counts rows in at most
    2**SUB_BRACKET_BITS sub-brackets of each open bracket, and a sub-bracket is cut to the least and greatest value seen in it.  At
    most 64 / SUB_BRACKET_BITS scans follow, as brackets halve the bits of doubles, not their values; two or three
    usually do.  The driver gets the counts, the tasks' shuffle as well."""
    x = [num(c) for c in columns]
    first = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(x) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    n = {i: first[f"n{i}"] for i in range(len(columns))}
    open_: list[_Bracket] = []
    for i in range(len(columns)):
        if n[i]:
            at = [p * (n[i] - 1) for p in probs]
            lo, hi = (int(_order_keys(np.array([first[f"{k}{i}"]], np.float64))[0]) for k in ("lo", "hi"))
            open_.append(_Bracket(i, lo, hi, 0, {f(r) for r in at for f in (math.floor, math.ceil)}))
    found: dict[tuple[int, int], float] = {}
    while True:
        for b in open_:
            if b.lo == b.hi:
                found |= {(b.ci, r): _value_of(b.lo) for r in b.ranks}
        open_ = [b for b in open_ if b.lo != b.hi]
        if not open_:
            return n, found
        wanted = sorted({b.ci for b in open_})
        place = {ci: k for k, ci in enumerate(wanted)}
        asked = [_Bracket(place[b.ci], b.lo, b.hi, b.below) for b in open_]
        counts = (df.select(*[x[ci].alias(f"c{ci}") for ci in wanted]).mapInArrow(_count_in(asked), "bracket long, sub long, n long, lo long, hi long")
                  .groupBy("bracket", "sub").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())
        subs: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: (r["bracket"], r["sub"])):
            subs.setdefault(r["bracket"], []).append(r)
        narrower: list[_Bracket] = []
        for i, b in enumerate(open_):
            below = b.below
            for r in subs[i]:
                inside = {k for k in b.ranks if below <= k < below + r["n"]}
                if inside:
                    narrower.append(_Bracket(b.ci, r["lo"] + (1 << 63), r["hi"] + (1 << 63), below, inside))
                below += r["n"]
        open_ = narrower


def exact_quantiles_ranged(df: DataFrame, columns: list[str] | str, probs: list[float]
                           ) -> dict[str, list[float | None]] | list[float | None]:
    """Exact linear-interpolated quantiles of several columns (or one), NULL and NaN left out."""
    single = isinstance(columns, str)
    cols = [columns] if single else list(columns)
    n, found = select_by_count(df, cols, probs)
    out = {c: [_interpolate(lambda r, i=i: found[i, r], n[i], p) if n[i] else None for p in probs] for i, c in enumerate(cols)}
    return out[cols[0]] if single else out


def quantiles(df: DataFrame, columns: list[str], probs: list[float], approx: bool = False,
              accuracy: int = 10000) -> dict[str, list[float | None]]:
    """Exact quantiles (pandas/DuckDB ``quantile_cont`` rule) for several columns at once.

    ``approx=True`` takes one ``percentile_approx`` pass instead (rank error <= n/accuracy,
    values are actual data points, no interpolation).
    """
    if not columns:
        return {}
    if approx:
        row = df.agg(*[F.percentile_approx(num(c), list(map(float, probs)), accuracy)
                       .alias(f"q{i}") for i, c in enumerate(columns)]).collect()[0]
        return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
                for i, c in enumerate(columns)}
    return exact_quantiles_ranged(df, list(columns), probs)


def unpivot(df: DataFrame, columns: list[str], cast: str | None = None,
            name_col: str = "column", value_col: str = "value") -> DataFrame:
    """Long form (column name, value) of several columns; a narrow Expand, no shuffle."""
    sel = [(qcol(c).cast(cast) if cast else qcol(c)).alias(c) for c in columns]
    return df.select(*sel).unpivot([], [qcol(c) for c in columns], name_col, value_col)


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent non-null value per column; ties go to the smallest value.

    Counts per (column, value) are a partial-aggregated shuffle, so a value holding a
    third of the rows is just one pre-combined counter; the pick is a fixed-size
    ``min_by`` aggregate.
    """
    out: dict[str, object] = {}
    if not columns:
        return out
    types = {f.name: f.dataType for f in df.schema.fields}
    families = {
        "bigint": [c for c in columns if isinstance(types[c], T.IntegralType)],      # exact beyond 2**53
        "double": [c for c in columns if isinstance(types[c], T.NumericType) and not isinstance(types[c], T.IntegralType)],
        "string": [c for c in columns if not isinstance(types[c], T.NumericType)],
    }
    for cast, cols in families.items():
        if not cols:
            continue
        long = unpivot(df, cols, cast).where(F.col("value").isNotNull())
        if cast == "double":
            long = long.where(~F.isnan("value"))
        counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        picks = counts.groupBy("column").agg(
            F.min_by("value", F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"))).alias("mode"))
        for r in picks.collect():                     # one row per column
            out[r["column"]] = r["mode"]
    return out
