"""Document fingerprints from closed syncmers (operator 7).

A k-mer of code points is an anchor if its smallest s-mer stands at its first or last place, which
depends on the k-mer alone and not on its neighbours.  A fingerprint holds the anchors of the
smallest hashes with their first positions, as hex: 8 digits of hash and 8 of position each.
Likeness counts the anchors that two fingerprints share in the same order (the longest chain that
rises in both) against all anchors of their joint smallest hashes.

Null and empty texts have an empty fingerprint, like to another empty one (1) and unlike any other
(0).  Texts shorter than a k-mer are one anchor.  Texts pair with the next in doc_id order (null
last, ties by place in the table), after the last with the first; a sole document with itself.
Repeated rows are documents of their own; other columns are ignored.  An empty table gives an empty
result.  ``docs`` must be a stable table (files).
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kiln.llm.words import mix, powers
from kiln.operators.ordered import range_of

K, S, ANCHORS = 12, 5, 64
DOCS_PER_PART, MOST_PARTS = 2000, 4096
_U = np.uint64
_P = powers(0x9E3779B185EBCA87, 64)


def anchors(text: str, k: int = K, s: int = S, most: int = ANCHORS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first position) of the ``most`` closed syncmers of smallest hash, by hash."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    n = len(c)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    c = (c + _U(1)) * _U(0xD6E8FEB86659FD93)
    c ^= c >> _U(31)
    if n < k:
        return np.array([int(mix(np.array([(c * _P[:n]).sum() + _U(n)], _U))[0]) >> 32], np.uint32), np.zeros(1, np.int64)
    small = np.zeros(n - s + 1, _U)
    for j in range(s):
        small += c[j:n - s + 1 + j] * _P[j]
    small = mix(small)
    width, step, low = k - s + 1, 1, small
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[:len(low) - (width - step)], low[width - step:]) if width > step else low
    at = np.flatnonzero((small[:n - k + 1] == low) | (small[k - s:] == low))
    h = np.zeros(len(at), _U)
    for j, shift in enumerate([*range(0, k - s, s), k - s]):
        h += small[at + shift] * _P[j + 1]
    h = (mix(h) >> _U(32)).astype(np.uint32)
    if len(h) > 4 * most:                       # enough distinct ones are nearly always below this bound
        bound = np.partition(h, 4 * most)[4 * most]
        few = h <= bound
        if len(np.unique(h[few])) >= most:
            h, at = h[few], at[few]
    h, first = np.unique(h, return_index=True)
    return h[:most], at[first[:most]].astype(np.int64)


def to_text(a: tuple[np.ndarray, np.ndarray]) -> str:
    both = np.empty((len(a[0]), 2), ">u4")
    both[:, 0], both[:, 1] = a[0], np.minimum(a[1], 0xFFFFFFFF)
    return both.tobytes().hex()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], most: int = ANCHORS) -> float:
    if not len(a[0]) and not len(b[0]):
        return 1.0
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    joint = np.union1d(a[0], b[0])[:most]
    in_joint = both <= joint[-1]
    i, j = i[in_joint], j[in_joint]
    chain: list[int] = []
    for p in b[1][j[np.argsort(a[1][i], kind="stable")]].tolist():
        at = bisect_left(chain, p)
        chain[at:at + 1] = [p]
    return len(chain) / len(joint)


def edited(text: str, follower: str) -> str:
    """The last half of the code points replaced by the first as many of ``follower``."""
    half = len(text) // 2
    return text[:len(text) - half] + follower[:half]


_KIND = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
         "near_edited double, near_next double")


def _rows(batches):
    """Each document against the next of its part, in order; ``guest`` rows only follow."""
    before = None
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")),
                        ("near_edited", pa.float64()), ("near_next", pa.float64())])
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            out = []
            part = batch.slice(at, 500)
            for p, doc, guest, text in zip(*(part.column(c).to_pylist() for c in ("part", "doc_id", "guest", "text"))):
                text = text or ""
                own = anchors(text)
                if before is not None and before[0] == p and not before[2]:
                    _, d, _, t, a = before
                    new = edited(t, text)
                    e = anchors(new)
                    out.append((d, len(t), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), to_text(a), to_text(e),
                                likeness(a, e), likeness(a, own)))
                before = (p, doc, guest, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Texts move once: to one of up to 4096 doc_id ranges, each sorted.  The first document of each
    range is also a guest at the end of the range before it."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    n = rows.count()
    parts = max(1, min(MOST_PARTS, math.ceil(n / DOCS_PER_PART)))
    bounds = []
    if parts > 1:
        marks = [i / parts for i in range(1, parts)]
        bounds = sorted({x for x in rows.agg(F.percentile_approx("doc_id", marks, 20 * parts)).first()[0] or []})
    key = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(range_of(F.col("doc_id"), bounds))
    placed = rows.withColumn("part", key.cast("int"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    firsts = sorted((r["part"], r["f"]["row"]) for r in placed.groupBy("part").agg(F.min(order).alias("f")).collect())
    guests = spark.createDataFrame([(row, firsts[i - 1][0]) for i, (_, row) in enumerate(firsts)], "row long, to int")
    moved = (placed.join(F.broadcast(guests), "row")
             .select(F.col("to").alias("part"), "doc_id", "row", F.lit(True).alias("guest"), "text"))
    every = placed.select("part", "doc_id", "row", F.lit(False).alias("guest"), "text").unionByName(moved)
    return (every.repartition(len(firsts) or 1, "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_last(), "row")
            .mapInArrow(_rows, _KIND))
