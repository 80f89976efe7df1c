"""Resampling documents towards a target distribution (operator 13).

1. Every text becomes the array of its features' buckets: runs of 1 to ``ngram`` words, CRC-32 modulo
   ``buckets``.  The arrays are written once, next to a row number.
2. Bucket counts of the documents and of the target texts give each bucket's gain, floor(1000 *
   log-ratio) with one added to every count.  A document's weight is the floored mean of its features'
   gains, read from one array; Gumbel noise from a hash of the doc_id makes the highest scores a
   sample without replacement.
3. Ranks come from parallel sorting by regular sampling: tasks write locally sorted runs; every so many rows of a
   run are a sample; evenly spaced samples split the order into segments; the segments that the draw
   reaches are exchanged, each to a task of its own, and merged there; the counts of the segments before give exact ranks.
   A segment that comes out too large is split by closer samples, so none depends on luck.

Segments hold about ``8 * sqrt(rows)`` rows, so their number and their size both grow slowly.  The driver gets bucket
counts, samples (about 32 a segment) and segment counts.

Nulls, empty texts: no features, weight 0, never drawn unless ``least_words`` is 0.  A null doc_id hashes as an empty one and
ranks after equal scores with an id.  Repeated rows are documents of their own.  Empty tables give no rows; an
empty target leaves gains to the documents alone.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kiln.llm.ngram_join import keyed
from kiln.llm.shared import Scratch, stored
from kiln.llm.terms import term_lists, texts

NGRAM, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
SAMPLES_A_SEGMENT, MOST_TIMES = 32, 4
_CACHE = 1 << 18
_ROW = "row long, key long, doc_id long, n_features long, weight long, score long, eligible boolean"
_NAMES = ["row", "key", "doc_id", "n_features", "weight", "score", "eligible"]


class _Buckets(dict):
    """Bucket of a feature; holds the latest _CACHE features at most."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[feature] = b = crc32(feature) % self.buckets
        return b


def _code(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def feature_buckets(raw: bytes, ngram: int, bucket_of: _Buckets) -> tuple[int, np.ndarray]:
    """(number of words, buckets of all features)."""
    n, out, before = 0, [], []
    for words in term_lists(raw):
        n += len(words)
        out.append(np.fromiter(map(bucket_of.__getitem__, words), np.uint32, len(words)))
        for k in range(2, ngram + 1):
            w = before[max(0, len(before) - k + 1):] + words           # runs that end in this piece
            runs = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)]
            out.append(np.fromiter(map(bucket_of.__getitem__, runs), np.uint32, len(runs)))
        before = (before + words)[-(ngram - 1):] if ngram > 1 else []
    return n, np.concatenate(out) if out else np.empty(0, np.uint32)


def _features(ngram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = _Buckets(buckets)
        for b in batches:
            n, found = [], []
            for raw in texts(b.column("text")):
                words, f = feature_buckets(raw, ngram, bucket_of)
                n.append(words)
                found.append(f.astype(_code(buckets)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("key"), b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()),
                                              pa.array(found, pa.binary())], names=["row", "key", "doc_id", "n_words", "buckets"])
    return run


def _bucket_sums(arrays: DataFrame, buckets: int) -> np.ndarray:
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, _code(buckets)), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in arrays.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t+1)(S+B) / ((s+1)(T+B)))) by bucket."""
    b = len(source)
    s_all, t_all = float(source.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log(((t + 1) * s_all) / ((s + 1) * t_all)))
                     for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gain: np.ndarray, buckets: int, least_words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = [np.frombuffer(x, _code(buckets)) for x in b.column("buckets").to_pylist()]
            n = np.array([len(x) for x in arrays], np.int64)
            weight = np.array([int(gain[x].sum()) // max(1, len(x)) for x in arrays], np.int64)
            draw = np.array([noise(d, seed) for d in b.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("key"), b.column("doc_id"), pa.array(n), pa.array(weight), pa.array(weight + draw),
                                              pa.array(b.column("n_words").to_numpy() >= least_words)], names=_NAMES)
    return run


def order_keys(batch: pa.RecordBatch) -> np.ndarray:
    """Byte strings that sort like (score falling, doc_id rising with nulls last, row)."""
    ids = batch.column("doc_id")
    flip = np.int64(-1 << 63)
    cols = (~batch.column("score").to_numpy() ^ flip, ids.fill_null(0).to_numpy() ^ flip, batch.column("row").to_numpy() ^ flip)
    score, doc, row = (np.ascontiguousarray(c.astype(">i8")).view(np.uint8).reshape(-1, 8) for c in cols)
    none = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)[:, None]
    last = np.ones((batch.num_rows, 1), np.uint8)                       # numpy drops zero bytes at the end
    return np.ascontiguousarray(np.hstack((score, none, doc, row, last))).view("S26").ravel()


def _sampled(stride: int, among: np.ndarray | None, splitters: np.ndarray):
    """Every ``stride``-th row of each run, from a start dealt by its first row; of the segments ``among`` only."""
    def run(batches):
        at = None
        for b in batches:
            if not b.num_rows:
                continue
            k = order_keys(b)
            if among is not None:
                k = k[np.isin(np.searchsorted(splitters, k, "right"), among)]
            if not len(k):
                continue
            if at is None:
                at = crc32(bytes(k[0])) % stride
            yield pa.RecordBatch.from_arrays([pa.array(k[at::stride].tolist(), pa.binary())], names=["key"])
            at = (at - len(k)) % stride
    return run


def _segment_counts(splitters: np.ndarray):
    def run(batches):
        n = np.zeros(len(splitters) + 1, np.int64)
        for b in batches:
            if b.num_rows:
                n += np.bincount(np.searchsorted(splitters, order_keys(b), "right"), minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n[used], pa.int64())], names=["segment", "n"])
    return run


def _placed(splitters: np.ndarray):
    def run(batches):
        for b in batches:
            s = np.searchsorted(splitters, order_keys(b), "right") if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s.astype(np.int32))], names=[*_NAMES, "segment"])
    return run


def _ranked(before: np.ndarray, drawn: int):
    """Rank of each row of merged segments; null beyond the draw."""
    def run(batches):
        segment, at = None, 0
        for b in batches:
            s = b.column("segment").to_numpy()
            rank = np.empty(len(s), np.int64)
            cuts = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)])) if len(s) else np.zeros(1, int)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if s[lo] != segment:
                    segment, at = s[lo], int(before[s[lo]])
                rank[lo:hi] = np.arange(at + 1, at + 1 + hi - lo)
                at += hi - lo
            cols = [b.column(c) for c in _NAMES]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(rank, mask=rank > drawn)], names=[*_NAMES, "rank"])
    return run


def splitters_of(runs: DataFrame, n: int, segment_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(splitters, rows by segment): regular samples of sorted runs, closer ones where a segment is too large."""
    def samples(stride, among, splitters):
        got = runs.mapInArrow(_sampled(stride, among, splitters), "key binary").toPandas()["key"]
        return np.sort(np.array([bytes(x) for x in got], "S26"))

    def counted(splitters):
        out = np.zeros(len(splitters) + 1, np.int64)
        for r in runs.mapInArrow(_segment_counts(splitters), "segment long, n long").groupBy("segment").agg(F.sum("n").alias("n")).collect():
            out[r["segment"]] = r["n"]
        return out

    stride = max(1, segment_rows // SAMPLES_A_SEGMENT)
    none = np.empty(0, "S26")
    every = max(1, segment_rows // stride)
    splitters = samples(stride, None, none)[every - 1::every] if n > segment_rows else none
    rows = counted(splitters)
    while (big := np.flatnonzero(rows > MOST_TIMES * segment_rows)).size:
        stride = max(1, stride // 16)
        more = samples(stride, big, splitters)
        place = np.searchsorted(splitters, more, "right")
        every = max(1, segment_rows // stride)
        pick = np.concatenate([more[place == s][every - 1::every] for s in big])
        splitters = np.unique(np.concatenate((splitters, pick)))
        rows = counted(splitters)
    return splitters, rows


def ranked(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, percent: int = PERCENT,
           least_words: int = LEAST_WORDS, seed: int = SEED, segment_rows: int | None = None) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, key), one row per row of ``docs`` (doc_id, text): ``rank`` for the
    documents drawn towards the texts of ``target``, null for the others; ``key`` hashes (doc_id, text)."""
    own = Scratch()
    numbered = keyed(docs.select("doc_id", "text")).select(F.monotonically_increasing_id().alias("row"), "key", "doc_id", "text")
    form = "row long, key long, doc_id long, n_words long, buckets binary"
    features = own.stored(numbered.mapInArrow(_features(ngram, buckets), form), "features")
    none = F.lit(None).cast("long")
    wanted = target.select(none.alias("row"), none.alias("key"), none.alias("doc_id"), "text").mapInArrow(_features(ngram, buckets), form)
    gain = gains(_bucket_sums(features.select("buckets"), buckets), _bucket_sums(wanted.select("buckets"), buckets))

    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("row")]
    runs = own.stored(features.mapInArrow(_score(gain, buckets, least_words, seed), _ROW)
                      .sortWithinPartitions(F.desc("eligible"), *order), "sorted-runs")
    eligible = runs.where("eligible")
    n = eligible.count()
    drawn = percent * n // 100
    splitters, rows = splitters_of(eligible, n, segment_rows or 8 * math.isqrt(n) + 1)
    ends = np.cumsum(rows)
    last = int(np.searchsorted(ends, drawn)) if drawn else -1           # the segment in which the draw ends
    placed = eligible.mapInArrow(_placed(splitters), _ROW + ", segment int")
    unranked = runs.where("not eligible").unionByName(placed.where(F.col("segment") > last).drop("segment")).withColumn("rank", none)
    out = unranked
    if drawn:
        merged = (placed.where(F.col("segment") <= last).repartitionById(last + 1, F.col("segment"))
                  .sortWithinPartitions("segment", *order))
        out = out.unionByName(merged.mapInArrow(_ranked(ends - rows, drawn), _ROW + ", rank long"))
    out = stored(out.select("doc_id", "n_features", "weight", "score", "rank", "key"), "resampled")
    own.clear()
    return out


def draw_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn towards ``target``; rows of one (doc_id, text) go together."""
    drawn = ranked(docs, target, **options).where("rank is not null").select(F.col("key").alias("_key")).distinct()
    return docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), "text")).join(drawn, "_key", "left_semi").drop("_key")
