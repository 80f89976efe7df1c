"""Ranked lexical search with norm buckets (operator 11).

A document is a vector of integer impacts, one per term of the items searched for; an item is a
vector of integer term weights; the score is their inner product.

1. One pass over whole texts counts the items' terms in each document, and all terms for the length.
2. Impact vectors are ordered by Euclidean length: a vector's bucket is its length on a geometric
   scale, and buckets are searched from long to short in rounds that grow 64-fold.  The k-th best score of the
   rounds before is an item's threshold.
3. In a task the vectors come sorted by length, in blocks.  By Cauchy-Schwarz a block is left out for an item if
   ``|item| * longest`` cannot reach its threshold.  Otherwise the item's heaviest coordinates are
   taken until the rest alone cannot reach it; only vectors with one of those coordinates are looked at, and each
   is bounded by its exact part plus ``|rest of item| * |rest of vector|``.
4. Survivors are scored in 64-bit integers over all coordinates.  A bound that only ties the threshold
   survives, so ties at the last rank are settled by doc_id and nothing is lost.

Items are searched in blocks of about BLOCK_TERMS terms, so what a task holds of them is bounded; each further
block reads the texts once more.

Nulls, empty texts: no terms, never found; an item without terms finds nothing.  Repeated rows: each row of
``docs`` is a document and each row of ``items`` an item.  A null doc_id is found like others, after equal
scores with an id.  Empty tables give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kiln.llm.shared import Scratch, stored
from kiln.llm.terms import ranges, term_lists, texts

BLOCK_TERMS = 1 << 16
BUCKET_RATIO = 1.1
FIRST_ROUND, ROUND_GROWTH = 4096, 64
BLOCK_ROWS, BLOCK_ENTRIES = 4096, 1 << 20
_SLACK = 1 + 1e-9                       # bounds are in floating point, scores are not
_FOUND = "item long, doc_id long, row long, score long"


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [sorted({t for piece in term_lists(raw) for t in piece}) for raw in texts(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("item"), b.column("item_id"), pa.array(found, pa.list_(pa.binary()))],
                                         names=["item", "item_id", "terms"])


def _count(vocabulary: dict[bytes, int]):
    """(row, doc_id, n, terms, tfs): ``terms`` and ``tfs`` are int32 arrays of the vocabulary's terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, terms, tfs = [], [], []
            for raw in texts(b.column("text")):
                n, c = 0, Counter()
                for piece in term_lists(raw):
                    n += len(piece)
                    c.update(map(vocabulary.get, piece))
                c.pop(None, None)
                lengths.append(n)
                terms.append(np.fromiter(c.keys(), "<i4", len(c)).tobytes())
                tfs.append(np.fromiter(c.values(), "<i4", len(c)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id").cast(pa.int64()), pa.array(lengths, pa.int64()),
                 pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["row", "doc_id", "n", "terms", "tfs"])
    return run


def _doc_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            for t in b.column("terms").to_pylist():
                df[np.frombuffer(t, "<i4")] += 1
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(df[used])], names=["term", "df"])
    return run


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _impacts(weights: np.ndarray, n_docs: int, n_terms: int):
    """(row, doc_id, bucket, norm, terms, impacts) of the documents with a coordinate of any weight."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, bucket, norm, terms, impacts = [], [], [], [], []
            for i, (n, t, f) in enumerate(zip(b.column("n").to_pylist(), b.column("terms").to_pylist(), b.column("tfs").to_pylist())):
                t, f = np.frombuffer(t, "<i4"), np.frombuffer(f, "<i4").astype(np.int64)
                m = 100 - 50 + (50 * n * n_docs) // n_terms
                x = (1_000_000_000 * f) // (1000 * f + 20 * m)
                useful = (weights[t] > 0) & (x > 0)
                if not useful.any():
                    continue
                t, x = t[useful], x[useful]
                size = math.sqrt(float((x * x).sum()))
                keep.append(i)
                norm.append(size)
                bucket.append(math.floor(math.log(size) / math.log(BUCKET_RATIO)))
                terms.append(t.tobytes())
                impacts.append(x.astype("<i4").tobytes())
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("row").take(take), b.column("doc_id").take(take), pa.array(bucket, pa.int64()), pa.array(norm, pa.float64()),
                 pa.array(terms, pa.binary()), pa.array(impacts, pa.binary())], names=["row", "doc_id", "bucket", "norm", "terms", "impacts"])
    return run


@dataclass(frozen=True)
class Item:
    """Terms by falling weight; ``rest[j]`` is the length of what follows the first j of them."""

    item: int
    terms: np.ndarray
    weights: np.ndarray
    rest: np.ndarray
    threshold: int


def item_vector(item: int, terms: np.ndarray, weights: np.ndarray, threshold: int) -> Item:
    order = np.argsort(-weights, kind="stable")
    w = weights[order].astype(np.float64)
    rest = np.sqrt(np.concatenate((np.cumsum((w * w)[::-1])[::-1], [0.0])))
    return Item(item, terms[order], weights[order], rest, threshold)


@dataclass
class Block:
    """Impact vectors of about one length: row i has the entries ``ptr[i]:ptr[i+1]``."""

    doc_id: np.ndarray
    no_id: np.ndarray
    row: np.ndarray
    norm: np.ndarray
    ptr: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray

    def __post_init__(self) -> None:
        self.owner = np.repeat(np.arange(len(self.row)), np.diff(self.ptr))
        self.by_term = np.argsort(self.terms, kind="stable")
        self.sorted_terms = self.terms[self.by_term]

    def scores(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores of ``rows`` for the item whose weights ``dense`` holds by term."""
        n = self.ptr[rows + 1] - self.ptr[rows]
        at = ranges(self.ptr[rows], self.ptr[rows + 1])
        return np.add.reduceat(dense[self.terms[at]] * self.impacts[at], np.cumsum(n) - n)

    def survivors(self, item: Item, threshold: int) -> np.ndarray:
        """Rows whose score may reach ``threshold`` (and is above 0)."""
        longest = float(self.norm.max()) * _SLACK
        if item.rest[0] * longest < threshold:
            return np.empty(0, np.int64)
        focus = int(np.argmax(item.rest * longest < max(threshold, 1)))       # rest[-1] = 0 always is
        lo = np.searchsorted(self.sorted_terms, item.terms[:focus], "left")
        hi = np.searchsorted(self.sorted_terms, item.terms[:focus], "right")
        entries = self.by_term[ranges(lo, hi)]
        if not len(entries):
            return np.empty(0, np.int64)
        owner, x = self.owner[entries], self.impacts[entries].astype(np.float64)
        part = np.bincount(owner, np.repeat(item.weights[:focus], hi - lo) * x, len(self.row))
        seen = np.bincount(owner, x * x, len(self.row))
        bound = part + item.rest[focus] * np.sqrt(np.maximum(self.norm * self.norm * _SLACK - seen, 0.0))
        return np.flatnonzero((part > 0) & (bound * _SLACK >= threshold))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    held: list[tuple] = []
    rows = entries = 0

    def block() -> Block:
        ids, no_id, row, norm, terms, impacts = (sum((h[i] for h in held), []) for i in range(6))
        sizes = np.array([len(t) // 4 for t in terms], np.int64)
        return Block(np.array(ids, np.int64), np.array(no_id, bool), np.array(row, np.int64), np.array(norm), np.concatenate(([0], np.cumsum(sizes))),
                     np.frombuffer(b"".join(terms), "<i4"), np.frombuffer(b"".join(impacts), "<i4").astype(np.int64))

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            b = batch.slice(at, 256)
            ids = b.column("doc_id")
            terms = b.column("terms").to_pylist()
            held.append((ids.fill_null(0).to_pylist(), ids.is_null().to_pylist(), b.column("row").to_pylist(), b.column("norm").to_pylist(),
                         terms, b.column("impacts").to_pylist()))
            rows, entries = rows + b.num_rows, entries + sum(map(len, terms)) // 4
            if rows >= BLOCK_ROWS or entries >= BLOCK_ENTRIES:
                yield block()
                held, rows, entries = [], 0, 0
    if held:
        yield block()


def _search(items: list[Item], size: int, k: int):
    """The k best rows of a task for each item, as far as they reach the item's threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {x.item: np.empty((4, 0), np.int64) for x in items}          # score, no id, doc_id, row
        level = {x.item: x.threshold for x in items}
        dense = np.zeros(size, np.int64)
        for block in _blocks(batches):
            for x in items:
                rows = block.survivors(x, level[x.item])
                if not len(rows):
                    continue
                dense[x.terms] = x.weights
                s = block.scores(rows, dense)
                dense[x.terms] = 0
                good = s >= max(1, level[x.item])
                rows = rows[good]
                both = np.concatenate((best[x.item], np.stack((s[good], block.no_id[rows].astype(np.int64), block.doc_id[rows], block.row[rows]))), axis=1)
                if both.shape[1] > k:
                    both = both[:, np.lexsort((both[3], both[2], both[1], -both[0]))[:k]]
                    level[x.item] = max(level[x.item], int(both[0].min()))
                best[x.item] = both
        for item, (score, no_id, doc_id, row) in best.items():
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), item)), pa.array(doc_id, mask=no_id.astype(bool)), pa.array(row), pa.array(score)],
                                                 names=["item", "doc_id", "row", "score"])
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _rounds(per_bucket: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(lowest bucket, highest bucket) of each round, from long vectors to short ones."""
    out, held, size, high = [], 0, FIRST_ROUND, None
    for bucket, n in per_bucket:
        high = bucket if high is None else high
        held += n
        if held >= size:
            out.append((bucket, high))
            held, high, size = 0, None, size * ROUND_GROWTH
    if high is not None:
        out.append((per_bucket[-1][0], high))
    return out


def _search_block(docs: DataFrame, items: list, k: int, own: Scratch) -> DataFrame | None:
    """(item, doc_id, row, score, rank) for one block of items."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in items for t in r["terms"]}))}
    size = len(vocabulary)
    counts = own.stored(docs.mapInArrow(_count(vocabulary), "row long, doc_id long, n long, terms binary, tfs binary"), "term-counts")
    n_docs, n_terms = counts.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not n_docs or not size:
        return None
    df = np.zeros(size, np.int64)
    for r in counts.select("terms").mapInArrow(_doc_counts(size), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    weights = np.array([term_weight(n_docs, int(x)) for x in df], np.int64)
    vectors = own.stored(counts.where("length(terms) > 0").mapInArrow(
        _impacts(weights, n_docs, n_terms), "row long, doc_id long, bucket long, norm double, terms binary, impacts binary"), "impact-vectors")
    per_bucket = [(r["bucket"], r["n"]) for r in vectors.groupBy("bucket").agg(F.count("*").alias("n")).orderBy(F.desc("bucket")).collect()]
    ids = {r["item"]: np.array([vocabulary[bytes(t)] for t in r["terms"]], np.int64) for r in items}
    levels = dict.fromkeys(ids, 0)
    top = None
    for low, high in _rounds(per_bucket):
        vecs = [item_vector(i, t[weights[t] > 0], weights[t[weights[t] > 0]], levels[i]) for i, t in ids.items()]
        part = (vectors.where(F.col("bucket").between(low, high)).repartition("bucket", F.pmod(F.xxhash64("row"), F.lit(1 << 16)))
                .sortWithinPartitions(F.desc("norm")))
        found = part.mapInArrow(_search(vecs, size, k), _FOUND)
        top = own.stored(_best(found if top is None else found.unionByName(top.drop("rank")), k), "best")
        levels |= {r["item"]: r["score"] for r in top.where(F.col("rank") == k).select("item", "score").collect()}
    return top


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of ``docs`` (doc_id, text) for each row of
    ``items`` (item_id, text)."""
    own = Scratch()
    asked = own.stored(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
                       .mapInArrow(_item_terms, f"item long, item_id {items.schema['item_id'].dataType.simpleString()}, terms array<binary>"), "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_terms))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")   # only deals rows out, once written
    found = []
    for i in range(blocks):
        top = _search_block(docs, asked.where((block == i) & (F.size("terms") > 0)).select("item", "terms").collect(), k, own)
        if top is not None:
            found.append(top)
    if not found:
        out = asked.limit(0).select("item_id", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    else:
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        out = every.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    out = stored(out, "ranked")
    own.clear()
    return out
