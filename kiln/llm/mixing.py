"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 3).

Sources in code-point order (null last) weigh 5, 2, 1, repeating.  Their targets share the words
of all documents by weight; a target stops at ``most`` times its source, and the excess is shared
again among the others.

A document is cut into blocks of at most ``block_words`` words.  A source gives all its blocks once
for every whole time its target holds it, and from a last, freshly permuted pass the first blocks
until the target's words are reached (to the nearest block).  This fixes its exact quota of blocks.
A binary tree splits all quotas among the output shards: at each node a multivariate
hypergeometric draw decides how many blocks of each source go left.  Every shard so owns
disjoint ranges of each source's permuted blocks, and shuffles them locally.

Permutations are hashes of (seed, pass, doc_id, text, block) and draws are seeded by tree node, so reruns
agree.  Null texts have size 0 and are never taken.  Each repeated row is a document of its own.
Empty tables give empty results.  One row per source, and at most 2**18 tree values, reach the
driver.  Rows are numbered once, as they are written, or by
their place in a Parquet file.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F

from kiln.llm.shared import lean, renamed, stored, text_batches
from kiln.llm.words import blocks, buffers

WEIGHTS = (5, 2, 1)
BLOCK_WORDS, SHARD_BLOCKS = 256, 8192
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: np.ndarray, most: int = 3) -> np.ndarray:
    """Words to take from each source, for sources in order."""
    sizes = np.asarray(sizes, float)
    weight = np.resize(np.array(WEIGHTS, float), len(sizes))
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = sizes.sum()
    while open_.any():
        share = left * weight / weight[open_].sum()
        over = open_ & (share > most * sizes)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = most * sizes[over]
        left -= out[over].sum()
        open_ &= ~over
    return out


def split_counts(rng: np.random.Generator, counts: np.ndarray, left: int) -> np.ndarray:
    """How many of each source's ``counts`` are among ``left`` drawn without replacement."""
    total = int(counts.sum())
    if total < 1_000_000_000:                   # numpy's range
        return rng.multivariate_hypergeometric(counts, left, method="marginals")
    if left <= 1000:
        rest, x = counts.copy(), np.zeros_like(counts)
        for _ in range(left):
            k = int(np.searchsorted(np.cumsum(rest), rng.integers(int(rest.sum())), "right"))
            rest[k] -= 1
            x[k] += 1
        return x
    # Every one chosen by itself makes a random subset of random size; taking out (or adding) as many at random as it
    # is off leaves one of the size wanted.  What it is off by is of the order of the root.
    x = rng.binomial(counts, left / total)
    off = int(x.sum()) - left
    return x - split_counts(rng, x, off) if off > 0 else x + split_counts(rng, counts - x, -off) if off else x


def _capacity(a: int, b: int, shards: int, total: int) -> int:
    """Blocks that shards a..b-1 hold: shards differ by one block at most."""
    return b * total // shards - a * total // shards


def _children(node, shards: int, total: int, seed: int):
    a, b, counts, offsets = node
    mid = (a + b) // 2
    go = split_counts(np.random.default_rng([seed, a, b]), counts, _capacity(a, mid, shards, total))
    return [(a, mid, go, offsets), (mid, b, counts - go, offsets + go)]


def splitting_tree(spark, quotas: np.ndarray, shards: int, seed: int) -> DataFrame:
    """(src, shard, lo, hi): which ranks of each source's blocks each shard owns.

    The top of the tree is drawn here, the subtrees in tasks."""
    total = int(quotas.sum())
    nodes = [(0, shards, quotas.astype(np.int64), np.zeros(len(quotas), np.int64))]
    while len(nodes) * 2 * max(1, len(quotas)) <= 1 << 17 and any(b - a > 64 for a, b, *_ in nodes):
        nodes = [c for n in nodes for c in (_children(n, shards, total, seed) if n[1] - n[0] > 64 else [n])]

    def grow(batches):
        for batch in batches:
            out = []
            for a, b, counts, offsets in zip(*(batch.column(f).to_pylist() for f in ("a", "b", "counts", "offsets"))):
                todo = [(a, b, np.array(counts, np.int64), np.array(offsets, np.int64))]
                while todo:
                    n = todo.pop()
                    if n[1] - n[0] > 1:
                        todo += _children(n, shards, total, seed)
                        continue
                    some = np.flatnonzero(n[2])
                    out.append(np.stack((some, np.full(len(some), n[0]), n[3][some], n[3][some] + n[2][some])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], names=["src", "shard", "lo", "hi"])

    rows = [(a, b, c.tolist(), o.tolist()) for a, b, c, o in nodes]
    top = spark.createDataFrame(rows, "a long, b long, counts array<long>, offsets array<long>")
    return top.repartition(min(len(rows), 64), "a").mapInArrow(grow, "src long, shard long, lo long, hi long")


def mixed_blocks(docs: DataFrame, seed: int = 11, most: int = 3, block_words: int = BLOCK_WORDS,
                 shard_blocks: int = SHARD_BLOCKS, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sizes: row, doc_id, size, source_size, target; blocks: row, pass, whole, block, words, shard,
    place), the second holding every block taken, ``place`` its place in its shard.  ``row`` names a written row number, if
    ``docs`` has one."""
    spark = docs.sparkSession
    number = F.col(row) if row else F.monotonically_increasing_id()
    sizes = stored(docs.select(number.alias("row"), "doc_id", "source", F.xxhash64("text").alias("content"),
                               F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    n_blocks = F.ceil(F.col("size") / block_words).cast("long")
    per_source = (sizes.groupBy("source").agg(F.sum("size").alias("words"), F.sum(n_blocks).alias("blocks"))
                  .orderBy(F.col("source").asc_nulls_last()).collect())
    words = np.array([r["words"] for r in per_source], float)
    count = np.array([r["blocks"] for r in per_source], np.int64)
    target = targets(words, most)
    whole = np.floor(np.divide(target, words, out=np.zeros(len(words)), where=words > 0) + 1e-12).astype(np.int64)
    rest = np.maximum(0.0, target - whole * words)
    table = spark.createDataFrame(
        [(i, r["source"], int(words[i]), float(target[i]), int(whole[i]), float(rest[i])) for i, r in enumerate(per_source)],
        "src long, source string, source_size long, target double, whole long, rest double")
    keyed = sizes.join(F.broadcast(table) if len(per_source) <= 4096 else table, sizes.source.eqNullSafe(table.source)).select(
        "row", "doc_id", "content", "size", "src", "source_size", "target", "whole", "rest")
    keyed = stored(keyed, "mix-documents")

    bits = min(16, max(0, math.ceil(math.log2(max(1, int(count.sum()) / (1 << 11))))))
    cut = (keyed.where("size > 0").select("row", "doc_id", "content", "size", "src", "whole", "rest", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("block"))
           .withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words))
           .withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - F.when(F.col("rest") > 0, 0).otherwise(1))))
           .where(F.col("pass") >= 0)
           .withColumn("h", F.xxhash64(F.lit(seed), "pass", "doc_id", "content", "block"))
           .withColumn("part", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")))
    key = ["src", "pass", "part"]
    parts = cut.groupBy(*key).agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    before = Window.partitionBy("src", "pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    inside = Window.partitionBy(*key).orderBy("h", "doc_id", "content", "block", "row")
    ranked = (cut.withColumn("k", F.row_number().over(inside) - 1)
              .withColumn("cum", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words"))
              .join(parts, key))
    drawn = (ranked.withColumn("rank", F.col("n0") + F.col("k"))
             .where((F.col("pass") < F.col("whole")) | (F.col("w0") + F.col("cum") + F.col("words") / 2 <= F.col("rest")))
             .select("row", "doc_id", "src", "pass", (F.col("pass") < F.col("whole")).alias("whole"), "block", "words", "h", "rank"))
    drawn = stored(drawn, "drawn-blocks")

    quota = np.zeros(len(per_source), np.int64)
    for r in drawn.groupBy("src").agg(F.count("*").alias("n")).collect():
        quota[r["src"]] = r["n"]
    shards = max(1, math.ceil(int(quota.sum()) / shard_blocks))
    width = np.maximum(1, quota // shards)                      # about one shard's range of each source
    info = spark.createDataFrame([(i, int(count[i]), int(width[i])) for i in range(len(quota))], "src long, blocks long, width long")
    info = F.broadcast(info) if len(quota) <= 4096 else info
    ranges = (splitting_tree(spark, quota, shards, seed).join(info.select("src", "width"), "src")
              .withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / F.col("width")), F.floor((F.col("hi") - 1) / F.col("width")))))
              .select("src", "cell", "shard", "lo", "hi"))
    at = (drawn.join(info, "src").withColumn("at", F.col("pass") * F.col("blocks") + F.col("rank"))
          .withColumn("cell", F.floor(F.col("at") / F.col("width"))))
    dealt = at.join(ranges, ["src", "cell"]).where("at >= lo and at < hi")
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "src", "at"), "src", "at")
    taken = dealt.select("row", "pass", "whole", "block", "words", "shard", (F.row_number().over(local) - 1).alias("place"))
    return keyed.select("row", "doc_id", "size", "source_size", "target"), taken


def mix_sources(docs: DataFrame, seed: int = 11) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards), one row per input row."""
    sizes, taken = mixed_blocks(docs, seed)
    sums = taken.groupBy("row").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_set("shard")).alias("shards"))
    return sizes.join(sums, "row", "left").select("doc_id", "size", "source_size", "target",
                                                  F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "shards")


def _cut_blocks(block_words: int):
    """Rows once for each whole pass, then one row of the blocks that the last pass takes."""
    def run(batches):
        for b in batches:
            names = [c for c in b.schema.names if c not in ("_whole", "_blocks")]
            whole, part = b.column("_whole").to_numpy(), b.column("_blocks").to_pylist()
            data, off = buffers(b.column("text"))
            pick, cut = [], []
            for i, j, w in blocks(data, off):
                for k in range(i, j):
                    pick += [k] * int(whole[k])
                    cut += [None] * int(whole[k])
                    if part[k]:
                        a, n, raw = w.ptr[k - i], w.ptr[k - i + 1], data[off[k]:off[k + 1]].tobytes()
                        texts = []
                        for x in sorted(part[k]):
                            lo = a + x * block_words
                            hi = min(lo + block_words, n)
                            if lo < hi:
                                texts.append(raw[w.start[lo]:w.end[hi - 1]])
                        pick.append(k)
                        cut.append(raw if len(part[k]) * block_words >= n - a else b"\n".join(texts))
            if not pick:
                continue
            rows = b.select(names).take(pa.array(pick))
            new = pa.array([t if c is None else c.decode() for t, c in zip(rows.column("text").to_pylist(), cut)], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == "text" else rows.column(c) for c in names], names=names)
    return run


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(``docs`` with plain names and ``row``, its own names).  A row of a Parquet file is named by its place in the file,
    however that is split; other tables are written with numbers first."""
    plain, own_names = renamed(docs)
    try:
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        return docs.select("*", place.alias("row")).toDF(*plain.columns, "row"), own_names
    except AnalysisException:                     # not read from files that number their rows
        return stored(plain.withColumn("row", F.monotonically_increasing_id()), "numbered-documents"), own_names


def mix_documents(docs: DataFrame, seed: int = 11, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as rows of ``docs``: a row for each whole time a document is taken, and one with the
    blocks of it that the last pass takes (``n_chars``, where present, is counted anew)."""
    docs, own_names = _numbered(docs)
    names = [c for c in docs.columns if c != "row"]
    _, taken = mixed_blocks(docs, seed, block_words=block_words, row="row")
    plan = taken.groupBy("row").agg(F.max(F.when(F.col("whole"), F.col("pass") + 1).otherwise(0)).alias("_whole"),
                                    F.collect_list(F.when(~F.col("whole"), F.col("block"))).alias("_blocks"))
    rows = docs.join(plan, "row").select(*names, "_whole", "_blocks")
    text_batches(docs.sparkSession)
    out = rows.mapInArrow(lean(_cut_blocks(block_words)), docs.select(*names).schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.toDF(*own_names)
