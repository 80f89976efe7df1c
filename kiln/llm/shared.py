"""Helpers that several operators share: repeated keys in sorted streams, components, id filters."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kiln.session import checkpoint_dir, drop_scratch, scratch_path

ID_SLOTS = 1 << 20


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: a result that survives lost
    executors and is computed once."""
    return _written(df, scratch_path(df.sparkSession, name))


def release(spark: SparkSession) -> None:
    """Let Spark drop the broadcast tables and shuffle files of finished jobs.

    Its cleaner acts on what the driver's garbage collector has found unreachable; between the stages of
    a long run that may be half an hour, in which both pile up.  The driver's Python gives its free memory back too."""
    spark._jvm.System.gc()
    gc.collect()
    give_back()


BATCH_BYTES = 4 << 20


def text_batches(spark: SparkSession) -> None:
    """Let texts go to Python in Arrow batches of about BATCH_BYTES, unless the session has a bound of its own.

    Spark's own bound is a number of rows, whose texts may be of any length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; at the task's end the reused worker gives its free memory back to the machine."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()
    return task


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # other C libraries than glibc lack it
    if trim is not None:
        trim(0)


class Scratch:
    """Written tables of one operator, deleted together once a later written table holds what is
    needed of them.  After a failure they stay, like all written tables, below ``spark.checkpoint.dir``."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(df.sparkSession, name)
        self.paths.append((df.sparkSession, path))
        return _written(df, path)

    def clear(self) -> None:
        for spark, path in self.paths:
            drop_scratch(spark, path)
        if self.paths:
            release(self.paths[0][0])
        self.paths = []


def frozen(df: DataFrame) -> DataFrame:
    """``checkpoint()`` with the folder taken from the session."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def renamed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(``docs`` with plain names for all columns but those the operators read, its own names), so
    that no further column clashes with an operator's."""
    read = ("doc_id", "text", "source", "n_chars")
    return docs.toDF(*[c if c in read else f"column{i}" for i, c in enumerate(docs.columns)]), docs.columns


def split_by_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among ``ids``, rows whose key surely is not).

    The keys are hashed to at most 2**20 slots, so the broadcast side never exceeds that many
    longs; a caller joins the first part exactly.  It only keeps texts out of a shuffle."""
    slot = F.pmod(F.xxhash64(key), F.lit(ID_SLOTS))
    slots = ids.select(slot.alias("_slot")).distinct()
    with_slot = docs.withColumn("_slot", slot)
    return (with_slot.join(F.broadcast(slots), "_slot", "left_semi").drop("_slot"),
            with_slot.join(F.broadcast(slots), "_slot", "left_anti").drop("_slot"))


_LAST = np.iinfo(np.int64).max


def repeated(batches: Iterator[pa.RecordBatch], levels: tuple[str, str], owner: str, order: str | None = None) -> Iterator[dict]:
    """Rows whose key also occurs with another owner, from rows sorted by (key, sub, owner).

    Yields column arrays plus ``same_sub`` (another owner has the same sub-key as well) and
    ``first`` (the smallest owner of the sub-key).  With ``order``, ``first`` is the smallest order of the sub-key and
    ``first_owner`` the smallest owner that has it.  The stream keeps at most one owner's rows
    between batches, so a key of any size passes in bounded memory."""
    key, sub = levels
    kept: dict[str, np.ndarray] | None = None

    def out(cols: dict, a: int, b: int, both: np.ndarray, multi: np.ndarray, **first: np.ndarray) -> dict:
        take = np.flatnonzero(multi[a:b] & ~cols["_seen"][a:b]) + a
        return {k: v[take] for k, v in cols.items() if k != "_seen"} | {"same_sub": both[take]} | {k: v[take] for k, v in first.items()}

    def settle(cols: dict, final: bool) -> tuple[dict | None, dict | None]:
        n = len(cols[key])
        if not n:
            return None, None
        new_key = np.concatenate(([True], cols[key][1:] != cols[key][:-1]))
        new_sub = new_key | np.concatenate(([True], cols[sub][1:] != cols[sub][:-1]))
        k0, s0 = np.flatnonzero(new_key), np.flatnonzero(new_sub)
        kn, sn = np.diff(np.append(k0, n)), np.diff(np.append(s0, n))
        lo, hi = np.minimum.reduceat(cols[owner], k0), np.maximum.reduceat(cols[owner], k0)
        s_lo, s_hi = np.minimum.reduceat(cols[owner], s0), np.maximum.reduceat(cols[owner], s0)
        multi, both = np.repeat(lo != hi, kn), np.repeat(s_lo != s_hi, sn)
        if order is None:
            least = s_lo
            first = {"first": np.repeat(s_lo, sn)}
        else:
            least = np.minimum.reduceat(cols[order], s0)
            at_least = cols[order] == np.repeat(least, sn)
            who = np.minimum.reduceat(np.where(at_least, cols[owner], _LAST), s0)
            first = {"first": np.repeat(least, sn), "first_owner": np.repeat(who, sn)}
        if final:
            return out(cols, 0, n, both, multi, **first), None
        if lo[-1] == hi[-1]:                     # one owner so far: wait for the next batch
            a = k0[-1]
            return out(cols, 0, a, both, multi, **first), {c: v[a:] for c, v in cols.items()}
        a = n if s_lo[-1] != s_hi[-1] else s0[-1]
        marks = {c: np.repeat(v[-1:], 5) for c, v in cols.items()}      # seen rows that keep the state
        marks["_seen"] = np.ones(5, bool)
        marks[owner] = np.array([lo[-1], hi[-1], s_lo[-1], s_hi[-1], s_lo[-1] if order is None else who[-1]], cols[owner].dtype)
        if order is not None:
            marks[order] = np.array([_LAST] * 4 + [least[-1]], np.int64)
        marks[sub] = marks[sub].copy()
        marks[sub][:2] = ~marks[sub][2]          # another sub-key: only the key is the same
        rest = {c: np.concatenate((marks[c][:5 if a == n else 2], v[a:])) for c, v in cols.items()}
        return out(cols, 0, a, both, multi, **first), rest

    for batch in batches:
        cols = {f: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(batch.schema.names)}
        cols["_seen"] = np.zeros(batch.num_rows, bool)
        if kept is not None:
            cols = {c: np.concatenate((kept[c], cols[c])) for c in cols}
        done, kept = settle(cols, False)
        if done is not None and len(done[key]):
            yield done
    if kept is not None:
        done, _ = settle(kept, True)
        if done is not None and len(done[key]):
            yield done


EDGES_AT_ONCE = 1 << 20


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some edges, but for the roots, with the smallest node that the edges reach from it."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while True:                                              # hook roots to smaller ones, then halve all paths
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars, EDGES_AT_ONCE at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        if sum(len(a) for a, _ in held) >= EDGES_AT_ONCE:
            held = [_contracted(*map(np.concatenate, zip(*held)))]
            if len(held[0][0]) >= EDGES_AT_ONCE // 2:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["a", "b"])
                held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _contracted(*map(np.concatenate, zip(*held)))], names=["a", "b"])


def _are_stars(e: DataFrame) -> bool:
    """Whether every node of the edges (a, b) is either a root or has one, and no root has a root."""
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("root")),
                                      F.struct(F.col("b").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))).alias("s")).select("s.*")
    per = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
    return per.where("leaf > 1 or leaf = 1 and root = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that ``edges`` (a, b) reach from each node in an edge.

    The edges of a task become stars first.  Then alternating large-star and small-star rounds, until only stars are left: each
    hooks neighbours to the smallest one, so the rounds grow with the logarithm of a component's size.  Every
    minimum is partially aggregated before its shuffle; a hub's neighbours meet it again in a join that can split."""
    e = frozen(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
               .mapInArrow(_stars, "a long, b long"))
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = (both.join(low, F.col("a") == F.col("u")).where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .unionByName(low.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = (large.join(low, F.col("a") == F.col("u")).where("b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        e = frozen(small.mapInArrow(_stars, "a long, b long").distinct())
    return (e.withColumnsRenamed({"a": "node", "b": "root"})
            .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
