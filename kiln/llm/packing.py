"""Best-fit packing of token sequences by a grouping genetic algorithm (operator 8).

Documents become token ids plus an end id; only those longer than a sequence are cut, from the
end, so that the first piece is the short one.  Full pieces are a sequence each.  The other
pieces are dealt out at random to shards of about ``shard_pieces``; a shard is packed by several
islands, each a task of its own:

* a chromosome is a list of bins; first ones come from best fit over noisy decreasing sizes;
* crossover injects the well-filled bins of one parent whole, then those of the other that repeat no
  document, and best-fits the displaced documents, largest first;
* after each epoch the best chromosome of every island migrates to the next island of its shard.

Every island goes through its whole population and all its generations.  The best island wins.

Null and empty texts are the end id alone.  Repeated rows are packed each.  Text that spells a special
token is encoded as the tokenizer does.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kiln.llm.shared import lean, stored, text_batches

ROOM, END_ID = 1024, 2
SHARD_PIECES, ISLANDS, EPOCHS = 8192, 2, 2
POPULATION, GENERATIONS = 4, 4
FULL_ENOUGH = 0.99
_PIECES = "doc_id long, piece long, start long, length long, ids_crc32 long, ids array<long>"


class _Encoder:
    """Ids (little-endian uint32 bytes) of whole texts, by byte-level BPE.

    No words are remembered: a corpus has so many rare ones that looking each up and encoding it on its own costs
    twice the time of the text as a whole."""

    loaded: dict[str, "_Encoder"] = {}

    def __init__(self, path: str):
        import tiktoken
        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]     # fixed: bytes shown as themselves
        shown = dict(zip(map(chr, printable), printable))
        shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(shown[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"   # fixed: byte-level BPE
        self.fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, sorted(special)))) if special else None

    @cached_property
    def whole(self):
        """The tokenizer itself, loaded for the first text that spells a special token."""
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    @classmethod
    def of(cls, path: str) -> "_Encoder":
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def encode(self, text: str) -> bytes:
        if self.special is not None and self.special.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, room: int = ROOM, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of every document; ids only if asked for."""
    path = tokenizer or default_tokenizer()
    end = array("I", [END_ID]).tobytes()

    def run(batches):
        enc = _Encoder.of(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = enc.encode(text or "") + end
                    n = len(ids) // 4
                    starts = [0, *range(n % room or room, n, room)]
                    for k, (lo, hi) in enumerate(zip(starts, [*starts[1:], n])):
                        raw = ids[4 * lo:4 * hi]
                        rows.append((doc, k, lo, hi - lo, zlib.crc32(raw), np.frombuffer(raw, "<u4").astype(np.int64) if with_ids else None))
                cols = list(zip(*rows))
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), _PIECES)


class _Bins:
    """Open bins by free room; the tightest that fits is the lowest set bit above the size."""

    def __init__(self, room: int):
        self.room, self.bins, self.free, self.by_free, self.mask = room, [], [], [[] for _ in range(room + 1)], 0

    def add(self, items: list[int], used: int) -> None:
        self.bins.append(items)
        left = self.room - used
        self.free.append(left)
        if left:
            self.by_free[left].append(len(self.bins) - 1)
            self.mask |= 1 << left

    def put(self, item: int, size: int) -> None:
        fits = self.mask >> size
        if not fits:
            self.add([item], size)
            return
        left = size + (fits & -fits).bit_length() - 1
        k = self.by_free[left].pop()
        if not self.by_free[left]:
            self.mask &= ~(1 << left)
        self.bins[k].append(item)
        self.free[k] = left = left - size
        if left:
            self.by_free[left].append(k)
            self.mask |= 1 << left


def _best_fit(order, sizes: list[int], room: int) -> _Bins:
    out = _Bins(room)
    for i in order:
        out.put(i, sizes[i])
    return out


def _crossover(a: _Bins, b: _Bins, sizes: list[int], room: int, rng: np.random.Generator) -> _Bins:
    out, used = _Bins(room), np.zeros(len(sizes), bool)
    limit = room * (1 - FULL_ENOUGH)
    for parent, share in ((a, 0.7), (b, 1.0)):
        order = np.argsort(np.array(parent.free) + rng.random(len(parent.free)), kind="stable")
        for k in order[:max(1, int(share * len(order)))].tolist():
            if parent.free[k] > limit:
                break
            if not any(used[i] for i in parent.bins[k]):
                used[parent.bins[k]] = True
                out.add(list(parent.bins[k]), room - parent.free[k])
    rest = np.flatnonzero(~used)
    for i in rest[np.argsort(-np.array(sizes)[rest] + 8 * rng.random(len(rest)), kind="stable")].tolist():
        out.put(i, sizes[i])
    return out


def _fitness(x: _Bins) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (sum of squared fill)."""
    return len(x.bins), -float(((x.room - np.array(x.free, float)) ** 2).sum())


def _from_groups(groups, sizes: list[int], room: int) -> _Bins:
    out, bins = _Bins(room), {}
    for i, g in enumerate(groups):
        bins.setdefault(int(g), []).append(i)
    for items in bins.values():
        out.add(items, sum(sizes[i] for i in items))
    return out


def evolve(sizes, elites: list, room: int, seed: list[int], population: int = POPULATION, generations: int = GENERATIONS) -> np.ndarray:
    """One epoch of one island: the bin of each piece in its best chromosome."""
    rng = np.random.default_rng(seed)
    s = np.asarray(sizes, np.int64)
    sizes = s.tolist()
    pool = [_from_groups(e, sizes, room) for e in elites]
    while len(pool) < population:
        noise = 0 if not pool else 16 * len(pool)
        pool.append(_best_fit(np.argsort(-s + noise * rng.random(len(s)), kind="stable").tolist(), sizes, room))
    for _ in range(generations):
        pool.sort(key=_fitness)
        if len(pool) < 2:                                   # one parent alone has no partner
            break
        i, j = rng.choice(min(len(pool), population), 2, replace=False)
        pool = pool[:population - 1] + [_crossover(pool[min(i, j)], pool[max(i, j)], sizes, room, rng)]
    best = min(pool, key=_fitness)
    out = np.empty(len(sizes), np.int32)
    for k, items in enumerate(best.bins):
        out[items] = k
    return out


def pack(items: DataFrame, room: int = ROOM, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 5) -> DataFrame:
    """``items`` (``item``, a number written with the row, ``length`` up to ``room``, ...) with sequence_id and offset."""
    numbered = items
    n = items.where(F.col("length") < room).count()
    shards = max(1, math.ceil(n / shard_pieces))
    small = numbered.where(F.col("length") < room).select("item", "length", F.pmod(F.xxhash64(F.lit(seed), "item"), F.lit(shards)).alias("shard"))
    state = (small.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("item", "length"))).alias("i"))
             .select("shard", F.col("i.item").alias("items"), F.col("i.length").alias("sizes"),
                     F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.array().cast("array<array<int>>").alias("elites")))

    def epoch(number: int):
        def run(batches):
            names = ["shard", "items", "sizes", "island", "elites"]
            for b in batches:
                shard, island, elites = (b.column(f).to_pylist() for f in ("shard", "island", "elites"))
                out = [[evolve(s.values.to_numpy(), el, room, [seed, h, i, number]).tolist()]
                       for s, el, h, i in zip(b.column("sizes"), elites, shard, island)]
                yield pa.RecordBatch.from_arrays([*(b.column(f) for f in names[:4]), pa.array(out, pa.list_(pa.list_(pa.int32())))], names=names)
        return run

    kind = "shard long, items array<long>, sizes array<long>, island int, elites array<array<int>>"
    for e in range(epochs):
        state = state.repartition(min(shards * islands, 4096), "shard", "island").mapInArrow(epoch(e), kind)
        state = stored(state, f"epoch-{e}")
        if e + 1 < epochs:                                  # ring migration: each island also gets its neighbour's elite
            guest = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("elites").alias("guest"))
            state = state.join(guest, ["shard", "island"]).select(
                "shard", "items", "sizes", "island", F.array_distinct(F.concat("elites", "guest")).alias("elites"))
    bins = state.withColumn("bins", F.array_max(F.element_at("elites", 1)))
    best = bins.groupBy("shard").agg(F.min(F.struct("bins", "island")).alias("b")).select("shard", F.col("b.island").alias("island"))
    won = (bins.join(best, ["shard", "island"])
           .select("shard", F.explode(F.arrays_zip("items", F.element_at("elites", 1).alias("bin"))).alias("z"))
           .select("shard", F.col("z.items").alias("item"), F.col("z.bin").alias("bin")))
    dealt = numbered.join(won, "item", "left")
    # ids: shard and bin for packed pieces; negative ones, by piece, for the full pieces
    dealt = dealt.withColumn("sequence_id", F.when(F.col("bin").isNull(), -1 - F.col("item")).otherwise(
        F.shiftleft("shard", 32) + F.col("bin")))
    w = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn("offset", F.sum("length").over(w) - F.col("length")).drop("item", "shard", "bin")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, room: int = ROOM, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), and ``ids`` if asked for."""
    # numbered as they are written: a number taken on each read would change with the cores at hand
    cut = stored(pieces(docs, tokenizer, room, with_ids).withColumn("item", F.monotonically_increasing_id()), "pieces")
    out = pack(cut if with_ids else cut.drop("ids"), room)
    return out.withColumn("piece", F.col("piece").cast("int"))
