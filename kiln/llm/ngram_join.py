"""Exact Jaccard self-join on word n-gram sets by rare-first prefix filtering (operator 6).

Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their distinct n-grams.

1. Every text becomes its n-gram set.  Equal sets are one *class* (its hash is the node of the
   link graph), so copies cost one row however many there are.
2. A count sketch over all documents orders n-grams, rare first.  The order only decides which
   n-grams form prefixes; any order gives the same links.
3. The first ``n - ceil(t*n) + 1`` n-grams of each class are dealt out by n-gram and sorted; the
   n-grams that a second class holds too are kept (one pass over a sorted stream).
4. Links are searched where they can still join two components: each class against the hub
   of its n-grams (their first class; for long sets an eighth of the n-grams), then against the class
   that shares most where an n-gram still lies in several components, then every pair of one n-gram in two components.  Pairs pass the length filter, the positional filter and the suffix filter (an upper
   bound of the overlap from bucketed counts), and each surviving pair is verified once on whole texts.

Nulls, empty texts: no n-grams, no links.  Fewer words than n: the whole sequence is the one n-gram.
Repeated rows: each row gets the component of its own text.  A null doc_id keeps its row; it never
names a component unless the whole component has none.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kiln.llm.shared import Scratch, components, lean, release, renamed, repeated, split_by_ids, stored, text_batches
from kiln.llm.words import blocks, buffers, mix, shingles

SKETCH_BITS = 18
LEAST_BITS, FULL = 4, 15
HUB_SHARE, LONG_SET = 8, 512
_ROWS = "doc_id long, key long, cls long, n long, sig binary, slots binary, counts binary"
_TOKENS = "token long, cls long, meta long"
_HAS_WORD = r"[^\x20\x09-\x0D]"
_U = np.uint64


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    data, off = buffers(batch.column("text"))
    for _, _, words in blocks(data, off):
        yield from shingles(words, k)


def _class_of(s: np.ndarray) -> int:
    """64-bit hash of a sorted set (0 is kept for the empty set)."""
    if not len(s):
        return 0
    x = mix(s ^ _U(0xA24BAED4963EE407))
    h = int(mix(np.array([np.add.reduce(x) + _U(len(s))], _U))[0])
    return int(np.array([h or 1], _U).view(np.int64)[0])


def _signature(s: np.ndarray) -> bytes:
    """Counts of the set's members by bucket, four bits each (15: that or more).  The buckets grow with
    the set, one or two members each on average, so that long sets are told apart as well as short ones."""
    bits = max(LEAST_BITS, (len(s) - 1).bit_length() - 1)
    c = np.minimum(np.bincount((s >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), FULL).astype(np.uint8)
    return (c[0::2] << 4 | c[1::2]).tobytes()


def _bucket_counts(sig: bytes) -> np.ndarray:
    x = np.frombuffer(sig, np.uint8)
    return np.column_stack((x >> 4, x & 15)).ravel()


def _most_shared(x: np.ndarray, y: np.ndarray) -> int | None:
    """The most members that two sets with these bucket counts can share; None if a count is cut."""
    if x.max() == FULL or y.max() == FULL:
        return None
    n = min(len(x), len(y))                  # buckets are leading bits: neighbours add up to wider ones
    return int(np.minimum(*(c.reshape(n, -1).sum(axis=1, dtype=np.int64) for c in (x, y))).sum())


def _slot(s: np.ndarray) -> np.ndarray:
    return (s & _U((1 << SKETCH_BITS) - 1)).astype(np.int64)


def _class_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()),
                            ("sig", pa.binary()), ("slots", pa.binary()), ("counts", pa.binary())])
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            cls, n, sig, slots = [], [], [], [np.empty(0, np.int64)]
            for s in _sets(batch, k):
                cls.append(_class_of(s))
                n.append(len(s))
                sig.append(_signature(s))
                slots.append(_slot(s))
            sketch += np.bincount(np.concatenate(slots), minlength=len(sketch))
            none = pa.nulls(len(cls), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("key"), pa.array(cls, pa.int64()),
                                              pa.array(n, pa.int64()), pa.array(sig, pa.binary()), none, none], schema=schema)
        used = np.flatnonzero(sketch)
        if len(used):
            one = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([one, one, one, one, pa.nulls(1, pa.binary()),
                                              pa.array([used.astype("<i4").tobytes()], pa.binary()),
                                              pa.array([sketch[used].astype("<i8").tobytes()], pa.binary())], schema=schema)
    return run


def _sketch_sums(rows: DataFrame) -> np.ndarray:
    """Counts by slot over all documents: at most 2**18 longs reach the driver."""
    def unpack(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[np.frombuffer(s, "<i4")] += np.frombuffer(c, "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["slot", "count"])

    sums = (rows.where("slots is not null").select("slots", "counts").mapInArrow(unpack, "slot long, count long")
            .groupBy("slot").agg(F.sum("count").alias("count")).toPandas())
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[sums["slot"].to_numpy(np.int64)] = sums["count"].to_numpy(np.int64)
    return out


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def _prefix_rows(k: int, percent: int, sketch: np.ndarray):
    order = np.searchsorted(np.unique(sketch), sketch).astype(_U)     # ranks of the counts, to fit 18 bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()                                        # copies within a task give their rows once
        for batch in batches:
            tokens, owner, meta, held = [], [], [], 0
            for s in _sets(batch, k):
                if not len(s) or (c := _class_of(s)) in seen:
                    continue
                seen.add(c)
                n = len(s)
                m = n - int(_need(np.int64(n), percent)) + 1
                x = (order[_slot(s)] << _U(46)) | (s >> _U(SKETCH_BITS))
                top = np.argsort(x, kind="stable")[:m] if n < 64 else (p := np.argpartition(x, m - 1)[:m])[np.argsort(x[p], kind="stable")]
                tokens.append(s[top])
                owner.append(np.full(m, c, np.int64))
                meta.append((np.int64(n) << np.int64(32)) | np.arange(m))
                held += m
                if held > 1 << 19:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owner)), pa.array(np.concatenate(meta))], names=["token", "cls", "meta"])
                    tokens, owner, meta, held = [], [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owner)), pa.array(np.concatenate(meta))], names=["token", "cls", "meta"])
    return run


def _shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flat(bs):
        for b in bs:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.zeros(b.num_rows, np.int64))], names=["token", "cls", "meta", "sub"])
    last = None
    for rows in repeated(flat(batches), ("token", "sub"), "cls"):
        t, c, m = rows["token"], rows["cls"], rows["meta"]
        new = np.concatenate(([last != (t[0], c[0])], (t[1:] != t[:-1]) | (c[1:] != c[:-1])))   # tasks repeat a class
        last = (t[-1], c[-1])
        if new.any():
            yield pa.RecordBatch.from_arrays([pa.array(t[new]), pa.array(c[new]), pa.array(m[new])], names=["token", "cls", "meta"])


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Length and positional filters on (n, position) of both sides of a shared n-gram.

    A pair that links passes at its first common n-gram, where nothing before is shared."""
    n1, n2 = F.col("n1"), F.col("n2")
    need = F.ceil((n1 + n2) * F.lit(percent) / F.lit(100 + percent))
    rest = F.least(n1 - F.col("p1"), n2 - F.col("p2"))
    return pairs.where((F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (rest >= need))


def _suffix_filter(percent: int):
    def run(batches):
        for b in batches:
            n1, n2 = (b.column(f).to_numpy() for f in ("n1", "n2"))
            keep = np.ones(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("s1").to_pylist(), b.column("s2").to_pylist())):
                most = _most_shared(_bucket_counts(x), _bucket_counts(y))
                keep[i] = most is None or 100 * most >= percent * (n1[i] + n2[i] - most)
            t = pa.RecordBatch.from_arrays([b.column(f) for f in ("a", "b")], names=["a", "b"])
            yield t.filter(pa.array(keep))
    return run


def _verify(k: int, percent: int):
    def run(batches):
        kept_id, kept = None, None
        for b in batches:
            a_id, b_id = b.column("a").to_pylist(), b.column("b").to_pylist()
            members = _sets(b.select(["text"]), k)
            keep = np.zeros(b.num_rows, bool)
            hubs = b.column("hub_text")
            for i, s in enumerate(members):
                if kept_id != b_id[i]:
                    kept = next(_sets(pa.RecordBatch.from_arrays([hubs.slice(i, 1)], names=["text"]), k))
                    kept_id = b_id[i]
                both = len(np.intersect1d(s, kept, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(s) + len(kept) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a_id, pa.int64()), pa.array(b_id, pa.int64())], names=["a", "b"]).filter(pa.array(keep))
    return run


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int, own: Scratch) -> DataFrame:
    """The pairs (a, b) of classes that truly link; each pair is checked once, on whole texts."""
    ends = lambda df: df.select(F.col("a").alias("cls")).unionByName(df.select(F.col("b").alias("cls"))).distinct()
    pairs = own.stored(pairs, "pairs")
    sets, _ = split_by_ids(classes, ends(pairs), "cls")
    sig = sets.select("cls", "n", "sig")
    likely = own.stored(pairs.join(sig.toDF("a", "n1", "s1"), "a").join(sig.toDF("b", "n2", "s2"), "b")
                        .mapInArrow(_suffix_filter(percent), "a long, b long"), "likely-pairs")
    wanted = own.stored(ends(likely).join(sets, "cls").select("cls", F.col("low.key").alias("key")), "wanted")
    maybe, _ = split_by_ids(docs.select("key", "text"), wanted, "key")
    texts = maybe.mapInArrow(lean(_texts_of_class(k)), "cls long, text string")       # read once a side: cheaper than writing all texts
    hubs, _ = split_by_ids(texts, likely.select(F.col("b").alias("cls")), "cls")
    return (likely.join(texts.withColumnRenamed("cls", "a"), "a")
            .join(hubs.select(F.col("cls").alias("b"), F.col("text").alias("hub_text")), "b")
            .mapInArrow(lean(_verify(k, percent)), "a long, b long").distinct())


def _texts_of_class(k: int):
    """(cls, text); copies within a task give theirs once."""
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            cls = [_class_of(s) for s in _sets(b, k)]
            new = [not (c in seen or seen.add(c)) for c in cls]
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), b.column("text")], names=["cls", "text"]).filter(pa.array(new, pa.bool_()))
    return run


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``, the hash of (doc_id, text): it tells apart texts that share a doc_id, and
    names a row by its content, so that it stays the same however the table is read."""
    return docs.withColumn("key", F.xxhash64(F.col("doc_id").cast("long"), "text"))


def _parts(rows: DataFrame, n: str, at: str) -> DataFrame:
    """``meta`` as set size and position."""
    return rows.withColumn(n, F.shiftright("meta", 32)).withColumn(at, F.col("meta").bitwiseAND((1 << 32) - 1)).drop("meta")


def _edges(comp: DataFrame) -> DataFrame:
    return comp.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _against_first(percent: int):
    """(a, b): the rows of one n-gram, which follow each other, each with the n-gram's first row (its
    hub), if both lie in different components and pass the length and positional filters."""
    def run(batches):
        hub = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(f).to_numpy() for f in ("token", "cls", "meta", "root")])
            token = rows[0]
            if hub is None or token[0] != hub[0]:
                hub = rows[:, 0]
            new = np.flatnonzero(token[1:] != token[:-1]) + 1
            hubs = np.repeat(np.column_stack([hub, rows[:, new]]), np.diff(np.concatenate(([0], new, [len(token)]))), axis=1)
            hub = hubs[:, -1]
            n1, n2 = rows[2] >> 32, hubs[2] >> 32
            rest = np.minimum(n1 - (rows[2] & 0xFFFFFFFF), n2 - (hubs[2] & 0xFFFFFFFF))
            keep = ((rows[1] != hubs[1]) & (rows[3] != hubs[3]) & (rest >= -(-(n1 + n2) * percent // (100 + percent)))
                    & (np.minimum(n1, n2) * 100 >= np.maximum(n1, n2) * percent))
            pairs = np.unique(np.stack([rows[1][keep], hubs[1][keep]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])
    return run


def _hub_pairs(rows: DataFrame, percent: int) -> DataFrame:
    return rows.select("token", "cls", "meta", "root").mapInArrow(_against_first(percent), "a long, b long").distinct()


def _placed(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """``shared`` with the component of each class."""
    return (shared.join(comp.withColumnRenamed("node", "cls"), "cls", "left")
            .select("token", "cls", "meta", F.coalesce("root", "cls").alias("root")))


def _several_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of n-grams whose classes lie in several components, from rows sorted by (token, root)."""
    names = ["token", "cls", "meta", "root"]

    def flat(bs):
        for b in bs:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.zeros(b.num_rows, np.int64))], names=[*names, "sub"])
    for rows in repeated(flat(batches), ("token", "sub"), "root"):
        yield pa.RecordBatch.from_arrays([pa.array(rows[f]) for f in names], names=names)


def _open_pairs(rows: DataFrame, percent: int, own: Scratch) -> DataFrame:
    """(a, b): all pairs of one n-gram in different components that pass the length and positional filters.

    Rows with one (n-gram, size, position) are a cell.  The filters read nothing else, so they are put to pairs of
    cells first, and only cells that pass are joined: a line that many short documents share makes few cells."""
    rows = _parts(rows, "n", "p")
    cell = ["token", "n", "p"]
    cells = own.stored(rows.groupBy(*cell).agg(F.min("root").alias("lo"), F.max("root").alias("hi")), "cells")
    x, y = (cells.withColumnsRenamed({"n": f"n{i}", "p": f"p{i}", "lo": f"lo{i}", "hi": f"hi{i}"}) for i in (1, 2))
    fits = _bounded(x.join(y, "token").where("n1 <= n2 and (lo1 <> lo2 or hi1 <> hi2 or lo1 <> hi1)"), percent)
    x = rows.withColumnsRenamed({"cls": "a", "root": "r1", "n": "n1", "p": "p1"})
    y = rows.withColumnsRenamed({"cls": "b", "root": "r2", "n": "n2", "p": "p2"})
    pairs = x.join(fits.select("token", "n1", "p1", "n2", "p2"), ["token", "n1", "p1"]).join(y, ["token", "n2", "p2"])
    return pairs.where("r1 <> r2 and (n1 < n2 or n1 = n2 and a < b)").select("a", "b").distinct()


def ngram_jaccard_links(docs: DataFrame, n: int = 5, percent: int = 75,
                        put: Callable[[DataFrame, str], DataFrame] = stored) -> tuple[DataFrame, DataFrame]:
    """(classes: doc_id, key, cls, n_shingles; roots: cls, root, kept) for ``docs`` (doc_id, text).

    ``cls`` names the document's n-gram set (0: empty); ``root`` is the smallest doc_id that links
    reach from the class, ``kept`` the key of a row that has it.  ``put`` writes the tables that these two
    frames read; all other written tables are gone on return."""
    own = Scratch()
    text_batches(docs.sparkSession)
    docs = keyed(docs.select("doc_id", "text"))
    rows = put(docs.mapInArrow(lean(_class_rows(n)), _ROWS), "classes")
    ids = rows.where("slots is null").select("doc_id", "key", "cls", "n")
    low = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")       # null ids come last
    classes = own.stored(rows.where("slots is null and cls <> 0").groupBy("cls").agg(
        F.min(low).alias("low"), F.max("n").alias("n"), F.first("sig").alias("sig")), "class-sets")
    sketch = _sketch_sums(rows)
    tokens = docs.mapInArrow(lean(_prefix_rows(n, percent, sketch)), _TOKENS)
    tokens = tokens.repartition("token").sortWithinPartitions("token", "cls")
    shared = own.stored(tokens.mapInArrow(_shared_tokens, _TOKENS), "shared-tokens")
    del sketch, tokens                                       # its plan carries the sketch
    release(docs.sparkSession)

    # round 1, on an eighth of the n-grams of long sets: each class with the first class of each of its
    # n-grams.  The files hold an n-gram's rows together; a file read in two splits makes two hubs of one.
    long_set = F.shiftright("meta", 32) >= LONG_SET
    some = shared.where(~long_set | (F.pmod("token", F.lit(HUB_SHARE)) == 0)).withColumn("root", F.col("cls"))
    star = own.stored(_hub_pairs(some, percent), "hub-pairs")
    comp = own.stored(components(_links(docs, classes, star, n, percent, own)), "hub-components")

    release(docs.sparkSession)

    # round 2: where an n-gram still lies in several components, with its class that shares most n-grams
    weight = shared.groupBy("cls").agg(F.count("*").alias("w"))
    ranked = _placed(shared, comp).join(weight, "cls").repartition("token").sortWithinPartitions("token", F.desc("w"), "cls")
    tried = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    again = own.stored(_hub_pairs(ranked, percent).join(tried, ["a", "b"], "left_anti"), "hub-pairs-2")
    if not again.isEmpty():
        comp = own.stored(components(_edges(comp).unionByName(_links(docs, classes, again, n, percent, own))), "hub-components-2")

    release(docs.sparkSession)

    # round 3: pairs of one n-gram that lie in different components and were not tried yet
    placed = _placed(shared, comp).repartition("token").sortWithinPartitions("token", "root")
    open_ = own.stored(placed.mapInArrow(_several_roots, _TOKENS + ", root long"), "open-tokens")
    tried = tried.unionByName(again).unionByName(again.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = own.stored(_open_pairs(open_, percent, own).join(tried, ["a", "b"], "left_anti"), "open-pairs")
    if not more.isEmpty():
        comp = components(_edges(comp).unionByName(_links(docs, classes, more, n, percent, own)))
    lows = classes.select("cls", "low")
    named = comp.join(lows, comp.node == lows.cls)
    least = named.groupBy("root").agg(F.min("low").alias("least")).join(named.select("cls", "root"), "root").select("cls", "least")
    least = lows.join(least, "cls", "left").select("cls", F.coalesce("least", "low").alias("low"))
    roots = put(least.select("cls", F.col("low.doc_id").alias("root"), F.col("low.key").alias("kept")), "roots")
    own.clear()
    return ids.withColumnRenamed("n", "n_shingles"), roots


def near_duplicate_components(docs: DataFrame, n: int = 5, percent: int = 75,
                              put: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row; ``put`` writes the tables it reads."""
    ids, roots = ngram_jaccard_links(docs, n, percent, put)
    return ids.join(roots, "cls", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def keep_one_per_component(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` without the near duplicates: one row of each component stays, a row of its smallest
    doc_id (null ids come last).  Rows without words all stay."""
    docs, own_names = renamed(docs)
    own = Scratch()
    ids, roots = ngram_jaccard_links(docs, n, percent, own.stored)
    ids = ids.where("n_shingles > 0")
    dropped = stored(ids.join(roots, "cls").where("key <> kept").select("key").distinct(), "dropped")
    again = stored(ids.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"), "repeated-rows")
    own.clear()
    names = docs.columns
    docs = keyed(docs)
    has_words = F.coalesce(F.col("text").rlike(_HAS_WORD), F.lit(False))
    wordless, rows = docs.where(~has_words), docs.where(has_words)
    if not again.isEmpty():                                  # rows of one id and text become one before any shuffle of texts
        repeats, rows = split_by_ids(rows, again, "key")
        plain = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
        one = repeats.groupBy("key").agg(F.min_by(F.struct(*names), F.xxhash64(*plain)).alias("row"))
        rows = rows.unionByName(one.select("row.*", "key"))
    maybe, sure = split_by_ids(rows, dropped, "key")
    kept = sure.unionByName(maybe.join(dropped, "key", "left_anti")).unionByName(wordless)
    return kept.select(*names).toDF(*own_names)
