"""Toxicity by a convolutional text classifier in numpy (operator 2).

A word's embedding is the sum of hashed embeddings of the word and of its first 4 to 7 bytes, so
that inflected forms share what they learn.  Filters over 1, 2 and 3 neighbouring words pass a
ReLU and a maximum over the whole text; a logistic layer gives the logit.  Embeddings start from
shrunken class log-odds and are trained with the rest by stochastic gradient descent.

Thresholds are calibrated by language on labelled rows that training leaves out.  The language is
read from the text (its function words), and each language's scores are moved so that its best
threshold becomes 0.7.  Labels, lang, source and doc_id never enter a score.

Learning takes every labelled document that is not held out, whole.  A quarter of them, by hash, calibrates; the others
are dealt by hash of their doc_id to shards of about ``SHARD_BYTES`` of text.  In each epoch every shard trains the net on its own documents, a task
a shard, and the nets are averaged: an embedding over the shards that moved it, the rest over all.  Log-odds, thresholds and
slope are counted over all rows by Spark; only the net (2 MB) comes to the driver.

Every text is scored whole.  Null and empty texts have no words and
get the score of empty maxima.  Without labels of both classes the score is the share of label 1.
Repeated label rows count once, the highest label wins; repeated documents are scored each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kiln.llm.quality_rules import held_out
from kiln.llm.shared import lean, release, split_by_ids, stored, text_batches
from kiln.llm.words import _BASE, _BYTE, Words, blocks, buffers, mix, powers
from kiln.operators.ordered import running_totals

BITS, DIM, WIDTHS, FILTERS = 16, 8, (1, 2, 3), 8
PREFIXES = (4, 5, 6, 7)
EPOCHS, BATCH, RATE = 6, 64, 0.05
SHARD_BYTES, WORDS_AT_ONCE, CHUNK = 12 << 20, 1 << 17, 1024
BAR = 0.7
_U = np.uint64
#: Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and is to that it was for with as on are by this be from at",
    "de": "der die und das ist nicht ein eine den von zu mit sich des auf im dem",
    "fr": "le les et des est une du que pour dans pas sur au avec ce qui par",
    "es": "el los las y del que una por con para su no se al lo como más",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def _word_ids(data: np.ndarray, w: Words, base: np.ndarray) -> np.ndarray:
    """(words, 1 + prefixes) table rows: of the word, and of its first bytes if it is longer."""
    n = len(w.h)
    ids = np.empty((n, 1 + len(PREFIXES)), np.int64)
    ids[:, 0] = (w.h >> _U(64 - BITS)).astype(np.int64)
    start, size = base + w.start, w.end - w.start
    at = np.minimum(start[:, None] + np.arange(max(PREFIXES)), max(0, len(data) - 1))
    part = np.cumsum(_BYTE[data[at]] * powers(_BASE, max(PREFIXES)), axis=1) if n else np.empty((0, max(PREFIXES)), _U)
    for j, p in enumerate(PREFIXES):
        h = mix(part[:, p - 1] + _U(1_000_003 * p))
        ids[:, j + 1] = np.where(size > p, (h >> _U(64 - BITS)).astype(np.int64), ids[:, 0])
    return ids


def _hash_words(words: list[str]) -> np.ndarray:
    data, off = buffers(pa.array([" ".join(words)]))
    return next(blocks(data, off))[2].h


def _language_table() -> np.ndarray:
    """Language (1 + index) of each function word's table row, 0 elsewhere and for shared words."""
    table = np.zeros(1 << BITS, np.uint8)
    clash = np.zeros(1 << BITS, bool)
    for i, text in enumerate(FUNCTION_WORDS.values()):
        rows = (_hash_words(text.split()) >> _U(64 - BITS)).astype(np.int64)
        clash[rows[table[rows] > 0]] = True
        table[rows] = i + 1
    table[clash] = 0
    return table


def _languages(ids: np.ndarray, ptr: np.ndarray, table: np.ndarray) -> np.ndarray:
    hit = table[ids[:, 0]]
    counts = np.stack([np.diff(np.concatenate(([0], np.cumsum(hit == i + 1)))[ptr]) for i in range(len(FUNCTION_WORDS))], 1)
    return np.where(counts.max(1) > 0, counts.argmax(1), len(FUNCTION_WORDS))


def encoded(data: np.ndarray, off: np.ndarray):
    """(first doc, word ids, ptr) block after block."""
    for i, j, w in blocks(data, off):
        base = np.repeat(off[i:j], np.diff(w.ptr))
        yield i, _word_ids(data, w, base), w.ptr


@dataclass
class Net:
    table: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    slope: float = 1.0
    bars: dict[int, float] = field(default_factory=dict)
    constant: float | None = None

    def pooled(self, ids: np.ndarray, ptr: np.ndarray, places: bool = False):
        """Maxima (documents, widths * filters), and with ``places`` the word where each window starts."""
        e = self.table[ids].sum(1) if len(ids) else np.zeros((0, DIM), np.float32)
        n, docs = len(e), len(ptr) - 1
        full = np.flatnonzero(np.diff(ptr))
        top = np.zeros((docs, len(WIDTHS) * FILTERS), np.float32)
        at = np.full(top.shape, -1, np.int64)
        end = np.repeat(ptr[1:], np.diff(ptr))
        for k, (width, f, b) in enumerate(zip(WIDTHS, self.filters, self.biases)):
            if n < width or not len(full):
                continue
            m = n - width + 1
            a = np.zeros((n, FILTERS), np.float32)
            for d in range(width):
                a[:m] += e[d:d + m] @ f[d]
            a[:m] = np.maximum(a[:m] + b, 0)
            a[np.arange(n) + width > end] = 0
            best = np.maximum.reduceat(a, ptr[:-1][full], axis=0)
            top[full, k * FILTERS:(k + 1) * FILTERS] = best
            if places:
                doc = np.repeat(np.arange(len(full)), np.diff(ptr)[full])
                hit = (a == best[doc]) & (a > 0)
                for c in range(FILTERS):
                    rows = np.flatnonzero(hit[:, c])
                    at[full[doc[rows[::-1]]], k * FILTERS + c] = rows[::-1]
        return (top, at, e) if places else top

    def logits(self, ids: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        return self.pooled(ids, ptr) @ self.out + self.bias

    def scores(self, z: np.ndarray, language: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(z), self.constant)
        bars = np.array([self.bars.get(i, self.bars.get(-1, 0.0)) for i in range(len(LANGUAGES))])
        x = self.slope * (z - bars[language]) + np.log(BAR / (1 - BAR))
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))

    def rest(self) -> np.ndarray:
        """All parameters but the embeddings."""
        return np.concatenate([*[f.ravel() for f in self.filters], *self.biases, self.out, [self.bias]]).astype(np.float32)

    def with_parameters(self, table: np.ndarray, rest: np.ndarray) -> "Net":
        sizes = [*[f.size for f in self.filters], *[b.size for b in self.biases], self.out.size]
        *parts, last = np.split(rest.astype(np.float32), np.cumsum(sizes))
        k = len(WIDTHS)
        return Net(table, [x.reshape(f.shape).copy() for x, f in zip(parts, self.filters)], [x.copy() for x in parts[k:2 * k]], parts[2 * k].copy(), float(last[0]))


def _gather(ids: np.ndarray, ptr: np.ndarray, docs: np.ndarray):
    size = ptr[docs + 1] - ptr[docs]
    new = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(ptr[docs] - new[:-1], size) + np.arange(new[-1])
    return ids[at], new


def _first_net(seed: int) -> Net:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.02, (1 << BITS, DIM)).astype(np.float32)
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    net = Net(table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.05, len(WIDTHS) * FILTERS).astype(np.float32), -2.0)
    for k, w in enumerate(WIDTHS):
        filters[k][:, 0, 0] = 1.0 / w
        net.out[k * FILTERS] = 0.5
    return net


def _log_odds(pos: np.ndarray, neg: np.ndarray, share: float) -> np.ndarray:
    """Shrunken log-odds of label 1 by table row, from the documents of either label that hold it."""
    p = (pos + 8 * share) / (pos + neg + 8)
    return np.log(p / (1 - p)) - np.log(share / (1 - share))


def _batches(order: np.ndarray, ptr: np.ndarray) -> Iterator[np.ndarray]:
    """Up to BATCH documents at a time, of WORDS_AT_ONCE words unless one alone has more."""
    size, at = ptr[order + 1] - ptr[order], 0
    while at < len(order):
        words = np.cumsum(size[at:at + BATCH])
        n = max(1, int(np.searchsorted(words, WORDS_AT_ONCE, "right")))
        yield order[at:at + n]
        at += n


def _descend(net: Net, ids: np.ndarray, ptr: np.ndarray, y: np.ndarray, share: float, epoch: int, seed: list[int]) -> None:
    """One epoch of stochastic gradient descent over the documents (word ids, document bounds, labels 0/1)."""
    rate = RATE / (1 + epoch)
    for docs in _batches(np.random.default_rng(seed).permutation(len(y)), ptr):
        x, p = _gather(ids, ptr, docs)
        top, where, e = net.pooled(x, p, places=True)
        z = top @ net.out + net.bias
        weight = np.where(y[docs] > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        g = (1 / (1 + np.exp(-z)) - y[docs]) * weight / len(docs)
        g_top = g[:, None] * net.out[None] * (where >= 0)
        net.out -= rate * 10 * (top.T @ g + 1e-4 * net.out)
        net.bias -= rate * 10 * float(g.sum())
        for k, w in enumerate(WIDTHS):
            sl = slice(k * FILTERS, (k + 1) * FILTERS)
            d, c = np.nonzero(g_top[:, sl])
            if not len(d):
                continue
            gv, start = g_top[:, sl][d, c], where[:, sl][d, c]
            f = net.filters[k].copy()
            np.subtract.at(net.biases[k], c, rate * gv)
            for s in range(w):
                step = rate * gv[:, None] * e[start + s]
                np.subtract.at(net.filters[k][s].T, c, step)
                ge = rate * 10 * gv[:, None] * f[s][:, c].T
                for j in range(x.shape[1]):
                    np.subtract.at(net.table, x[start + s, j], ge)


_BLOCK = "shard long, learn boolean, docs long, positives long, sizes binary, toxic binary, words binary"


_BLOCK_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _block(table: pa.Table, y: np.ndarray, shard: int, learn: bool) -> tuple:
    """Documents of one shard and their labels as one row: the labels, word counts and word ids."""
    data, off = buffers(table.column("text").combine_chunks())
    sizes, words = [], []
    for _, ids, ptr in encoded(data, off):
        sizes.append(np.diff(ptr))
        words.append(ids.astype("<u2").tobytes())
    return shard, learn, len(y), int(y.sum()), np.concatenate(sizes).astype("<i8").tobytes(), y.tobytes(), b"".join(words)


def _labelled(docs: pa.Table, truth: pa.Table) -> pa.Table:
    """The blocks of one shard, from its documents and its labels."""
    docs, truth = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")]), truth.sort_by("doc_id")
    known, doc_id = truth.column("doc_id").to_numpy(), docs.column("doc_id").to_numpy()
    at = np.minimum(np.searchsorted(known, doc_id), max(0, len(known) - 1))
    found = known[at] == doc_id if len(known) else np.zeros(len(doc_id), bool)
    learn = docs.column("learn").to_numpy(zero_copy_only=False)
    rows = []
    for part in (True, False):
        take = found & (learn == part)
        if take.any():
            y = truth.column("toxic").to_numpy()[at[take]].astype(np.uint8)
            rows.append(_block(docs.filter(pa.array(take)), y, docs.column("shard")[0].as_py(), part))
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * len(_BLOCK_TYPES), _BLOCK_TYPES)], names=[c.split()[0] for c in _BLOCK.split(", ")])


def _opened(batches: Iterator[pa.RecordBatch]):
    """(shard, word ids, document bounds, labels) of every block."""
    for b in batches:
        for shard, sizes, toxic, words in zip(*(b.column(c) for c in ("shard", "sizes", "toxic", "words"))):
            ptr = np.concatenate(([0], np.cumsum(np.frombuffer(sizes.as_buffer(), "<i8")))).astype(np.int64)
            yield (shard.as_py(), np.frombuffer(words.as_buffer(), "<u2").reshape(-1, 1 + len(PREFIXES)), ptr,
                   np.frombuffer(toxic.as_buffer(), np.uint8).astype(np.float32))


def labelled_blocks(docs: DataFrame, labels: DataFrame, seed: int = 1) -> DataFrame:
    """Every labelled document that is not held out, encoded, in a block a shard; blocks with ``learn`` train, the others calibrate."""
    truth = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")))
    own = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out())
    bytes_, rows = own.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    part = min(1.0, truth.count() / max(1, rows))
    shards = max(1, math.ceil((bytes_ or 0) * part / SHARD_BYTES))
    text_batches(docs.sparkSession)
    # a shard holds whole documents by id, so that texts meet their labels and their shard in one shuffle
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id").cast("long")), F.lit(shards)).alias("shard")
    own, _ = split_by_ids(own.withColumn("doc_id", F.col("doc_id").cast("long")), truth.select(F.col("doc_id").cast("long").alias("doc_id")))
    dealt = own.select("doc_id", "text", (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(4)) > 0).alias("learn"), shard)
    truth = truth.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", shard)
    both = dealt.repartition(shards, "shard").groupBy("shard").cogroup(truth.repartition(shards, "shard").groupBy("shard"))
    return stored(both.applyInArrow(_labelled, _BLOCK), "toxic-blocks")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, pos, neg): by table row, the documents of either label that hold it."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for _, ids, ptr, y in _opened(batches):
        for a, b, label in zip(ptr[:-1], ptr[1:], y):
            counts[int(label), np.unique(ids[a:b])] += 1
    at = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[1, at]), pa.array(counts[0, at])], names=["row", "pos", "neg"])


def _averaged(blocks_: DataFrame, net: Net, share: float, epoch: int, seed: int) -> Net:
    """The mean of the nets that an epoch over each block makes of ``net``."""
    shared = blocks_.sparkSession.sparkContext.broadcast(net)
    pieces = (1 << BITS) // CHUNK                           # the embeddings in chunks, then all other parameters

    def train(batches):
        for shard, ids, ptr, y in _opened(batches):
            own = shared.value.with_parameters(shared.value.table.copy(), shared.value.rest())
            _descend(own, ids, ptr, y, share, epoch, [seed, epoch, shard])
            moves = own.table - shared.value.table          # mostly zeros, which Spark's shuffle compresses
            values = [*[x.tobytes() for x in np.split(moves, pieces)], own.rest().tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), shard)), pa.array(np.full(len(values), len(y))),
                                              pa.array(np.arange(len(values))), pa.array(values, pa.binary())], names=["shard", "docs", "chunk", "values"])

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        chunk, docs = table.column("chunk")[0].as_py(), table.column("docs").to_numpy().astype(np.float64)
        values = [np.frombuffer(v.as_buffer(), np.float32) for v in table.column("values")]
        if chunk == pieces:
            out = sum(n * v for n, v in zip(docs, values)) / docs.sum()
        else:
            first = shared.value.table[chunk * CHUNK:(chunk + 1) * CHUNK]
            total, moved = np.zeros(first.shape), np.zeros((CHUNK, 1))
            for n, v in zip(docs, values):
                step = v.reshape(first.shape)
                total += n * step
                moved += n * step.any(1, keepdims=True)
            out = first + total / np.maximum(moved, 1)
        return pa.table({"chunk": pa.array([chunk], pa.int64()), "values": pa.array([out.astype(np.float32).tobytes()], pa.binary())})

    kind = "chunk long, values binary"
    rows = (blocks_.mapInArrow(lean(train), "shard long, docs long, " + kind).groupBy("chunk").applyInArrow(mean, kind)
            .orderBy("chunk").collect())                    # one net
    shared.unpersist()
    *table, rest = [np.frombuffer(r["values"], np.float32) for r in rows]
    return net.with_parameters(np.concatenate(table).reshape(net.table.shape), rest)


def _bar(logits: DataFrame) -> float:
    """The threshold of best F1 of (z, toxic), in the middle of the plateau that reaches it."""
    per = logits.groupBy("z").agg(F.sum("toxic").alias("hits"), F.count("*").alias("n"))
    rows, positives = per.agg(F.count("*"), F.sum("hits")).first()
    f1 = 2 * F.col("hits_cum") / (F.col("n_cum") + positives)
    best = running_totals(per, "z", ["hits", "n"], descending=True, n_rows=rows).agg(F.max(F.struct(f1.alias("f1"), "z")).alias("b")).first()["b"]["z"]
    low = per.where(F.col("z") < best).agg(F.max("z")).first()[0]
    return (best + (best - 1 if low is None else low)) / 2


def _calibrate(net: Net, blocks_: DataFrame) -> None:
    shared = blocks_.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        table = _language_table()
        for _, ids, ptr, y in _opened(batches):
            z = []
            for docs in _batches(np.arange(len(y)), ptr):
                z.append(shared.value.logits(*_gather(ids, ptr, docs)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).astype(np.float64)), pa.array(_languages(ids, ptr, table)),
                                              pa.array(y.astype(np.int64))], names=["z", "language", "toxic"])

    rows = stored(blocks_.mapInArrow(lean(run), "z double, language long, toxic long"), "toxic-logits")
    net.bars[-1] = _bar(rows)
    for r in rows.groupBy("language").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).orderBy("language").collect():
        if r["pos"] >= 10 and r["neg"] >= 30:
            net.bars[r["language"]] = _bar(rows.where(F.col("language") == r["language"]))
    bars = F.array(*[F.lit(float(net.bars.get(i, net.bars[-1]))) for i in range(len(LANGUAGES))])
    d, t = F.col("z") - F.element_at(bars, F.col("language").cast("int") + 1), F.col("toxic")
    slope = 1.0                                              # spread of the calibrated scores, by Newton steps
    for _ in range(20):
        q = 1 / (1 + F.exp(-F.least(F.greatest(F.lit(slope) * d + math.log(BAR / (1 - BAR)), F.lit(-30.0)), F.lit(30.0))))
        up, down = rows.agg(F.sum((t - q) * d), F.sum(q * (1 - q) * d * d)).first()
        before, slope = slope, slope + (up - 0.1 * (slope - 1)) / (down + 0.1)
        slope = min(max(slope, 0.2), 5.0)
        if abs(slope - before) < 1e-9:
            break
    net.slope = slope


def toxic_model(docs: DataFrame, labels: DataFrame, seed: int = 1) -> Net:
    """A net trained on all labelled documents that are not held out."""
    every = labelled_blocks(docs, labels, seed)
    count = {r["learn"]: (r["docs"], r["positives"]) for r in every.groupBy("learn").agg(F.sum("docs").alias("docs"), F.sum("positives").alias("positives")).collect()}
    n, positives = (sum(x) for x in zip((0, 0), *count.values()))
    share = positives / n if n else 0.5
    net = _first_net(seed)
    both = {k for k, (d, p) in count.items() if 0 < p < d}
    if n < 4 or True not in both:
        net.constant = share
        return net
    learn = every.where("learn")
    pos, neg = np.zeros((2, 1 << BITS))
    for r in learn.mapInArrow(lean(_counted), "row long, pos long, neg long").groupBy("row").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect():
        pos[r["row"]], neg[r["row"]] = r["pos"], r["neg"]   # at most 2**BITS rows
    net.table[:, 0] = _log_odds(pos, neg, count[True][1] / count[True][0]) / (1 + len(PREFIXES)) * 2
    for epoch in range(EPOCHS):
        release(docs.sparkSession)                          # the texts' shuffle, and the last epoch's
        net = _averaged(learn, net, share, epoch, seed)
    _calibrate(net, every.where("not learn") if False in both else every)
    release(docs.sparkSession)
    return net


def score_toxicity(docs: DataFrame, labels: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted, language) for every row of ``docs``."""
    net = docs.sparkSession.sparkContext.broadcast(toxic_model(docs, labels, seed))     # 2 MB

    def score(batches):
        model, table = net.value, _language_table()
        for b in batches:
            data, off = buffers(b.column("text"))
            s, lang = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for i, ids, ptr in encoded(data, off):
                k = slice(i, i + len(ptr) - 1)
                lang[k] = _languages(ids, ptr, table)
                s[k] = model.scores(model.logits(ids, ptr), lang[k])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array([LANGUAGES[x] for x in lang], pa.string())], names=["doc_id", "score", "language"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double, language string")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= BAR).cast("int").alias("predicted"), "language")
