"""Nearest neighbours by inner product with balanced posting lists (operator 5).

Equal vectors are one point that keeps its smallest ids, as many as a result can show.  A bounded
sample of points is halved again and again into equal leaves, whose means are the list centroids.
Inner product becomes distance by one more coordinate that makes all points equally long.  Every
point is listed under its nearest centroid, and under further ones nearly as near (boundary
points), unless a chosen centroid lies between.  A query walks an in-memory graph of the centroids: each is joined, both ways, with its
nearest ones and with those 1, 2, 4, ... places off in the order of the halving, which connects the graph and
gives it long edges.  The walk starts at spread entries and expands the best ``beam`` centroids seen.  The query searches the
lists seen within a ratio of the nearest one's distance.  Beam and ratio are set on the sample, through the same
walk, so that ``aim`` of its true neighbours lie in the searched lists.

Lists are cut into blocks of at most ``BLOCK`` points and their queries into blocks as well, so no
task grows with a list; duplicates never meet as pairs.  Scores are in double precision on the
original vectors.  Vectors that are null, zero, or hold null or non-finite components take no part,
nor do vectors of another length than the most common.  Every row is a point of its own: a repeated row, or another row of the
query's vec_id, is a candidate like all others.  An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from kiln.llm.shared import stored

SAMPLE, TRIALS, BLOCK = 20_000, 300, 4096
EDGES, ENTRIES, BEAM = 16, 16, 32
REPLICAS, BOUNDARY, AIM = 4, 0.10, 0.975


def clean_vectors(table: DataFrame, vec: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    rows = (table.where(v.isNotNull() & F.col("vec_id").isNotNull()).where(~bad).where(F.exists(v, lambda x: x != 0))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double") + 0.0).alias("v")))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("v") == (size[0]["d"] if size else 0)), (size[0]["d"] if size else 0)


def halved(x: np.ndarray, leaves: int, rng: np.random.Generator) -> np.ndarray:
    """Means of ``leaves`` nearly equal parts: each cut is at the weighted median along the line
    between two means found by a few rounds of balanced 2-means."""
    if leaves <= 1 or len(x) <= 1:
        return x.mean(0, keepdims=True)
    left = leaves // 2
    a, b = x[rng.choice(len(x), 2, replace=False)]
    for _ in range(6):
        order = np.argsort(x @ (b - a), kind="stable")
        cut = len(x) * left // leaves
        a, b = x[order[:cut]].mean(0) if cut else a, x[order[cut:]].mean(0)
    return np.vstack([halved(x[order[:cut]], left, rng), halved(x[order[cut:]], leaves - left, rng)]) if cut else x.mean(0, keepdims=True)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T))


def _graph(c: np.ndarray) -> np.ndarray:
    """Neighbours of each centroid, a row each, filled up with the centroid itself."""
    n = len(c)
    joined: list[set[int]] = [set() for _ in range(n)]
    for lo in range(0, n, 512):
        near = np.argsort(_distances(c[lo:lo + 512], c), axis=1, kind="stable")[:, 1:EDGES + 1]
        for i, row in enumerate(near.tolist()):
            joined[lo + i].update(row)
    for i in range(n):
        joined[i].update(i + step for step in (1 << b for b in range(n.bit_length())) if i + step < n)
    for i in range(n):
        for j in list(joined[i]):
            joined[j].add(i)
    out = np.repeat(np.arange(n)[:, None], max(1, max(len(j - {i}) for i, j in enumerate(joined))), axis=1)
    for i, j in enumerate(joined):
        own = sorted(j - {i})
        out[i, :len(own)] = own
    return out


class Index:
    """Centroids, their graph and the search ratio: bounded by the sample (an eighth of its rows)."""

    def __init__(self, centroids: np.ndarray, longest: float):
        self.c, self.longest, self.ratio, self.beam = centroids.astype(np.float32), longest, 1.0, BEAM
        self.edges = _graph(self.c)
        self.between = _distances(self.c, self.c)

    def lift(self, v: np.ndarray) -> np.ndarray:
        """Points with the coordinate that makes all equally long."""
        return np.hstack([v, np.sqrt(np.maximum(0, self.longest ** 2 - (v * v).sum(1)))[:, None]]).astype(np.float32)

    def listed(self, v: np.ndarray) -> list[np.ndarray]:
        """The lists of each point: the nearest, then boundary ones that no chosen centroid hides."""
        d = _distances(self.lift(v), self.c)
        near = np.argsort(d, axis=1, kind="stable")[:, :2 * REPLICAS]
        between = self.between
        out = []
        for row, order in zip(d, near):
            chosen = [order[0]]
            for j in order[1:]:
                if len(chosen) < REPLICAS and row[j] <= (1 + BOUNDARY) * row[order[0]] and all(between[j, i] > row[j] * 0.5 for i in chosen):
                    chosen.append(j)
            out.append(np.array(chosen))
        return out

    def walked(self, q: np.ndarray) -> np.ndarray:
        """Distances of queries to the centroids that their walks see; infinite to the others.

        All queries take a step at a time: each expands the best centroid that it has not, until the best
        ``beam`` that it has seen are expanded."""
        x = np.hstack([q, np.zeros((len(q), 1))]).astype(np.float32)
        n, every = len(self.c), np.arange(len(q))
        seen = np.full((len(q), n), np.inf, np.float32)
        done = np.zeros((len(q), n), bool)
        start = np.unique(np.linspace(0, n - 1, min(ENTRIES, n)).astype(int))
        seen[:, start] = _distances(x, self.c[start])
        width = min(self.beam, n)
        active = every
        while len(active):
            d = seen[active]
            edge = np.partition(d, width - 1, axis=1)[:, width - 1]
            open_ = np.where(done[active] | (d > edge[:, None]), np.inf, d)
            best = open_.argmin(axis=1)
            go = np.isfinite(open_[np.arange(len(active)), best])
            active, best = active[go], best[go]
            if not len(active):
                break
            done[active, best] = True
            to = self.edges[best]
            new = np.sqrt(((self.c[to] - x[active][:, None]) ** 2).sum(axis=2))
            seen[active[:, None], to] = new
        return seen

    def searched(self, q: np.ndarray) -> list[np.ndarray]:
        """The lists of each query: all seen within ``ratio`` times the nearest."""
        return [np.flatnonzero(r <= self.ratio * r.min() + 1e-6) for r in self.walked(q)]

    def calibrate(self, sample: np.ndarray, k: int, aim: float, rng: np.random.Generator) -> None:
        """The least beam (doubled from BEAM) and ratio at which the searched lists hold ``aim`` of the sample's neighbours."""
        pick = rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)
        scores = sample[pick] @ sample.T
        scores[np.arange(len(pick)), pick] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return
        true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        flat = self.listed(sample[true.ravel()])
        while True:
            d = self.walked(sample[pick])
            d /= np.maximum(d.min(1, keepdims=True), 1e-9)
            need = np.sort([d[i // k, lists].min() for i, lists in enumerate(flat)])
            ratio = float(need[min(len(need) - 1, math.ceil(aim * len(need)) - 1)])
            if math.isfinite(ratio):
                self.ratio = ratio + 1e-4
                return
            self.beam *= 2                                # a beam of all centroids sees all, as the graph is connected


def build_index(points: DataFrame, k: int, aim: float = AIM, seed: int = 3) -> Index | None:
    """The index from at most SAMPLE points, drawn by hash."""
    n, longest = points.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    if not n:
        return None
    part = points.where(F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.9 * SAMPLE / n)) + 1)
    rows = part.select("gid", "v").orderBy(F.xxhash64(F.lit(seed), "v")).limit(SAMPLE).toPandas()
    if not len(rows):
        rows = points.select("gid", "v").orderBy("gid").limit(100).toPandas()
    sample = np.array(rows["v"].tolist(), np.float64)
    rng = np.random.default_rng(seed)
    lists = max(1, min(round(2 * n ** (1 / 3)), len(sample) // 8 or 1))
    lift = np.hstack([sample, np.sqrt(np.maximum(0, longest ** 2 - (sample * sample).sum(1)))[:, None]])
    index = Index(halved(lift, lists, rng), float(longest))
    index.calibrate(sample, k, aim, rng)
    return index


def _route(index: Index, method: str):
    def run(frames):
        for f in frames:
            for at in range(0, len(f), 512):
                part = f.iloc[at:at + 512]
                x = np.array(part["v"].tolist(), np.float64)
                lists = getattr(index, method)(x)
                rep = np.repeat(np.arange(len(part)), [len(y) for y in lists])
                yield pd.DataFrame({"list": np.concatenate(lists).astype(np.int32), "gid": part["gid"].to_numpy()[rep],
                                    "low": part["low"].to_numpy()[rep], "v": part["v"].to_numpy()[rep]})
    return run


def _search(k: int):
    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(points):
            return pd.DataFrame({"q": np.empty(0, np.int64), "gid": np.empty(0, np.int64), "score": np.empty(0), "low": np.empty(0, np.int64)})
        x, low, gid = np.array(points["v"].tolist(), np.float64), points["low"].to_numpy(), points["gid"].to_numpy()
        out = []
        for at in range(0, len(queries), 256):
            q = np.array(queries["v"].iloc[at:at + 256].tolist(), np.float64)
            s = q @ x.T
            m = min(k, s.shape[1])
            edge = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m] - 1e-9
            for i, row in enumerate(s):
                c = np.flatnonzero(row >= edge[i])
                exact = (x[c] * q[i]).sum(1)
                top = np.lexsort((low[c], -exact))[:m]
                out.append(pd.DataFrame({"q": queries["gid"].iat[at + i], "gid": gid[c[top]], "score": exact[top], "low": low[c[top]]}))
        return pd.concat(out)
    return run


def nearest(table: DataFrame, every: int = 20, k: int = 20, aim: float = AIM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` found nearest to each vector whose id is divisible by
    ``every``, among all others."""
    rows, _ = clean_vectors(table)
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1)
    points = kept.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("low", F.element_at("ids", 1))
    points = stored(points, "points").withColumn("gid", F.monotonically_increasing_id())
    points = stored(points, "numbered-points")
    asked = rows.where(F.col("vec_id") % every == 0).join(points.select("v", "gid"), "v")
    asked = stored(asked.select(F.monotonically_increasing_id().alias("ask"), F.col("vec_id").alias("query_id"), "gid"), "queries")
    index = build_index(points, k, aim)
    kind = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return table.sparkSession.createDataFrame([], kind)
    routed = "list int, gid long, low long, v array<double>"
    posts = points.mapInPandas(_route(index, "listed"), routed)
    posts = stored(posts, "postings")
    wanted = points.join(asked.select("gid").distinct(), "gid", "left_semi").select("gid", "v", "low")
    probes = stored(wanted.mapInPandas(_route(index, "searched"), routed), "probes")
    blocks_of = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    cut = F.broadcast(blocks_of(posts, "pb").join(blocks_of(probes, "qb"), "list"))       # one row a list: an eighth of SAMPLE at most
    block = lambda n: F.pmod(F.xxhash64("gid"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = posts.join(cut, "list").withColumn("pi", block("pb")).withColumn("qi", spread("qb")).select("list", "pi", "qi", "gid", "low", "v")
    q = probes.join(cut, "list").withColumn("qi", block("qb")).withColumn("pi", spread("pb")).select("list", "pi", "qi", "gid", "low", "v")
    key = ["list", "pi", "qi"]
    found = q.groupBy(*key).cogroup(p.groupBy(*key)).applyInPandas(_search(k + 1), "q long, gid long, score double, low long")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "low")
    top = (found.dropDuplicates(["q", "gid"]).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
           .join(points.select("gid", "ids"), "gid").select("q", "gid", "score", F.posexplode("ids").alias("at", "vec_id")))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "gid", "at")
    top = top.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    top = stored(top.select("q", "score", "vec_id", F.col("gid").alias("point"), "at"), "found")
    # the query's own row: the first of its vec_id at its own point
    met = asked.join(top, asked.gid == top.q)
    mine = Window.partitionBy("ask").orderBy((F.col("point") == F.col("gid")).desc(), (F.col("vec_id") == F.col("query_id")).desc(), "at")
    met = met.withColumn("own", F.row_number().over(mine)).where(
        ~((F.col("own") == 1) & (F.col("point") == F.col("gid")) & (F.col("vec_id") == F.col("query_id"))))
    own = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id", "point", "at")
    return (met.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
