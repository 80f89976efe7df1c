"""Exact k-nearest neighbours as a cell-pruned, blocked join — no row pair is materialised.

1. Cells: KMeans centres fitted on a bounded sample of the training vectors; every
   training row is assigned to its nearest centre (JVM-side model transform).
2. Per cell: row count and radius (largest distance of a member to its centre) — a
   P-row aggregate (distances by a vectorised pandas UDF with the P centres in its closure).
3. Per query, from its distances to the P centres (``mapInArrow``, numpy over Arrow
   batches): an upper bound U on its k-th neighbour distance (cells ordered by d + r until
   k rows are covered) and the candidate cells with d - r <= U (plus a rounding margin that
   only adds candidates).  By the triangle inequality no true neighbour lies outside them,
   so the answer is exact.
4. Blocks: a cell is cut into sub-blocks of at most T_BLOCK training rows (so a cell holding
   a third of the data is still many bounded groups), neighbouring small cells share a block, and
   the queries go into blocks of at most Q_MOST rows.  A query is sent once to each block with
   one of its candidate cells, in bounded Arrow batches.  Each (query block, block) group is one
   cogroup; a vectorised numpy kernel computes its distances in bounded chunks, on the cells
   that the chunk's queries want, and emits only a local top-k per
   query.  Then ``row_number() <= k`` per query, ordered by (distance, id), picks the answer
   (Spark runs it as a per-task group limit before the final sort).
5. Vote (classification, ties to the smallest label) or mean (regression); ``weights=
   "distance"`` uses 1/d, and exact matches (d = 0) take all the weight.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd  # noqa: F401 — resolves the pandas UDF type hints below
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from kiln.functions.columns import qcol

MAX_CELLS = 256
SAMPLE_FOR_CELLS = 200_000


def _as_double_array(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def _cells(train: DataFrame, n_train: int, seed: int):
    """(assign, centres): ``assign(df)`` adds the int column ``_cell`` to rows with ``_vec``."""
    n_cells = max(1, min(MAX_CELLS, int(round(math.sqrt(n_train / 2.0)))))
    if n_cells == 1:
        # One cell: any centre keeps the triangle-inequality bounds valid.
        first = train.select("_vec").head(1)[0][0]
        return (lambda df: df.withColumn("_cell", F.lit(0))), [[float(v) for v in first]]
    frac = min(1.0, SAMPLE_FOR_CELLS / max(n_train, 1))
    sample = train.sample(False, frac, seed) if frac < 1.0 else train
    feats = sample.select(array_to_vector("_vec").alias("features"))
    # Cells only prune candidates; rough centres are enough, so few iterations.
    model = KMeans(k=n_cells, seed=seed, maxIter=8, initSteps=2, featuresCol="features",
                   predictionCol="_cell").fit(feats)
    centers = [[float(v) for v in c] for c in model.clusterCenters()]

    def assign(df):
        out = model.transform(df.withColumn("features", array_to_vector("_vec"))).drop("features")
        return out.withColumn("_cell", F.col("_cell").cast("int"))
    return assign, centers


# Bounded group sizes for the blocked distance kernel: rows of a block of training rows, of a small and of the largest block
# of queries; small ones are used as long as there are fewer than GROUPS groups.
T_BLOCK = 32768
Q_BLOCK, Q_MOST = 4096, 32768
GROUPS = 96
# Numbers of a distance matrix, and candidates ranked at once.
_CHUNK, _RANKED = 1 << 21, 1 << 15
_QUERIES = 1024


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column as rows (a NULL number becomes NaN)."""
    chunks = [c for c in getattr(column, "chunks", [column]) if len(c)]
    if not chunks:
        return np.empty((0, 0))
    sizes = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in chunks])
    if (sizes != sizes[0]).any():
        raise ValueError("vectors must have the same length")
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]).reshape(len(sizes), int(sizes[0]))


def _local_topk(k: int):
    """Arrow cogroup kernel: top-k training rows per query within one block pair.

    Candidates are chosen on the BLAS form |q|^2 + |t|^2 - 2 q.t with a margin far above its
    rounding error, then re-ranked on exact direct distances, ties to the smaller id.
    """
    schema = ["_qid", "_tid", "_y", "_d"]

    def ranked(Q, T, tid, rows, cols):
        """The k nearest of each row's candidates (``rows`` ascending)."""
        d = np.sqrt(((T[cols] - Q[rows]) ** 2).sum(1))
        order = np.lexsort((tid[cols], d, rows))
        r = rows[order]
        first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        nth = np.arange(len(r)) - np.repeat(first, np.diff(np.concatenate((first, [len(r)]))))
        best = order[nth < k]
        return rows[best], cols[best], d[best]

    def run(q: pa.Table, t: pa.Table) -> pa.Table:
        types = [q.schema.field("_qid").type, t.schema.field("_tid").type, t.schema.field("_y").type, pa.float64()]
        none = pa.table([pa.array([], ty) for ty in types], names=schema)
        if not q.num_rows or not t.num_rows:
            return none
        # both sides by cell, so that a chunk's queries want few runs of training rows
        t = t.take(pa.array(np.argsort(t["_cell"].to_numpy(), kind="stable")))
        q = q.take(pa.array(np.argsort(q["_near"].to_numpy(), kind="stable")))
        Q, T, tid, cell = _matrix(q["_qvec"]), _matrix(t["_vec"]), t["_tid"].to_numpy(), t["_cell"].to_numpy()
        wanted = np.stack([np.frombuffer(m, np.uint8) for m in q["_cells"].to_pylist()])
        tn = (T * T).sum(1)
        dim, out = T.shape[1], []
        step = max(1, _CHUNK // len(T))
        for s0 in range(0, len(Q), step):
            x = Q[s0:s0 + step]
            cells = np.unpackbits(np.bitwise_or.reduce(wanted[s0:s0 + step]))
            at = np.flatnonzero(cells[cell])
            if not len(at):
                continue
            part, pn = (T, tn) if len(at) == len(T) else (T[at], tn[at])
            kk = min(k, len(at))
            qn = (x * x).sum(1)
            approx = x @ part.T
            approx *= -2.0
            approx += qn[:, None]
            approx += pn[None, :]
            # the k-th least of the minima of some runs bounds the k-th least number from above
            run_size = max(1, len(at) // (64 * kk))
            least = approx if run_size == 1 else np.minimum.reduceat(approx, np.arange(0, len(at), run_size), axis=1)
            tau = np.partition(least, kk - 1, axis=1)[:, kk - 1]
            slack = 1e-9 * dim * (qn + pn.max()) + 1e-300
            hit = approx <= (tau + slack)[:, None]
            ends = np.cumsum(hit.sum(1))
            i = 0
            while i < len(x):                              # as many queries as have _RANKED candidates, one at least
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _RANKED, "right")))
                rows, cols = np.nonzero(hit[i:j])
                if len(rows):
                    r, c, d = ranked(x[i:j], part, tid[at], rows, cols)
                    out.append((r + s0 + i, at[c], d))
                i = j
        if not out:
            return none
        r, c, d = (np.concatenate(z) for z in zip(*out))
        c = pa.array(c)
        cols = [q["_qid"].take(pa.array(r)), t["_tid"].take(c), t["_y"].take(c), pa.array(d)]
        return pa.table([x.cast(ty) for x, ty in zip(cols, types)], names=schema)
    return run


def _center_distance(centers: list[list[float]]):
    """Scalar pandas UDF: distance of each vector to the centre of its cell (centres in the
    closure: at most MAX_CELLS x dim numbers)."""
    import numpy as np
    import pandas as pd
    cmat = np.asarray(centers, dtype=np.float64)

    @F.pandas_udf("double")
    def dist(vec: pd.Series, cell: pd.Series) -> pd.Series:
        if len(vec) == 0:
            return pd.Series([], dtype="float64")
        v = np.stack(vec.to_numpy()).astype(np.float64)
        c = cmat[cell.to_numpy().astype(np.int64)]
        return pd.Series(np.sqrt(((v - c) ** 2).sum(1)))
    return dist


def _blocks(centers, counts) -> tuple[list[int], list[int], int]:
    """(first block, number of blocks) of each cell, and the number of all blocks: a cell above T_BLOCK rows has blocks of its
    own, smaller ones share a block with cells nearby."""
    C = np.asarray(centers, dtype=np.float64)
    left = [i for i, n in enumerate(counts) if n]
    first, subs = [0] * len(counts), [1] * len(counts)
    new, room = 0, 0                                       # blocks so far, room in the last shared one
    at, shared = C.mean(0), 0
    while left:                                            # a walk to the nearest cell left
        i = min(left, key=lambda c: (float(((C[c] - at) ** 2).sum()), c))
        left.remove(i)
        at = C[i]
        if counts[i] > T_BLOCK:
            first[i], subs[i] = new, math.ceil(counts[i] / T_BLOCK)
            new += subs[i]
            continue
        if counts[i] > room:
            shared, room, new = new, T_BLOCK, new + 1
        first[i] = shared
        room -= counts[i]
    return first, subs, max(1, new)


def _query_blocks(centers, radii, counts, first, subs, k: int, keys_only: bool = False):
    """mapInArrow kernel: for each query, the blocks that may hold one of its
    k nearest training rows (triangle inequality, with a generous rounding margin), and the cells that may, as bits.
    With ``keys_only`` the pairs of blocks alone."""
    C = np.asarray(centers, dtype=np.float64)
    R = np.asarray(radii, dtype=np.float64)
    N = np.asarray(counts, dtype=np.int64)
    members: dict[int, list[int]] = {}
    for c in np.flatnonzero(N):
        for b in range(first[c], first[c] + subs[c]):
            members.setdefault(b, []).append(int(c))
    cn = (C * C).sum(1)
    dim = C.shape[1]

    def keep_cells(Q):
        qn = (Q * Q).sum(1)
        D2 = np.maximum(qn[:, None] + cn[None, :] - 2.0 * (Q @ C.T), 0.0)
        D = np.sqrt(D2)
        # margin far above the rounding error of the BLAS form; only adds candidates
        slack = np.sqrt(1e-9 * dim * (qn[:, None] + cn.max())) + 1e-9 * (D + R[None, :])
        hi = D + R[None, :] + slack
        order = np.argsort(hi, axis=1, kind="stable")
        cum = np.cumsum(np.where(N[order] > 0, N[order], 0), axis=1)
        reach = np.argmax(cum >= k, axis=1)
        full = cum[:, -1] >= k
        U = np.where(full, np.take_along_axis(hi, order, 1)[np.arange(len(Q)), reach], np.inf)
        return (N[None, :] > 0) & (D - R[None, :] - slack <= U[:, None]), D.argmin(1)

    def run(batches):
        sent = set()
        for batch in batches:
            for at in range(0, batch.num_rows, _QUERIES):
                part = batch.slice(at, _QUERIES)
                keep, near = keep_cells(_matrix(part.column("_qvec")))
                bits, qb = np.packbits(keep, axis=1), part.column("_qb").to_numpy()
                cells = pa.array([m.tobytes() for m in bits], pa.binary())
                for b, own in members.items():
                    rows = np.flatnonzero(keep[:, own].any(1))
                    if keys_only:
                        sent |= {(int(x), b) for x in np.unique(qb[rows])}
                    elif len(rows):
                        i = pa.array(rows)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(qb[rows], pa.int32()), pa.array(np.full(len(rows), b), pa.int32()), part.column("_qid").take(i),
                             part.column("_qvec").take(i), pa.array(near[rows], pa.int32()), cells.take(i)],
                            names=["_qb", "_block", "_qid", "_qvec", "_near", "_cells"])
        if sent:
            q, b = zip(*sorted(sent))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32())], names=["_nqb", "_nblock"])
    return run


@dataclass
class KnnIndex:
    """Training rows (``_tid``, ``_vec``, ``_y``, ``_cell``) in cells, with each cell's centre, row count and radius."""

    rows: DataFrame
    centers: list[list[float]]
    counts: list[int]
    radii: list[float]
    path: str | None = None


def _index(train: DataFrame, id_col: str, vec_col: str, target_col: str | None, seed: int) -> KnnIndex:
    tr = train.select(qcol(id_col).alias("_tid"), _as_double_array(qcol(vec_col)).alias("_vec"),
                      (qcol(target_col) if target_col else F.lit(None).cast("int")).alias("_y")) \
        .where(F.col("_vec").isNotNull())
    n_train = tr.count()
    if n_train == 0:
        raise ValueError("empty training set")
    assign, centers = _cells(tr, n_train, seed)
    assigned = assign(tr)
    stats = {r["_cell"]: (r["n"], r["r"]) for r in assigned.groupBy("_cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(_center_distance(centers)(F.col("_vec"), F.col("_cell"))).alias("r")).collect()}  # <= P rows
    at = range(len(centers))
    return KnnIndex(assigned, centers, [int(stats.get(i, (0, 0.0))[0]) for i in at], [float(stats.get(i, (0, 0.0))[1] or 0.0) for i in at])


def save_index(train: DataFrame | KnnIndex, path: str, *, id_col: str, vec_col: str, target_col: str | None = None, seed: int = 42) -> str:
    """The index of ``train`` at ``path``: its rows, a folder a cell, and its cells."""
    index = train if isinstance(train, KnnIndex) else _index(train, id_col, vec_col, target_col, seed)
    if index.path == path:
        return path
    # a cell's rows are dealt over as many files as it has blocks, so a hot cell is not one task's
    blocks = F.array(*[F.lit(max(1, math.ceil(c / T_BLOCK))) for c in index.counts])
    rows = index.rows.withColumn("_sub", F.pmod(F.xxhash64("_tid"), F.element_at(blocks, F.col("_cell") + 1)))
    rows.repartition("_cell", "_sub").drop("_sub").write.mode("overwrite").partitionBy("_cell").parquet(f"{path}/rows")
    spark = index.rows.sparkSession
    cells = [(i, c, n, r) for i, (c, n, r) in enumerate(zip(index.centers, index.counts, index.radii))]
    spark.createDataFrame(cells, "cell int, center array<double>, n long, radius double").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return path


def load_index(spark, path: str) -> KnnIndex:
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    rows = spark.read.parquet(f"{path}/rows").withColumn("_cell", F.col("_cell").cast("int"))
    return KnnIndex(rows, [list(r["center"]) for r in cells], [r["n"] for r in cells], [r["radius"] for r in cells], path)


def candidate_topk(train: DataFrame | KnnIndex, queries: DataFrame, *, id_col: str, vec_col: str,
                   query_id: str, k: int = 5, target_col: str | None = None,
                   seed: int = 42) -> DataFrame:
    """(_qid, _tid, _y, _d): for each query, the k nearest rows within each of its candidate
    blocks — a superset of its k nearest neighbours."""
    index = train if isinstance(train, KnnIndex) else _index(train, id_col, vec_col, target_col, seed)
    assigned, centers, counts, radii = index.rows, index.centers, index.counts, index.radii
    first, subs, n_blocks = _blocks(centers, counts)

    q = queries.select(qcol(query_id).alias("_qid"), _as_double_array(qcol(vec_col)).alias("_qvec")) \
        .where(F.col("_qvec").isNotNull())
    n_q = q.count()
    q_blocks = max(1, math.ceil(n_q / Q_MOST), min(math.ceil(n_q / Q_BLOCK), math.ceil(GROUPS / n_blocks)))
    q = q.withColumn("_qb", F.pmod(F.xxhash64("_qid"), F.lit(q_blocks)).cast("int"))
    id_type = dict((f.name, f.dataType.simpleString()) for f in q.schema.fields)["_qid"]
    cells = (centers, radii, counts, first, subs, k)
    qx = q.mapInArrow(_query_blocks(*cells), f"_qb int, _block int, _qid {id_type}, _qvec array<double>, _near int, _cells binary")

    of_cell = lambda v: F.element_at(F.array(*[F.lit(x) for x in v]), F.col("_cell") + 1)
    # never NULL, or Spark would ask for that before it has left out rows without a vector
    tsub = assigned.withColumn("_block", F.coalesce((of_cell(first) + F.pmod(F.xxhash64("_tid"), of_cell(subs))).cast("int"), F.lit(-1)))
    need = q.select("_qb", "_qvec").mapInArrow(_query_blocks(*cells, keys_only=True), "_nqb int, _nblock int").distinct()
    if index.path:                                          # a saved index: only the folders of wanted cells are read
        blocks = {r["_nblock"] for r in need.select("_nblock").distinct().collect()}
        tsub = tsub.where(F.col("_cell").isin([c for c, n in enumerate(counts) if n and blocks & set(range(first[c], first[c] + subs[c]))]))
    if n_blocks * q_blocks <= 100_000:
        need = F.broadcast(need)
    trep = tsub.join(need, tsub["_block"] == need["_nblock"]).select(F.col("_nqb").alias("_qb"), "_block", "_cell", "_tid", "_vec", "_y")

    types = {f.name: f.dataType.simpleString() for f in q.schema.fields + tsub.schema.fields}
    schema = f"_qid {types['_qid']}, _tid {types['_tid']}, _y {types['_y']}, _d double"
    keys = ["_qb", "_block"]
    return qx.groupBy(*keys).cogroup(trep.groupBy(*keys)).applyInArrow(_local_topk(k), schema)


def knn_neighbors(train: DataFrame, queries: DataFrame, *, id_col: str, vec_col: str,
                  query_id: str, k: int = 5, target_col: str | None = None,
                  seed: int = 42) -> DataFrame:
    """(query id, ``neighbor_id``, ``distance``, ``rank`` 1..k[, ``target``]) of the k nearest
    training rows for every query; ties in distance go to the smaller id."""
    pairs = candidate_topk(train, queries, id_col=id_col, vec_col=vec_col, query_id=query_id, k=k,
                           target_col=target_col, seed=seed)
    w = Window.partitionBy("_qid").orderBy("_d", "_tid")
    top = pairs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    out = top.select(F.col("_qid").alias(query_id), F.col("_tid").alias("neighbor_id"),
                     F.col("_d").alias("distance"), F.col("_rn").alias("rank"), F.col("_y").alias("target"))
    return out if target_col else out.drop("target")


def knn_predict(train: DataFrame, queries: DataFrame, *, id_col: str, vec_col: str, target_col: str,
                query_id: str, k: int = 5, weights: str = "uniform", task: str = "classification",
                seed: int = 42, shares: bool = False) -> DataFrame:
    """Predict ``target_col`` for each query from its k nearest training rows (``train`` may be a saved index).

    Returns (query id, ``prediction``) and, if asked for, ``shares``: each class's part of the votes, the classifier's
    probabilities.  Exact for any data; the cells only prune work.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError("weights must be 'uniform' or 'distance'")
    top = knn_neighbors(train, queries, id_col=id_col, vec_col=vec_col, query_id=query_id, k=k,
                        target_col=target_col, seed=seed)
    qid = qcol(query_id)
    if weights == "uniform":
        top = top.withColumn("_w", F.lit(1.0))
    else:
        has_zero = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy(qid))
        top = top.withColumn("_w", F.when(has_zero == 1, (F.col("distance") == 0).cast("double"))
                             .otherwise(1.0 / F.col("distance")))
    if task == "classification":
        votes = top.groupBy(qid.alias("_q"), F.col("target").alias("_y")).agg(F.sum("_w").alias("_s"))
        best = F.min_by("_y", F.struct((-F.col("_s")).alias("s"), F.col("_y").alias("y"))).alias("prediction")
        pred = votes.groupBy("_q").agg(best, F.map_from_entries(F.collect_list(F.struct("_y", "_s"))).alias("_votes"),   # k classes at most
                                       F.sum("_s").alias("_all"))
        share = F.transform_values("_votes", lambda _, v: v / F.col("_all"))
        pred = pred.select("_q", "prediction", *([share.alias("shares")] if shares else []))
    elif task == "regression":
        pred = top.groupBy(qid.alias("_q")).agg(
            (F.sum(F.col("_w") * F.col("target").cast("double")) / F.sum("_w")).alias("prediction"))
    else:
        raise ValueError("task must be 'classification' or 'regression'")
    return pred.withColumnRenamed("_q", query_id)
