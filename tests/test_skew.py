"""A single value holding a third of all rows: results stay exact on every skew-prone path."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kiln.operators import corr, evaluate as ev, knn, ordered, prep, profile, stats

from test_units import _brute_tau_b


@pytest.fixture(scope="module")
def hot(spark):
    rnd = random.Random(13)
    rows = []
    for i in range(3000):
        if i % 3 == 0:
            rows.append((i, 42.0, "hot", 1, 0.5))
        else:
            rows.append((i, float(rnd.randint(0, 2000)), f"c{rnd.randint(0, 300)}", rnd.randint(0, 1),
                         rnd.random()))
    return rows, spark.createDataFrame(rows, "id long, x double, s string, y int, score double")


@pytest.fixture()
def tiny_ranges(monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 50)
    monkeypatch.setattr(ordered, "_SELECT_ROWS_PER_RANGE", 40)


def test_value_counts_and_mode(hot):
    rows, df = hot
    got = {r.value: r["count"] for r in profile.value_counts_all(df, ["s"]).collect()}
    assert got == dict(Counter(r[2] for r in rows))
    assert stats.modes(df, ["s", "x"]) == {"s": "hot", "x": 42.0}


def test_ranged_quantiles(hot, tiny_ranges):
    rows, df = hot
    xs = sorted(r[1] for r in rows)
    probs = [0.1, 1 / 3, 0.5, 0.9]
    got = stats.exact_quantiles_ranged(df, ["x"], probs)["x"]
    want = []
    for p in probs:
        pos = p * (len(xs) - 1)
        lo, hi = math.floor(pos), math.ceil(pos)
        want.append(xs[lo] + (pos - lo) * (xs[hi] - xs[lo]))
    assert got == pytest.approx(want)


def test_rank_correlations(hot, tiny_ranges):
    rows, df = hot
    pairs = [(r[1], r[4]) for r in rows]
    assert corr.kendall_tau_b(df, "x", "score") == pytest.approx(_brute_tau_b(pairs), abs=1e-12)
    ranks = {r.value: r.rank for r in corr.average_ranks(df, "x").collect()}
    xs = [r[1] for r in rows]
    ties = sum(v == 42.0 for v in xs)
    assert ranks[42.0] == pytest.approx(sum(v < 42.0 for v in xs) + (ties + 1) / 2)


def test_roc_auc_with_hot_score(hot, tiny_ranges):
    rows, df = hot
    pos = [r[4] for r in rows if r[3] == 1]
    neg = [r[4] for r in rows if r[3] == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert ev.auc(df, "y", "score").collect()[0][0] == pytest.approx(want, abs=1e-12)


def test_label_table_join(hot, tiny_ranges, monkeypatch):
    rows, df = hot
    monkeypatch.setattr(prep, "INLINE_LABELS", 5)
    rules = prep.fit_encode(df, "label", ["s"])
    order = sorted({r[2] for r in rows})
    got = {r.id: r.s for r in prep.apply_rules(df, rules).collect()}
    assert got == {r[0]: order.index(r[2]) for r in rows}


def test_knn_hot_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(knn, "T_BLOCK", 64)
    monkeypatch.setattr(knn, "Q_BLOCK", 16)
    rnd = random.Random(21)
    train = [(i, [0.0, 0.0] if i % 3 == 0 else [rnd.uniform(-5, 5), rnd.uniform(-5, 5)], i % 2)
             for i in range(900)]
    queries = [(10_000 + j, [rnd.uniform(-1, 1), rnd.uniform(-1, 1)]) for j in range(40)]
    tdf = spark.createDataFrame(train, "id long, v array<double>, y int")
    qdf = spark.createDataFrame(queries, "qid long, v array<double>")
    got = {}
    for r in knn.knn_neighbors(tdf, qdf, id_col="id", vec_col="v", query_id="qid", k=5).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.neighbor_id))
    for qid, qv in queries:
        want = [t for _, t in sorted((math.dist(qv, v), t) for t, v, _ in train)[:5]]
        assert [t for _, t in sorted(got[qid])] == want


def test_stream_replay_with_label_table(spark, monkeypatch, tmp_path):
    from kiln.streaming.replay import stream_apply_rules
    monkeypatch.setattr(prep, "INLINE_LABELS", 5)
    df = spark.createDataFrame([(i, f"k{i % 40:02d}", float(i)) for i in range(400)], "id long, s string, x double")
    rules, _ = prep.fit_pipeline(df, [{"operation": "encoding", "method": "label", "columns": ["s"]},
                                      {"operation": "normalization", "method": "standard", "columns": ["x"]}])
    assert "table" in rules[0].params
    src = str(tmp_path / "src")
    df.repartition(4).write.parquet(src)
    got = {r.id: (r.s, round(r.x, 9)) for r in stream_apply_rules(spark, src, df.schema, rules).collect()}
    want = {r.id: (r.s, round(r.x, 9)) for r in prep.apply_rules(df, rules).collect()}
    assert got == want and got[3] == (3, got[3][1])


def test_knn_queries_are_sent_once_a_block():
    """Without structure no cell is left out: a query goes to each block once, in bounded batches, whatever the number of cells."""
    import numpy as np
    import pyarrow as pa
    r = np.random.default_rng(3)
    centers, counts = r.normal(0, 0.01, (200, 8)), [50] * 200
    first, subs, n = knn._blocks(centers.tolist(), counts)
    assert n == 1 and set(first) == {0} and set(subs) == {1}
    q = r.normal(0, 0.01, (5000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(5000), pa.int32()), pa.array(range(5000)), pa.array(list(q))], names=["_qb", "_qid", "_qvec"])
    got = list(knn._query_blocks(centers, [9.0] * 200, counts, first, subs, 5)(iter([batch])))
    assert sum(b.num_rows for b in got) == 5000 and max(b.num_rows for b in got) <= knn._QUERIES
    split = knn._blocks([[0.0], [9.0], [1.0]], [knn.T_BLOCK * 2 + 1, 10, 0])
    assert split == ([0, 3, 0], [3, 1, 1], 4) or split == ([1, 0, 0], [3, 1, 1], 4)


def test_knn_kernel_with_many_ties(monkeypatch):
    import numpy as np
    import pyarrow as pa
    monkeypatch.setattr(knn, "_RANKED", 10)
    monkeypatch.setattr(knn, "_CHUNK", 4000)
    r = np.random.default_rng(4)
    T, Q = r.integers(0, 3, (900, 2)).astype(float), r.integers(0, 3, (70, 2)).astype(float)
    cell = r.integers(0, 16, 900)
    t = pa.table({"_cell": pa.array(cell, pa.int32()), "_tid": r.permutation(900), "_vec": list(T), "_y": cell})
    masks = r.integers(1, 256, (70, 2)).astype(np.uint8)
    q = pa.table({"_qid": np.arange(70), "_qvec": list(Q), "_near": pa.array(r.integers(0, 16, 70), pa.int32()), "_cells": [bytes(m) for m in masks]})
    got = knn._local_topk(7)(q, t).to_pandas().groupby("_qid")[["_d", "_tid"]].apply(lambda g: sorted(zip(g["_d"], g["_tid"]))[:7])
    for i in range(70):                                    # cells that a chunk's other queries want may come along
        own = np.unpackbits(masks[i])[cell] > 0
        d = np.sqrt(((T - Q[i]) ** 2).sum(1))
        assert got[i][:1] <= sorted(zip(d[own], t["_tid"].to_numpy()[own]))[:1] and len(got[i]) == 7
        assert all(d[t["_tid"].to_numpy() == b][0] == a for a, b in got[i])


def test_knn_leaves_out_rows_without_a_vector(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else [float(i % 17), float(i % 7)], i % 3) for i in range(300)]
    spark.createDataFrame(rows, "id long, v array<double>, y int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = {}
    for r in knn.knn_neighbors(df, df.where("id < 40"), id_col="id", vec_col="v", query_id="id", k=3, target_col="y").collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbor_id))
    full = [(i, v) for i, v, _ in rows if v]
    assert {i: [t for _, t in sorted(x)] for i, x in got.items()} == {
        i: [t for _, t in sorted((math.dist(v, w), t) for t, w in full)[:3]] for i, v in full if i < 40}
