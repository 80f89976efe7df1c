"""Category lists of any length, rule folders that live on their own, steps fitted together, quantiles by count."""

import math
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.operators import prep, stats
from kiln.sources.rules_io import load_rules, save_rules


def _jobs(spark, fn):
    """(what ``fn`` returns, the number of Spark jobs it ran)."""
    group = f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = fn()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("limit", [1000, 3])
def test_text_nan_beside_null(spark, monkeypatch, limit):
    monkeypatch.setattr(prep, "MAX_ONEHOT", limit)
    values = ["nan", None, "b", "a", "nan", None, "nan_null"]
    df = spark.createDataFrame(list(enumerate(values)), "id long, c string")
    rules = prep.fit_encode(df, "onehot", ["c"])
    out = prep.apply_rules(df, prep.rules_from_json(prep.rules_to_json(rules)))
    order = ["a", "b", "nan", "nan_null", None]
    if limit == 1000:
        names = ["c_a", "c_b", "c_nan", "c_nan_null", "c_nan_null_null"]
        assert out.columns == ["id", *names]
        got = {r.id: [i for i, n in enumerate(names) if r[n] == 1.0] for r in out.collect()}
    else:
        v = prep.vector_entries(F.col("c_onehot"))
        got = {r.id: list(r.i) for r in out.select("id", v["indices"].alias("i"), v["size"].alias("n")).collect()}
    assert got == {i: [order.index(x)] for i, x in enumerate(values)}


def test_wide_onehot_is_exact(spark, monkeypatch, tmp_path):
    """50,000 categories, a hot one, NULL, and values that the fit did not see."""
    n = 50_000
    df = spark.range(3 * n).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 1, None)
                                   .otherwise(F.concat(F.lit("v"), (F.col("id") % n).cast("string"))).alias("c"))
    rules = prep.fit_encode(df, "onehot", ["c"])
    cats = sorted({r.c for r in df.where("c is not null").distinct().select("c").distinct().collect()})
    assert rules[0].params["n_values"] == len(cats) + 1 > n
    path = save_rules(spark, rules, str(tmp_path / "rules"))
    place = {c: i for i, c in enumerate(cats)} | {None: len(cats)}
    new = df.unionByName(spark.createDataFrame([(-1, "never seen"), (-2, None)], "id long, c string"))
    out = prep.apply_rules(new, load_rules(spark, path))
    assert out.columns == ["id", "c_onehot"]
    v = prep.vector_entries(F.col("c_onehot"))
    want = {r.id: r.c for r in new.collect()}
    rows = out.select("id", v["size"].alias("n"), v["indices"].alias("i"), v["values"].alias("x")).collect()
    assert len(rows) == 3 * n + 2
    for r in rows:
        assert r.n == len(cats) + 1 and list(r.i) == ([] if r.id == -1 else [place[want[r.id]]]) and list(r.x) == [1.0] * len(r.i)


def test_wide_onehot_of_few_rows_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(prep, "MAX_ONEHOT", 2)
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 0)], "id long, c string, c_onehot int")
    rules = prep.fit_encode(df, "onehot", ["c"])
    with pytest.raises(ValueError, match="c_onehot"):
        prep.apply_rules(df, rules)
    assert prep.apply_rules(df.drop("c_onehot").limit(0), rules).count() == 0
    from pyspark.ml.linalg import SparseVector
    assert prep.apply_rules(df.drop("c_onehot"), rules).where("id = 3").first().c_onehot == SparseVector(3, [2], [1.0])


def test_rule_folder_lives_on_its_own(spark, monkeypatch, tmp_path):
    """The code tables go with the rules: the fit's own tables and the first folder may disappear."""
    monkeypatch.setattr(prep, "INLINE_LABELS", 10)
    monkeypatch.setattr(prep, "MAX_ONEHOT", 10)
    df = spark.createDataFrame([(i, f"k{i % 70}", f"m{i % 30}" if i % 9 else None, "ab"[i % 2], float(i % 13)) for i in range(500)],
                               "id long, s string, o string, t string, x double")
    rules, fitted = prep.fit_pipeline(df, [{"operation": "encoding", "method": "label", "columns": ["s", "t"]},
                                           {"operation": "encoding", "method": "onehot", "columns": ["o"]},
                                           {"operation": "normalization", "method": "minmax", "columns": ["x"]}])
    want = sorted(map(str, fitted.collect()))
    first = save_rules(spark, rules, str(tmp_path / "a"))
    for r in rules:
        if "table" in r.params:
            shutil.rmtree(r.params["table"].removeprefix("file:"))
    loaded = load_rules(spark, first)
    assert sorted(map(str, prep.apply_rules(df, loaded).collect())) == want
    again = save_rules(spark, loaded, first)                   # over the folder that the rules come from
    assert len([p for p in (tmp_path / "a").iterdir() if p.name.startswith("tables-")]) == 1
    shutil.move(again, tmp_path / "moved")
    assert sorted(map(str, prep.apply_rules(df, load_rules(spark, str(tmp_path / "moved"))).collect())) == want
    with pytest.raises(ValueError, match="exists"):
        save_rules(spark, loaded[:1], str(tmp_path / "moved"), mode="error")


def test_old_rule_files_still_load(spark, tmp_path):
    from kiln.sources.rules_io import RULES_SCHEMA
    rules = [prep.Rule("fill", "x", {"strategy": "mean", "fill_value": 2.0}), prep.Rule("label", "c", {"values": {"a": 0}})]
    spark.createDataFrame([tuple(r.to_dict(i).values()) for i, r in enumerate(rules)], RULES_SCHEMA).write.json(str(tmp_path / "old"))
    assert load_rules(spark, str(tmp_path / "old")) == rules


STEPS = [{"operation": "missing_values", "strategy": "mean", "columns": ["a"]},
         {"operation": "normalization", "method": "standard", "columns": ["b"]},
         {"operation": "normalization", "method": "minmax", "columns": ["c"]},
         {"operation": "missing_values", "strategy": "constant", "columns": ["s"]}]


def _wide(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, rnd.gauss(0, 2)]), rnd.gauss(3, 1), rnd.choice([None, rnd.random()]), rnd.choice([None, "u", "v"])) for i in range(400)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, s string")


def test_independent_steps_share_one_scan(spark):
    df = _wide(spark)
    (rules, out), jobs = _jobs(spark, lambda: prep.fit_pipeline(df, STEPS))
    _, one = _jobs(spark, lambda: df.agg(F.count("a")).collect())
    assert jobs == one
    singly, cur = [], df
    for s in STEPS:
        new, cur = prep.fit_step(cur, prep.Step.from_dict(s))
        singly += new
    assert rules == singly and sorted(map(str, out.collect())) == sorted(map(str, cur.collect()))


@pytest.mark.parametrize("steps", [
    [STEPS[0], {"operation": "normalization", "method": "standard", "columns": ["a"]}, STEPS[2]],           # a column used twice
    [STEPS[0], {"operation": "outliers", "method": "zscore", "threshold": 1.0, "columns": ["b"]}, STEPS[2]],   # rows go
    [{"operation": "encoding", "method": "label", "columns": ["s"]}, {"operation": "normalization", "method": "minmax"}],   # all numeric ones
    [{"operation": "encoding", "method": "onehot", "columns": ["s"]}, {"operation": "normalization", "method": "standard", "columns": ["s_u", "b"]}],
    [{"operation": "missing_values", "strategy": "median", "columns": ["a"]}, {"operation": "normalization", "method": "robust", "columns": ["c"]},
     {"operation": "missing_values", "strategy": "most_frequent", "columns": ["s"]}, {"operation": "normalization"}]])
def test_dependent_steps_see_what_precedes_them(spark, steps):
    df = _wide(spark)
    rules, out = prep.fit_pipeline(df, steps)
    singly, cur = [], df
    for s in steps:
        new, cur = prep.fit_step(cur, prep.Step.from_dict(s))
        singly += new
    assert rules == singly and out.columns == cur.columns and sorted(map(str, out.collect())) == sorted(map(str, cur.collect()))


def test_quantiles_by_count_on_odd_doubles(spark):
    rng = np.random.default_rng(1)
    wild = np.concatenate(([0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1e-300], rng.normal(size=500) * 10.0 ** rng.integers(-200, 200, 500),
                           np.full(300, 42.0)))
    near = 1.0 + np.arange(807) * 2.0 ** -52                           # neighbouring doubles
    rows = [(float(a), float(b), int(i % 4), None if i % 3 else float("nan")) for i, (a, b) in enumerate(zip(wild, near))]
    df = spark.createDataFrame(rows, "a double, b double, k long, none double").repartition(6)
    probs = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0]
    got = stats.quantiles(df, ["a", "b", "k", "none"], probs)
    for c, x in (("a", np.sort(wild)), ("b", near), ("k", np.sort([r[2] for r in rows]))):
        at = [p * (len(x) - 1) for p in probs]
        want = [x[math.floor(p)] + (p - math.floor(p)) * (x[math.ceil(p)] - x[math.floor(p)]) for p in at]
        assert got[c] == pytest.approx(want, rel=1e-12, abs=0)
    assert got["none"] == [None] * len(probs)
    assert stats.quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}


def test_quantiles_take_few_scans_and_shuffle_counts_only(spark, monkeypatch):
    df = spark.range(200_000).select((F.rand(3) * 1e6).alias("x"), F.exp(F.randn(4) * 9).alias("y"))
    shuffled = []
    plain = type(df).groupBy

    def spy(self, *cols):
        shuffled.append(tuple(cols))
        return plain(self, *cols)
    monkeypatch.setattr(type(df), "groupBy", spy)
    _, one = _jobs(spark, lambda: df.agg(F.count("x")).collect())
    got, jobs = _jobs(spark, lambda: stats.quantiles(df, ["x", "y"], [0.25, 0.5, 0.75]))
    assert set(shuffled) == {(), ("bracket", "sub")} and jobs <= 7 * max(1, one)
    x = np.sort([r.x for r in df.select("x").collect()])
    assert got["x"] == pytest.approx(list(np.quantile(x, [0.25, 0.5, 0.75])), rel=1e-12)


def test_wide_onehot_keeps_no_name_per_category(spark, monkeypatch):
    monkeypatch.setattr(prep, "MAX_ONEHOT", 10)
    df = spark.range(5000).select("id", F.col("id").cast("string").alias("c"))
    out = prep.apply_rules(df, prep.fit_encode(df, "onehot", ["c"]))
    assert len(out.schema.json()) < 2000
    v = prep.vector_entries(F.col("c_onehot"))
    assert out.select(v["indices"][0].alias("i")).distinct().count() == 5000
