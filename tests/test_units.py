"""Hand-made frames: nulls and NaN, constants, ties, unseen categories, odd names, sizes."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kiln.functions.columns import nan_to_null
from kiln.operators import corr, dist, evaluate as ev, ordered, prep, profile, stats
from kiln.operators.split import split_three_way


@pytest.fixture()
def tiny_nulls(spark):
    rows = [(1, 1.0, None, "x"), (2, float("nan"), None, "y"), (3, 3.0, None, None), (4, None, None, "x"),
            (5, 5.0, None, "z"), (6, 6.0, None, "x"), (7, 7.0, None, None), (8, 8.0, None, "y")]
    return spark.createDataFrame(rows, "id long, a double, b double, c string")


@pytest.fixture()
def constant(spark):
    return spark.createDataFrame([(i, 4.0) for i in range(5)], "id long, x double")


@pytest.fixture()
def ties(spark):
    xs = [1, 1, 2, 2, 2, 3, 3, 4, 5, 5, 5, 5]
    ys = [2, 1, 2, 3, 3, 1, 4, 4, 5, 2, 5, 5]
    return spark.createDataFrame(list(zip(range(12), xs, ys)), "id long, x int, y int")


def test_nan_becomes_null(tiny_nulls):
    df = nan_to_null(tiny_nulls)
    assert df.where(F.col("a").isNull()).count() == 2


def test_impute_mean_skips_nulls_and_all_null_column(tiny_nulls):
    df = nan_to_null(tiny_nulls)
    rules = prep.fit_impute(df, "mean", ["a", "b"])
    fill = {r.column: r.params["fill_value"] for r in rules}
    assert fill["a"] == pytest.approx(30.0 / 6)
    assert fill["b"] is None
    out = prep.apply_rules(df, rules)
    assert out.where(F.col("a").isNull()).count() == 0
    assert out.where(F.col("b").isNull()).count() == 8


def test_mode_tie_goes_to_smallest(ties, tiny_nulls):
    m = stats.modes(ties, ["x", "y"])
    assert m["x"] == 5.0 and m["y"] == 2.0     # y: 2 and 5 both appear 3 times
    assert stats.modes(tiny_nulls, ["c"])["c"] == "x"


def test_label_encoding_with_null_and_unseen(spark, tiny_nulls):
    rules = prep.fit_encode(tiny_nulls, "label", ["c"])
    assert rules[0].params["values"] == {"nan": 0, "x": 1, "y": 2, "z": 3}
    new = spark.createDataFrame([(1, "x"), (2, "w"), (3, None), (4, "z")], "id long, c string")
    got = {r.id: r.c for r in prep.apply_rules(new, rules).collect()}
    assert got == {1: 1, 2: None, 3: 0, 4: 3}


def test_onehot_null_last_and_unseen_all_zero(spark, tiny_nulls):
    rules = prep.fit_encode(tiny_nulls, "onehot", ["c"])
    assert rules[0].params["encoded_columns"] == ["c_x", "c_y", "c_z", "c_nan"]
    new = spark.createDataFrame([(1, "w"), (2, None)], "id long, c string")
    out = prep.apply_rules(new, rules)
    assert out.columns == ["id", "c_x", "c_y", "c_z", "c_nan"]
    rows = {r.id: tuple(r)[1:] for r in out.collect()}
    assert rows == {1: (0.0, 0.0, 0.0, 0.0), 2: (0.0, 0.0, 0.0, 1.0)}


def test_constant_column_divisors_are_one(constant):
    for method in ("standard", "minmax", "robust"):
        out = prep.apply_rules(constant, prep.fit_scale(constant, method, ["x"]))
        assert {r.x for r in out.collect()} == {0.0}
    rules, kept = prep.fit_outliers(constant, "zscore", 3.0, ["x"])
    assert kept.count() == 5
    m = corr.pearson_matrix(constant, ["x"]).collect()
    assert m[0]["corr"] is None


def test_iqr_keeps_nulls_zscore_drops_them(tiny_nulls):
    df = nan_to_null(tiny_nulls)
    assert prep.fit_outliers(df, "iqr", 3.0, ["a"])[1].count() == 8
    assert prep.fit_outliers(df, "zscore", 3.0, ["a"])[1].count() == 6


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 1.0, "ü x"), (2, None, "b.c"), (3, 3.0, None)],
                               "id long, `a.b` double, `naïve col` string")
    d = profile.describe_numeric(df, ["a.b"]).collect()[0]
    assert d["count"] == 2 and d["mean"] == 2.0
    out = prep.apply_rules(df, prep.fit_impute(df, "mean", ["a.b"]))
    assert [r["a.b"] for r in out.orderBy("id").collect()] == [1.0, 2.0, 3.0]
    oh = prep.apply_rules(df, prep.fit_encode(df, "onehot", ["naïve col"]))
    assert "naïve col_b.c" in oh.columns and "naïve col_nan" in oh.columns
    assert {r["column"] for r in profile.missing_by_column(df).collect()} == {"id", "a.b", "naïve col"}


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "id long, x double")
    d = profile.describe_numeric(empty, ["x"]).collect()[0]
    assert d["count"] == 0 and d["mean"] is None and d["q50"] is None
    single = spark.createDataFrame([(1, 2.0)], "id long, x double")
    d = profile.describe_numeric(single, ["x"]).collect()[0]
    assert d["count"] == 1 and d["std"] is None and d["q25"] == 2.0
    assert profile.table_summary(empty).collect()[0]["n_rows"] == 0


def _brute_tau_b(pairs):
    c = d = tx = ty = 0
    for (x1, y1), (x2, y2) in combinations(pairs, 2):
        s = (x1 - x2) * (y1 - y2)
        c += s > 0
        d += s < 0
        tx += x1 == x2
        ty += y1 == y2
    n0 = len(pairs) * (len(pairs) - 1) / 2
    return (c - d) / math.sqrt((n0 - tx) * (n0 - ty))


def test_kendall_ties_and_symmetry(ties):
    rows = [(r.x, r.y) for r in ties.collect()]
    got = corr.kendall_tau_b(ties, "x", "y")
    assert got == pytest.approx(_brute_tau_b(rows), abs=1e-12)
    assert corr.kendall_tau_b(ties, "y", "x") == pytest.approx(got, abs=1e-12)


def test_average_ranks_ties(ties):
    r = {row.value: row.rank for row in corr.average_ranks(ties, "x").collect()}
    assert r == {1: 1.5, 2: 4.0, 3: 6.5, 4: 8.0, 5: 10.5}


@pytest.fixture()
def small_ranges(monkeypatch):
    """Force the multi-range code paths on small data."""
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 37)
    monkeypatch.setattr(ordered, "_SELECT_ROWS_PER_RANGE", 23)


def test_running_totals_ranges_equal_single_window(spark, small_ranges):
    rnd = random.Random(3)
    rows = [(float(v), rnd.randint(1, 5)) for v in rnd.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "v double, c long")
    got = {r.v: r.c_cum for r in ordered.running_totals(df, "v", ["c"]).collect()}
    acc, want = 0, {}
    for v, c in sorted(rows):
        acc += c
        want[v] = acc
    assert got == want
    got_d = {r.v: r.c_cum for r in ordered.running_totals(df, "v", ["c"], descending=True).collect()}
    acc, want_d = 0, {}
    for v, c in sorted(rows, reverse=True):
        acc += c
        want_d[v] = acc
    assert got_d == want_d


def test_quantiles_ranged_equal_percentile(spark, small_ranges):
    rnd = random.Random(5)
    rows = [(float(rnd.randint(0, 300)),) for _ in range(2000)] + [(None,)]
    df = spark.createDataFrame(rows, "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    exact = stats.quantiles(df, ["x"], probs)["x"]
    ranged = stats.quantiles(df, ["x"], probs)["x"]
    assert ranged == pytest.approx(exact, abs=1e-9)


def test_kendall_with_x_ranges(spark, small_ranges):
    rnd = random.Random(7)
    pairs = [(rnd.randint(0, 60), rnd.randint(0, 40)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "x int, y int")
    assert corr.kendall_tau_b(df, "x", "y") == pytest.approx(_brute_tau_b(pairs), abs=1e-12)


def test_label_codes_large_path(spark, small_ranges, monkeypatch):
    monkeypatch.setattr(prep, "INLINE_LABELS", 10)
    vals = [f"v{i:03d}" for i in range(120)] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, c string")
    rules = prep.fit_encode(df, "label", ["c"])
    assert "table" in rules[0].params
    got = {r.id: r.c for r in prep.apply_rules(df, rules).collect()}
    want_order = sorted([v for v in vals if v] + ["nan"])
    want = {i: want_order.index(v if v else "nan") for i, v in enumerate(vals)}
    assert got == want


@pytest.mark.parametrize("hash_kind", ["md5", "xxhash64"])
def test_split_depends_only_on_key(spark, hash_kind):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = {r.k: r.split for r in split_three_way(df, "k", hash=hash_kind).collect()}
    b = {r.k: r.split for r in split_three_way(df.repartition(7).orderBy(F.rand(1)), "k",
                                                 hash=hash_kind).collect()}
    assert a == b
    share = sum(v == "test" for v in a.values()) / len(a)
    assert 0.17 < share < 0.23


def test_replay_on_fitting_table_equals_fit_output(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.choice([None, rnd.gauss(0, 1)]), rnd.choice(["a", "b", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, c string")
    steps = [{"operation": "missing_values", "strategy": "mean", "columns": ["x"]},
             {"operation": "outliers", "method": "zscore", "threshold": 2.0, "columns": ["x"]},
             {"operation": "normalization", "method": "robust", "columns": ["x"]},
             {"operation": "encoding", "method": "label", "columns": ["c"]}]
    rules, fitted = prep.fit_pipeline(df, steps)
    replayed = prep.apply_rules(df, prep.rules_from_json(prep.rules_to_json(rules)))
    assert sorted(map(tuple, fitted.collect())) == sorted(map(tuple, replayed.collect()))


def test_auc_perfect_ties_and_monotone_invariance(spark):
    perfect = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, s double")
    assert ev.auc(perfect, "y", "s").collect()[0][0] == pytest.approx(1.0)
    tied = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, s double")
    assert ev.auc(tied, "y", "s").collect()[0][0] == pytest.approx(0.5)
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 1), rnd.random()) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, s double")
    a1 = ev.auc(df, "y", "s").collect()[0][0]
    a2 = ev.auc(df.withColumn("s", F.exp(F.col("s") * 3)), "y", "s").collect()[0][0]
    assert a1 == pytest.approx(a2, abs=1e-12)
    # brute force: share of (pos, neg) pairs ordered right, ties half
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert a1 == pytest.approx(want, abs=1e-12)


def test_report_support_sums_and_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (1, 0), (2, 2)], "y int, p int")
    rep = {r.label: r for r in ev.classification_report(df, "y", "p").collect()}
    assert sum(rep[c].support for c in ("0", "1", "2")) == 5
    assert rep["accuracy"].f1_score == pytest.approx(3 / 5)
    only_pred = spark.createDataFrame([(0, 1), (0, 0)], "y int, p int")
    rep2 = {r.label: r for r in ev.classification_report(only_pred, "y", "p").collect()}
    assert rep2["1"].precision == 0.0 and rep2["1"].recall == 0.0 and rep2["1"].support == 0


def test_regression_metrics_constant_truth(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert ev.regression_metrics(df, "y", "p").collect()[0]["r2"] == 1.0
    df2 = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y double, p double")
    assert ev.regression_metrics(df2, "y", "p").collect()[0]["r2"] == 0.0


def test_histogram_constant_and_density(spark, constant):
    h = dist.histogram(constant, "x", 10).collect()
    assert len(h) == 1 and h[0]["count"] == 5
    df = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    h = dist.histogram(df, "x", 10).collect()
    assert sum(r["count"] for r in h) == 100
    assert sum(r["density"] * (r["hi"] - r["lo"]) for r in h) == pytest.approx(1.0)


def test_missing_patterns(tiny_nulls):
    got = {r.pattern: r.n_rows for r in profile.missing_patterns(nan_to_null(tiny_nulls)).collect()}
    assert got == {"a, b": 2, "b": 4, "b, c": 2}


def test_quantiles_ranged_many_columns(spark, small_ranges):
    rnd = random.Random(9)
    rows = [(float(rnd.randint(0, 500)), rnd.choice([None, rnd.gauss(0, 5)]), 1.0) for _ in range(1500)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    probs = [0.05, 0.25, 0.5, 0.75, 1.0]
    exact = stats.quantiles(df, ["a", "b", "c"], probs)
    ranged = stats.exact_quantiles_ranged(df, ["a", "b", "c"], probs)
    for col in "abc":
        assert ranged[col] == pytest.approx(exact[col], abs=1e-9)


def test_reference_state_converts_to_rules(spark):
    import json
    import os
    import tempfile

    from kiln.sources.rules_io import load_reference_state
    state = {"dataset_name": "d", "operations": [], "transformation_rules": {
        "encoding_maps": {"c": {"type": "label", "values": {"x": 0, "y": 1}}},
        # sklearn MinMaxScaler on data in [2, 6]: scale_ = 1/4, min_ = -2/4
        "normalizations": {"a": {"type": "minmax", "min": -0.5, "scale": 0.25}},
        "missing_value_rules": {"b": {"strategy": "mean", "fill_value": 7.0}},
        "outlier_rules": {"a": {"method": "iqr", "params": {"Q1": 0.25, "Q3": 0.75, "IQR": 0.5}}}}}
    d = tempfile.mkdtemp(prefix="kiln-state-")
    p = os.path.join(d, "state.json")
    with open(p, "w") as f:
        json.dump(state, f)
    rules = load_reference_state(spark, p)
    assert [r.kind for r in rules] == ["label", "minmax", "fill", "iqr"]
    df = spark.createDataFrame([(2.0, None, "x"), (6.0, 1.0, "y"), (4.0, 2.0, "z")], "a double, b double, c string")
    got = sorted(map(tuple, prep.apply_rules(df, rules).collect()), key=lambda t: t[0])
    assert got == [(0.0, 7.0, 0), (0.5, 2.0, None), (1.0, 1.0, 1)]


def test_approx_quantile_option_is_close(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10_001)], "x double")
    exact = stats.quantiles(df, ["x"], [0.25, 0.5])["x"]
    approx = stats.quantiles(df, ["x"], [0.25, 0.5], approx=True)["x"]
    assert exact == [2500.0, 5000.0]
    assert all(abs(a - e) <= 10_001 / 10_000 + 1 for a, e in zip(approx, exact))
    rules = prep.fit_scale(df, "robust", ["x"], approx=True)
    assert abs(rules[0].params["center"] - 5000.0) <= 2


def test_curves_with_one_class_do_not_raise(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.7)], "y int, s double")
    assert all(r.fpr is None for r in ev.roc_curve(df, "y", "s").collect() if r.threshold != float("inf"))
    assert ev.auc(df, "y", "s").collect()[0][0] is None
    neg = spark.createDataFrame([(0, 0.2), (0, 0.7)], "y int, s double")
    assert ev.pr_summary(neg, "y", "s").collect()[0]["average_precision"] is None


def test_pr_curve_without_positives_has_recall_one(spark):
    neg = spark.createDataFrame([(0, 0.2), (0, 0.7)], "y int, s double")
    rows = ev.pr_curve(neg, "y", "s").collect()
    assert [r.recall for r in rows if r.threshold is not None] == [1.0, 1.0]


def test_kendall_recovers_from_low_estimates(ties, spark):
    rnd = random.Random(17)
    pairs = [(rnd.randint(0, 30), rnd.randint(0, 200)) for _ in range(250)]
    df = spark.createDataFrame(pairs, "x int, y int")
    got = corr.kendall_tau_b(df, "x", "y", approx={"x": 1, "y": 1})
    assert got == pytest.approx(_brute_tau_b(pairs), abs=1e-12)


def test_label_fit_with_one_big_column(spark, monkeypatch):
    # a 60-value column fills the capped collect: exact counts send it to the code table and
    # the small column is collected again in full
    monkeypatch.setattr(prep, "INLINE_LABELS", 10)
    df = spark.createDataFrame([(i, f"v{i % 60:02d}", "ab"[i % 2]) for i in range(300)],
                               "id long, big string, small string")
    rules = {r.column: r for r in prep.fit_encode(df, "label", ["big", "small"])}
    assert "table" in rules["big"].params and rules["small"].params["values"] == {"a": 0, "b": 1}
    got = {r.id: (r.big, r.small) for r in prep.apply_rules(df, list(rules.values())).collect()}
    assert got == {i: (i % 60, i % 2) for i in range(300)}


def test_fused_replay_equals_rule_by_rule(spark):
    from functools import reduce
    rnd = random.Random(23)
    rows = [(i, rnd.choice([None, rnd.gauss(5, 2)]), rnd.choice([None, "u", "v", "w"]), rnd.randint(0, 9))
            for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x double, c string, k int")
    steps = [{"operation": "missing_values", "strategy": "median", "columns": ["x"]},
             {"operation": "normalization", "method": "minmax", "columns": ["x", "k"]},
             {"operation": "outliers", "method": "iqr", "columns": ["x"]},
             {"operation": "normalization", "method": "standard", "columns": ["x"]},
             {"operation": "encoding", "method": "onehot", "columns": ["c"]},
             {"operation": "outliers", "method": "zscore", "threshold": 1.5, "columns": ["k"]}]
    rules, fitted = prep.fit_pipeline(df, steps)
    fused = prep.apply_rules(df, rules)
    one_by_one = reduce(prep.apply_rule, rules, df)
    assert fused.columns == one_by_one.columns == fitted.columns
    key = lambda t: t[0]
    assert sorted(map(tuple, fused.collect()), key=key) == sorted(map(tuple, one_by_one.collect()), key=key)
    assert sorted(map(tuple, fused.collect()), key=key) == sorted(map(tuple, fitted.collect()), key=key)


def test_reference_style_entry_points(tiny_nulls):
    df = nan_to_null(tiny_nulls)
    out, rules = prep.handle_missing_values(df, "median", ["a"])
    assert rules[0].params["fill_value"] == 5.5 and out.where(F.col("a").isNull()).count() == 0
    out, rules = prep.normalize_data(out, "minmax", ["a"])
    assert {r.a for r in out.collect()} <= {i / 7 for i in range(8)} | {4.5 / 7}
    out, rules = prep.encode_categorical(out, "onehot", ["c"])
    assert "c_nan" in out.columns
    out, rules = prep.remove_outliers(out, "iqr", columns=["a"])
    # scaled a: 0, 2/7, 4/7, 4.5/7 (x2), 5/7, 6/7, 1 -> Q1 0.5, Q3 0.75, lower fence 0.125: 0 goes
    assert out.count() == 7 and rules[0].kind == "iqr" and 0.0 not in {r.a for r in out.collect()}


def test_nan_counts_as_missing_everywhere(spark):
    rows = [(1, 1.0), (2, float("nan")), (3, 3.0), (4, None), (5, 5.0)]
    df = spark.createDataFrame(rows, "id long, x double")
    d = profile.describe_numeric(df, ["x"]).collect()[0]
    assert d["count"] == 3 and d["mean"] == 3.0 and d["q50"] == 3.0 and d["max"] == 5.0
    out = prep.apply_rules(df, prep.fit_impute(df, "median", ["x"]))
    assert sorted(r.x for r in out.collect()) == [1.0, 3.0, 3.0, 3.0, 5.0]
    assert stats.quantiles(df, ["x"], [0.5])["x"] == [3.0]
    assert dist.outlier_flag_iqr(df, "x").count() == 3


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_correlation_matrix_symmetric_with_unit_diagonal(spark, method):
    rnd = random.Random(31)
    rows = [(rnd.gauss(0, 1), rnd.choice([None, rnd.randint(0, 5)]), rnd.random()) for _ in range(120)]
    df = spark.createDataFrame(rows, "a double, b int, c double")
    m = {(r.column_a, r.column_b): r.corr for r in corr.correlation_matrix(df, ["a", "b", "c"], method).collect()}
    assert len(m) == 9
    for x in "abc":
        assert m[(x, x)] == 1.0
        for y in "abc":
            assert m[(x, y)] == pytest.approx(m[(y, x)], abs=1e-12)
            assert -1.0 - 1e-12 <= m[(x, y)] <= 1.0 + 1e-12


def test_profile_table_equals_individual_profiles(spark, tiny_nulls):
    df = nan_to_null(tiny_nulls).withColumn("d", F.col("id") * 2)
    prof = profile.profile_table(df)
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(prof["summary"]) == rows(profile.table_summary(df))
    assert rows(prof["describe"]) == rows(profile.describe_numeric(df))
    assert rows(prof["missing"]) == rows(profile.missing_by_column(df))
    assert rows(prof["missing_patterns"]) == rows(profile.missing_patterns(df))
    assert rows(prof["bytes"]) == rows(profile.column_bytes(df))
    assert rows(prof["value_counts"]) == rows(profile.value_counts_all(df))
    assert prof["summary"].schema.simpleString() == profile.table_summary(df).schema.simpleString()
    clean = df.select("id", "d")
    assert rows(profile.profile_table(clean)["missing_patterns"]) == [("No missing values", 8)]


def test_density_curve_against_its_formula(spark):
    """Nulls and NaN are left out; a constant column has no curve; the violin holds curve and box."""
    from statistics import stdev
    values = [0.0, 1.0, 1.0, 2.5, 7.0]
    df = spark.createDataFrame([(v, 3.0) for v in [*values, None, math.nan]], "v double, same double")
    n, h = len(values), stdev(values) * len(values) ** -0.2
    rows = dist.kde_curve(df, "v", 8).collect()
    assert [r["x"] for r in rows] == pytest.approx([i for i in range(8)])
    for r in rows:
        want = sum(math.exp(-0.5 * ((r["x"] - v) / h) ** 2) for v in values) / (n * h * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(want)
    assert dist.kde_curve(df, "same", 8).count() == 0
    parts = [r["part"] for r in dist.violin_table(df, "v", 8).collect()]
    assert (parts.count("curve"), parts.count("box")) == (8, 5)
