"""Scores by round, probabilities of every classifier, saved neighbours."""

import random

import pytest
from pyspark.sql import functions as F

from kiln.operators import evaluate, knn, models
from kiln.operators.history import training_history


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    out = []
    for i in range(360):
        x = [rnd.gauss(0, 1) for _ in range(3)]
        s = x[0] + 0.5 * x[1] * x[1] + rnd.gauss(0, 0.3)
        out.append((i, *x, int(s > 0.5), 3 + 2 * (int(s > 0) + int(s > 1)), s, ["train", "validation", "test"][i % 4 % 3]))
    return spark.createDataFrame(out, "id long, a double, b double, c double, two int, three int, y double, split string").repartition(3).cache()


FEATURES = ["a", "b", "c"]
CASES = [("random_forest", "binary", "two"), ("random_forest", "multiclass", "three"), ("random_forest", "regression", "y"),
         ("gradient_boosting", "binary", "two"), ("gradient_boosting", "multiclass", "three"), ("gradient_boosting", "regression", "y"),
         ("decision_tree", "multiclass", "three"), ("decision_tree", "regression", "y")]


@pytest.mark.parametrize("kind,problem,target", CASES)
def test_last_round_is_the_model(spark, rows, kind, problem, target):
    params = {} if kind == "decision_tree" else {"n_estimators": 4}
    train = rows.where("split = 'train'")
    model = models.train_model(train, FEATURES, target, kind, problem, max_depth=3, **params)
    history = training_history(model, rows).collect()
    rounds = 1 if kind == "decision_tree" else 4
    metrics = {"loss"} if problem == "regression" else {"loss", "accuracy"}
    assert len(history) == 3 * rounds * len(metrics) and {r.metric for r in history} == metrics
    last = {(r.split, r.metric): r.value for r in history if r["round"] == rounds}
    for r in models.train_val_scores(model, rows).collect():
        assert last[r.split, "loss"] == pytest.approx(r.loss, rel=1e-9)
        if problem != "regression":
            assert last[r.split, "accuracy"] == pytest.approx(r.accuracy, rel=1e-9)
    if kind == "random_forest" and problem == "binary":         # the first round is the first tree alone
        one = model.pipeline.stages[-1].trees[0]
        scored = one.transform(model.pipeline.stages[0].transform(models._with_inputs(rows, FEATURES)))
        want = {r.split: r.acc for r in scored.groupBy("split").agg(F.avg((F.col("prediction") == F.col("two")).cast("double")).alias("acc")).collect()}
        assert {r.split: r.value for r in history if r["round"] == 1 and r.metric == "accuracy"} == pytest.approx(want)


def test_history_needs_rounds(spark, rows):
    model = models.train_model(rows, FEATURES, "y", "ridge", "regression")
    with pytest.raises(ValueError, match="rounds"):
        training_history(model, rows)


@pytest.mark.parametrize("kind", ["knn", "svm"])
def test_binary_curves_of_models_without_own_probabilities(spark, rows, kind):
    params = {"n_neighbors": 7} if kind == "knn" else {"calibration": rows.where("split = 'validation'")}
    model = models.train_model(rows.where("split = 'train'"), FEATURES, "two", kind, "binary", **params)
    test = rows.where("split = 'test'")
    out = evaluate.evaluate_model(model, test)
    assert {"roc", "auc", "pr_curve", "pr_summary"} <= set(out)
    assert out["auc"].collect()[0][0] > 0.8
    scored = model.transform(test).collect()
    assert all(0 <= r.p1 <= 1 and r.probability[0] + r.probability[1] == pytest.approx(1) for r in scored)
    if kind == "knn":
        assert all((r.p1 > 0.5) == (r.prediction == 1) and r.p1 * 7 == pytest.approx(round(r.p1 * 7)) for r in scored)
    else:
        by = sorted((r.p1, r.two) for r in scored)                       # calibrated: predicted and true shares agree by halves
        half = len(by) // 2
        for part in (by[:half], by[half:]):
            assert abs(sum(p for p, _ in part) - sum(y for _, y in part)) / len(part) < 0.2


@pytest.mark.parametrize("kind,params", [("knn", {}), ("svm", {}), ("gradient_boosting", {"n_estimators": 3}), ("random_forest", {"n_estimators": 5})])
def test_multiclass_probabilities(spark, rows, tmp_path, kind, params):
    model = models.train_model(rows.where("split = 'train'"), FEATURES, "three", kind, "multiclass", **params)
    test = rows.where("split = 'test'")
    out = {r.id: r for r in model.transform(test).collect()}
    assert all(len(r.probability) == 3 and sum(r.probability) == pytest.approx(1) for r in out.values())
    assert sum(r.prediction == r.three for r in out.values()) > 0.5 * len(out)
    again = models.load_model(spark, models.save_model(model, str(tmp_path / kind)))
    for r in again.transform(test).collect():
        assert r.prediction == out[r.id].prediction and list(r.probability) == pytest.approx(list(out[r.id].probability))


def test_saved_neighbours_read_wanted_cells_only(spark, tmp_path):
    rnd = random.Random(2)
    centres = [(100.0 * k, -50.0 * k) for k in range(12)]
    train = [(i, [c + rnd.gauss(0, 1) for c in centres[i % 12]], i % 3) for i in range(1200)]
    frame = spark.createDataFrame(train, "id long, v array<double>, y int")
    path = knn.save_index(frame, str(tmp_path / "i"), id_col="id", vec_col="v", target_col="y")
    index = knn.load_index(spark, path)
    queries = spark.createDataFrame([(j, [c + rnd.gauss(0, 1) for c in centres[3]]) for j in range(20)], "q long, v array<double>")
    args = dict(id_col="id", vec_col="v", query_id="q", k=4, target_col="y")
    got = knn.knn_neighbors(index, queries, **args)
    want = knn.knn_neighbors(frame, queries, **args)
    key = lambda r: (r.q, r["rank"])
    assert [tuple(r) for r in sorted(got.collect(), key=key)] == [tuple(r) for r in sorted(want.collect(), key=key)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_cell" in plan.split("PartitionFilters: [")[1][:200]
    assert knn.save_index(index, path, id_col="id", vec_col="v") == path


def test_unlimited_depth_goes_as_deep_as_spark(spark):
    df = spark.createDataFrame([(i, float(i), (i * 7919) % 64) for i in range(64)], "id long, x double, y int")
    model = models.train_model(df, ["x"], "y", "decision_tree", "multiclass", max_bins=64)
    assert model.pipeline.stages[-1].depth > 10 or model.transform(df).where("prediction <> y").count() == 0
    assert models.DEFAULT_MAX_DEPTH == 30
