"""F1, F2: forests whose trees may not fit the driver together are fitted and scored in parts."""

import random

import numpy as np
import pytest
from pyspark.ml.base import Estimator
from pyspark.sql import functions as F

from kiln.operators import models as ml
from kiln.operators.history import training_history

FEATURES = ["a", "b.c", "c", "d"]
CASES = [("binary", "two"), ("multiclass", "three"), ("regression", "y")]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    out = []
    for i in range(300):
        x = [rnd.gauss(0, 1) for _ in range(4)]
        s = x[0] + 0.5 * x[1] * x[1] + rnd.gauss(0, 0.3)
        out.append((i, *x, int(s > 0.5), 3 + 2 * (int(s > 0) + int(s > 1)), s, ["train", "validation"][i % 3 // 2]))
    out += out[:20]                                     # rows that come twice
    return spark.createDataFrame(out, "id long, a double, `b.c` double, c double, d double, two int, three int, y double, split string").repartition(3).cache()


@pytest.fixture(scope="module")
def small_parts():
    """Trees of depth 3 have 16 nodes at most: parts of two trees, two parts at a time."""
    with pytest.MonkeyPatch.context() as patch:
        for name, nodes in (("_WHOLE_NODES", 33), ("_PART_NODES", 33), ("_NODES_AT_ONCE", 64)):
            patch.setattr(ml, name, nodes, raising=False)
        yield


@pytest.fixture(scope="module", params=CASES, ids=lambda c: c[0])
def forest(request, rows, small_parts):
    """(problem, model, numbers of trees that a fit returned)"""
    trees, fit = [], Estimator.fit

    def counted(self, *args):
        out = fit(self, *args)
        trees.extend(len(m.trees) for m in getattr(out, "stages", [out]) if hasattr(m, "trees"))
        return out
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Estimator, "fit", counted)
        return request.param[0], _fitted(rows, *request.param), trees


def _fitted(rows, problem, target, **params):
    return ml.train_model(rows.where("split = 'train'"), FEATURES, target, "random_forest", problem, **{"max_depth": 3, "n_estimators": 5} | params)


def test_no_fit_holds_the_whole_forest(forest):
    _, model, trees = forest
    assert sorted(trees) == [1, 2, 2]
    assert not any(hasattr(s, "trees") for s in model.pipeline.stages)


def test_votes_are_those_of_all_trees(rows, forest):
    problem, model, _ = forest
    parts = [ml.load_part(p, problem) for p in model.parts]
    assert [len(p.trees) for p in parts] == [2, 2, 1]
    assert {p.getFeatureSubsetStrategy() for p in parts} == {"all" if problem == "regression" else "sqrt"}
    assert len({t.toDebugString for p in parts for t in p.trees}) == 5
    got = model.transform(rows).collect()
    assert len(got) == rows.count()
    points = model.pipeline.transform(ml._with_inputs(rows.dropDuplicates(["id"]), FEATURES)).select("id", "features").collect()
    for r in points:
        own = [g for g in got if g.id == r.id]
        if problem == "regression":
            want = np.mean([t.predict(r.features) for p in parts for t in p.trees])
            assert all(g.prediction == pytest.approx(want) for g in own)
            continue
        votes = np.sum([t.predictRaw(r.features).toArray() / t.predictRaw(r.features).toArray().sum() for p in parts for t in p.trees], axis=0)
        classes = [0, 1] if problem == "binary" else [3, 5, 7]
        for g in own:
            assert g.rawPrediction.toArray() == pytest.approx(votes) and g.probability.toArray() == pytest.approx(votes / 5)
            assert g.prediction == classes[int(np.argmax(g.rawPrediction.toArray()))]
            assert problem != "binary" or g.p1 == pytest.approx(votes[1] / 5)
    added = {"features", "prediction"} | (set() if problem == "regression" else {"rawPrediction", "probability"}) | ({"p1"} if problem == "binary" else set())
    assert set(got[0].__fields__) - set(rows.columns) == added


def test_parts_have_history_importances_and_files(spark, rows, forest, tmp_path):
    problem, model, _ = forest
    each = [t.featureImportances.toArray() for p in model.parts for t in ml.load_part(p, problem).trees]
    got = {r.feature: r.importance for r in ml.feature_importance(model).collect()}
    assert [got[f] for f in FEATURES] == pytest.approx((np.sum(each, axis=0) / np.sum(each)).tolist())
    history = training_history(model, rows).collect()
    metrics = 1 if problem == "regression" else 2
    assert len(history) == 2 * 5 * metrics and sorted({r["round"] for r in history}) == [1, 2, 3, 4, 5]
    last = {r.split: r.value for r in history if r["round"] == 5 and r.metric == "loss"}
    assert last == pytest.approx({r.split: r.loss for r in ml.train_val_scores(model, rows).collect()})
    again = ml.load_model(spark, ml.save_model(model, str(tmp_path / "m")))
    assert len(again.parts) == 3 and not set(again.parts) & set(model.parts)
    assert sorted((r.id, r.prediction) for r in again.transform(rows).collect()) == sorted((r.id, r.prediction) for r in model.transform(rows).collect())


def test_odd_rows_of_parts(rows, forest):
    problem, model, _ = forest
    assert model.transform(rows.limit(0)).count() == 0
    if problem != "multiclass":
        return
    unknown = model.transform(rows.withColumn("three", F.lit(None).cast("int")))
    assert unknown.count() == rows.count() and unknown.where("prediction is null").count() == 0
    with pytest.raises(ValueError, match="prediction"):
        model.transform(unknown.drop("features", "rawPrediction", "probability"))
    with pytest.raises(Exception, match="(?i)null"):
        model.transform(rows.withColumn("a", F.lit(None).cast("double"))).count()


def test_forests_of_few_nodes_stay_whole():
    """Two features of 32 bins have 1,024 cells, however many rows there are."""
    few, many = (2 * 32 ** k for k in (2, 3))
    est = ml.RandomForestRegressor(maxBins=32, maxDepth=30, numTrees=100)
    assert ml._most_nodes(est, 10 ** 9, 2) == few and ml._most_nodes(est, 10 ** 9, 3) == many
    assert ml._most_nodes(est, 7, 64) == 14 and ml._most_nodes(est.setMaxDepth(3), 10 ** 9, 64) == 16
    assert 100 * few <= 300_000 < 100 * many             # feature_importance and model_random_forest_reg are fitted whole


def test_a_single_tree_is_not_parted(rows, small_parts):
    model = _fitted(rows, "multiclass", "three", n_estimators=1, max_depth=8)
    assert not model.parts and len(model.pipeline.stages[-1].trees) == 1
