"""k-NN exactness, CSV typing, file listing and model fits."""

import math
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from kiln.operators import knn, models as ml
from kiln.sources.csv import read_csv_typed
from kiln.sources.files import list_files


def _brute(train, queries, k):
    out = {}
    for qid, qv in queries:
        ds = sorted((math.dist(qv, v), tid, y) for tid, v, y in train)[:k]
        out[qid] = ds
    return out


@pytest.mark.parametrize("dim,n", [(2, 400), (8, 300)])
def test_knn_equals_brute_force(spark, monkeypatch, dim, n):
    monkeypatch.setattr(knn, "MAX_CELLS", 9)
    rnd = random.Random(dim)
    # clustered points with duplicates so distance ties happen
    centers = [[rnd.uniform(-10, 10) for _ in range(dim)] for _ in range(5)]
    train = []
    for i in range(n):
        c = centers[i % 5]
        v = [round(x + rnd.gauss(0, 1), 1) for x in c]
        train.append((i, v, i % 3))
    train.append((n, list(train[0][1]), 2))
    queries = [(1000 + j, [round(x, 1) for x in train[j * 7][1]]) for j in range(30)] + \
              [(2000, [50.0] * dim)]
    tdf = spark.createDataFrame(train, "id long, v array<double>, y int")
    qdf = spark.createDataFrame(queries, "qid long, v array<double>")
    got = knn.knn_neighbors(tdf, qdf, id_col="id", vec_col="v", query_id="qid", k=4, target_col="y")
    got_map = {}
    for r in got.collect():
        got_map.setdefault(r.qid, []).append((r["rank"], r.neighbor_id, r.distance))
    want = _brute(train, queries, 4)
    for qid, ds in want.items():
        g = sorted(got_map[qid])
        assert [t for _, t, _ in g] == [t for _, t, _ in ds], qid
        assert [d for _, _, d in g] == pytest.approx([d for d, _, _ in ds])


def test_knn_distance_weights_exact_match(spark):
    tdf = spark.createDataFrame([(1, [0.0, 0.0], 1.0), (2, [1.0, 0.0], 5.0), (3, [0.0, 2.0], 9.0)],
                                "id long, v array<double>, y double")
    qdf = spark.createDataFrame([(10, [0.0, 0.0]), (11, [0.5, 0.0])], "qid long, v array<double>")
    p = {r.qid: r.prediction for r in knn.knn_predict(
        tdf, qdf, id_col="id", vec_col="v", target_col="y", query_id="qid", k=3,
        weights="distance", task="regression").collect()}
    assert p[10] == 1.0
    w = [1 / 0.5, 1 / 0.5, 1 / math.hypot(0.5, 2)]
    assert p[11] == pytest.approx((w[0] * 1 + w[1] * 5 + w[2] * 9) / sum(w))


def test_csv_tokens_and_types(spark):
    d = tempfile.mkdtemp(prefix="kiln-csv-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("i,x,b,s,allna\n1,1.5,True,NA,\n2,nan,False,hello,NA\n3, 7 ,TRUE,n/a,null\nNA,2,,x,\n")
    df = read_csv_typed(spark, d)
    assert dict(df.dtypes) == {"i": "bigint", "x": "double", "b": "boolean", "s": "string", "allna": "double"}
    rows = sorted(df.collect(), key=lambda r: (r.i is None, r.i))
    assert [r.x for r in rows] == [1.5, None, 7.0, 2.0]
    assert [r.s for r in rows] == [None, "hello", None, "x"]


def test_listing_skips_hidden_and_other_extensions(spark):
    d = tempfile.mkdtemp(prefix="kiln-ls-")
    for rel in ["a.csv", "sub/b.CSV", "sub/c.png", "sub/d.txt", ".hidden/e.csv", "sub/.f.csv", "x/y/g.jpeg"]:
        p = os.path.join(d, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        open(p, "w").write("h\n1\n")
    os.makedirs(os.path.join(d, "empty"), exist_ok=True)
    got = {r.relative_path: r.format for r in list_files(spark, d).collect()}
    assert got == {"a.csv": "data", "sub/b.CSV": "data", "sub/c.png": "image", "x/y/g.jpeg": "image"}


@pytest.fixture(scope="module")
def blobs(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(600):
        c = i % 3
        rows.append((i, rnd.gauss(c * 3, 1), rnd.gauss(-c * 2, 1), c, 2.0 * c + 0.5))
    return spark.createDataFrame(rows, "id long, f1 double, f2 double, y int, t double")


@pytest.mark.parametrize("mt,problem,params", [
    ("random_forest", "multiclass", {"n_estimators": 10}),
    ("decision_tree", "multiclass", {}),
    ("logistic_regression", "multiclass", {}),
    ("gradient_boosting", "binary", {"n_estimators": 10}),
    ("svm", "binary", {}),
    ("neural_network", "multiclass", {"hidden_dims": [8], "max_iter": 100}),
    ("knn", "multiclass", {"n_neighbors": 5}),
])
def test_classifiers_learn(blobs, mt, problem, params):
    df = blobs if problem == "multiclass" else blobs.withColumn("y", (F.col("y") > 0).cast("int"))
    m = ml.train_model(df, ["f1", "f2"], "y", mt, problem, **params)
    acc = m.transform(df).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).collect()[0][0]
    assert acc > 0.85, (mt, acc)


def test_linear_models_recover_coefficients(spark):
    rnd = random.Random(4)
    rows = [(float(x), 3.0 * x + 2.0 + rnd.gauss(0, 0.01)) for x in range(200)]
    df = spark.createDataFrame(rows, "x double, y double")
    m = ml.train_model(df, ["x"], "y", "linear_regression", "regression")
    lr = m.pipeline.stages[-1]
    assert lr.coefficients[0] == pytest.approx(3.0, abs=1e-3) and lr.intercept == pytest.approx(2.0, abs=0.05)
    imp = ml.feature_importance(m).collect()
    assert imp[0]["feature"] == "x"


def test_non_numeric_features_rejected(spark):
    df = spark.createDataFrame([(1, "a", 0)], "id long, s string, y int")
    with pytest.raises(ValueError, match="s"):
        ml.train_model(df, ["s"], "y", "decision_tree", "binary")


def test_unsupported_kernel_raises(spark, blobs):
    with pytest.raises(ValueError, match="kernel"):
        ml.train_model(blobs, ["f1", "f2"], "y", "svm", "binary", kernel="rbf")


def test_evaluate_model_binary_and_profile(spark, blobs):
    from kiln.operators import evaluate as ev, profile
    df = blobs.withColumn("y", (F.col("y") > 0).cast("int"))
    m = ml.train_model(df, ["f1", "f2"], "y", "logistic_regression", "binary")
    res = ev.evaluate_model(m, df)
    assert set(res) == {"confusion_matrix", "classification_report", "roc", "auc", "pr_curve", "pr_summary"}
    assert res["auc"].collect()[0][0] > 0.95
    rep = ml.train_model(blobs, ["f1"], "t", "linear_regression", "regression")
    assert ev.evaluate_model(rep, blobs)["metrics"].collect()[0]["r2"] > 0.5
    prof = profile.profile_table(blobs.select("f1", "f2", "y"))
    assert prof["correlation"].count() == 9 and prof["summary"].collect()[0]["n_rows"] == 600


def test_prepare_data_and_stream_scoring(spark, blobs):
    import tempfile

    from kiln.operators import prep
    from kiln.streaming.replay import stream_apply_rules
    out, feats, k = ml.prepare_data(blobs.drop("t"), "y", "multiclass", key="id")
    assert feats == ["f1", "f2"] and k == 3
    shares = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert abs(shares["test"] / 600 - 0.2) < 0.06 and abs(shares["validation"] / 600 - 0.16) < 0.06
    rules, _ = prep.fit_pipeline(blobs, [{"operation": "normalization", "method": "standard",
                                          "columns": ["f1", "f2"]}])
    m = ml.train_model(prep.apply_rules(blobs, rules), ["f1", "f2"], "t", "linear_regression", "regression")
    src = tempfile.mkdtemp(prefix="kiln-stream-src-")
    blobs.repartition(3).write.mode("overwrite").parquet(src + "/in")
    scored = stream_apply_rules(spark, src + "/in", blobs.schema, rules, model=m)
    batch = m.transform(prep.apply_rules(blobs, rules))
    got = {r.id: round(r.prediction, 9) for r in scored.collect()}
    want = {r.id: round(r.prediction, 9) for r in batch.collect()}
    assert got == want


def test_load_files_per_file_tables(spark):
    from kiln.sources.files import load_files
    d = tempfile.mkdtemp(prefix="kiln-multi-")
    os.makedirs(os.path.join(d, "sub"))
    open(os.path.join(d, "a.csv"), "w").write("x,y\n1,2.5\n2,NA\n")
    open(os.path.join(d, "sub", "b.csv"), "w").write("name,flag\nq,True\nr,False\n")
    got = load_files(spark, d)
    assert set(got) == {"a.csv", "sub/b.csv"}
    assert dict(got["a.csv"].dtypes) == {"x": "bigint", "y": "double"}
    assert dict(got["sub/b.csv"].dtypes) == {"name": "string", "flag": "boolean"}


def test_missing_features_are_reported(spark):
    df = spark.createDataFrame([(1.0, 0), (None, 1), (2.0, 0)], "f double, y int")
    with pytest.raises(ValueError, match="missing values"):
        ml.train_model(df, ["f"], "y", "decision_tree", "binary")


def test_classes_need_not_start_at_zero(spark, blobs):
    df = blobs.withColumn("y", F.col("y") * 5 + 1)          # classes 1, 6, 11
    m = ml.train_model(df, ["f1", "f2"], "y", "logistic_regression", "multiclass")
    pred = m.transform(df)
    assert {r.prediction for r in pred.select("prediction").distinct().collect()} <= {1.0, 6.0, 11.0}
    acc = pred.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).collect()[0][0]
    assert acc > 0.85
    b = blobs.withColumn("y", F.when(F.col("y") > 0, 7).otherwise(3))
    mb = ml.train_model(b, ["f1", "f2"], "y", "gradient_boosting", "binary", n_estimators=5)
    assert {r.prediction for r in mb.transform(b).select("prediction").distinct().collect()} <= {3.0, 7.0}


def test_workflow_files_and_nan_reader(spark):
    from kiln.session import scratch_path
    from kiln.sources.tables import read_table
    from kiln.workflow import apply_rules_file, prepare_file
    d = tempfile.mkdtemp(prefix="kiln-wf-")
    open(os.path.join(d, "a.csv"), "w").write("x,c\n1.0,u\nNA,v\n3.0,u\n5.0,NaN\n")
    os.makedirs(os.path.join(d, "b"))
    open(os.path.join(d, "b", "b.csv"), "w").write("x,c\n2.0,v\n,w\n")
    steps = [{"operation": "missing_values", "strategy": "mean", "columns": ["x"]},
             {"operation": "encoding", "method": "label", "columns": ["c"]}]
    rules_path = scratch_path(spark, "wf-rules")
    first = prepare_file(spark, os.path.join(d, "a.csv"), steps, rules_path)
    assert sorted(map(tuple, first.collect())) == [(1.0, 1), (3.0, 1), (3.0, 2), (5.0, 0)]
    other = apply_rules_file(spark, os.path.join(d, "b"), rules_path)
    assert sorted(map(tuple, other.collect()), key=str) == [(2.0, 2), (3.0, None)]
    pq = os.path.join(d, "nan.parquet")
    spark.createDataFrame([(1.0,), (float("nan"),)], "v double").write.parquet(pq)
    assert read_table(spark, pq).where("v IS NULL").count() == 1


def test_saved_model_keeps_class_values(spark, blobs):
    from kiln.session import scratch_path
    df = blobs.withColumn("y", F.col("y") * 10 + 2)           # classes 2, 12, 22
    m = ml.train_model(df, ["f1", "f2"], "y", "decision_tree", "multiclass")
    path = scratch_path(spark, "model-classes")
    ml.save_model(m, path)
    back = ml.load_model(spark, path)
    a = {r.id: r.prediction for r in m.transform(df).select("id", "prediction").collect()}
    b = {r.id: r.prediction for r in back.transform(df).select("id", "prediction").collect()}
    assert a == b and set(a.values()) <= {2.0, 12.0, 22.0}


def test_knn_model_missing_features(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0, 0), (1, 1.1, 0.1, 0), (2, 5.0, 5.0, 1), (3, 5.1, 4.9, 1)],
                               "id long, a double, b double, y int")
    m = ml.train_model(df, ["a", "b"], "y", "knn", "binary", n_neighbors=1)
    q = spark.createDataFrame([(10, 1.05, 0.05), (11, None, 5.0)], "id long, a double, b double")
    got = {r.id: r.prediction for r in m.transform(q).collect()}
    assert got == {10: 0, 11: None}
    bad = df.withColumn("a", F.when(F.col("id") == 1, None).otherwise(F.col("a")))
    with pytest.raises(ValueError, match="missing values"):
        ml.train_model(bad, ["a", "b"], "y", "knn", "binary")


def test_rows_per_file_any_case(spark):
    from kiln.sources.files import rows_per_file
    d = tempfile.mkdtemp(prefix="kiln-rpf-")
    os.makedirs(os.path.join(d, "s"))
    open(os.path.join(d, "a.csv"), "w").write("x\n1\n2\n")
    open(os.path.join(d, "s", "b.CSV"), "w").write("x\n3\n")
    open(os.path.join(d, "s", "c.txt"), "w").write("x\n4\n")
    got = {os.path.basename(r.path): r.n_rows for r in rows_per_file(spark, d).collect()}
    assert got == {"a.csv": 2, "b.CSV": 1}


def test_importance_of_one_vs_rest_and_none(spark):
    """One-vs-rest averages its classes' importances; a model without a pipeline (k-NN) has none."""
    from types import SimpleNamespace

    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.dense(float(i % 9), float(i % 2)), float(i % 9 // 3)) for i in range(90)], ["features", "label"])
    fitted = OneVsRest(classifier=LinearSVC(maxIter=3)).fit(df.coalesce(1))
    model = SimpleNamespace(pipeline=SimpleNamespace(stages=[fitted]), features=["a", "b"])
    imp = {r["feature"]: r["importance"] for r in ml.feature_importance(model).collect()}
    each = [abs(m.coefficients.toArray()) for m in fitted.models]
    assert imp == pytest.approx({"a": sum(c[0] for c in each) / 3, "b": sum(c[1] for c in each) / 3})
    assert ml.feature_importance(SimpleNamespace(pipeline=None, features=["a"])) is None


def test_forest_rows_are_dealt_over_the_cores(spark):
    """rows of one file are shared by all cores, each row once; a few rows stay as they lie."""
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(20000).withColumn("x", F.col("id") % 977).coalesce(1)
    dealt = ml._dealt(df, 20000)
    sizes = dealt.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert len(sizes) == min(cores, 20000 // ml._TREE_TASK_ROWS) and max(sizes) - min(sizes) <= 1
    assert sorted(r.id for r in dealt.collect()) == list(range(20000))
    assert ml._dealt(df.limit(1000), 1000).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("kind", ["random_forest", "decision_tree"])
@pytest.mark.parametrize("problem,target", [("multiclass", "y"), ("regression", "t")])
def test_trees_keep_node_ids_with_the_rows(spark, kind, problem, target):
    """The trees grown so far are not sent out with every pass; the model is the one fitted without that."""
    rnd = random.Random(8)
    rows = [(i, rnd.gauss(i % 3, 1), rnd.gauss(-(i % 3), 1), i % 3, rnd.gauss(i % 3, 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, f1 double, f2 double, y int, t double").coalesce(1)
    params = {"n_estimators": 4} if kind == "random_forest" else {}
    fitted = ml.train_model(df, ["f1", "f2"], target, kind, problem, **params)
    assert fitted.pipeline.stages[-1].getCacheNodeIds()
    plain = ml.create_estimator(kind, problem, n_rows=400, **params).setCacheNodeIds(False)
    points = fitted.pipeline.stages[0].transform(ml._with_inputs(df.withColumn("label", F.col(target).cast("double")), ["f1", "f2"]))
    want = plain.fit(points).toDebugString.split("\n", 1)[1]
    assert fitted.pipeline.stages[-1].toDebugString.split("\n", 1)[1] == want
