"""NaN as a missing value, exact integer modes, column names with dots, CSV by RFC 4180, listings."""

import csv
import math

import pytest
from pyspark.sql import functions as F

from kiln.operators import corr, models, prep, profile, stats
from kiln.sources import csv as kcsv, files


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(i, float(i), float(i * i % 7), math.nan if i % 2 else float(i)) for i in range(20)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double")


def test_nan_counts_as_missing(gaps):
    assert profile.columns_with_nulls(gaps) == ["c"]
    assert [r.column for r in profile.null_columns(gaps).collect()] == ["c"]
    assert profile.table_summary(gaps).first().n_missing_cells == 10
    assert {r.column: r.n_missing for r in profile.missing_by_column(gaps).collect()}["c"] == 10
    assert {r.pattern: r.n_rows for r in profile.missing_patterns(gaps).collect()} == {"c": 10, "No missing values": 10}


def test_spearman_ignores_nan_of_other_columns(gaps):
    def ab(cols):
        return [r["corr"] for r in corr.spearman_matrix(gaps, cols).collect() if (r.column_a, r.column_b) == ("a", "b")][0]
    assert ab(["a", "b"]) == pytest.approx(ab(["a", "b", "c"]))


def test_iqr_keeps_nan_like_null(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(math.nan,), (None,), (1000.0,)], "x double")
    rules, kept = prep.fit_outliers(df, "iqr", columns=["x"])
    assert kept.count() == 12


def test_mode_of_large_integers(spark):
    df = spark.createDataFrame([(9007199254740993,)] * 2 + [(9007199254740992,)], "x long")
    assert stats.modes(df, ["x"])["x"] == 9007199254740993


def test_one_hot_does_not_replace_a_column(spark):
    df = spark.createDataFrame([("x", 1)], "a string, a_x int")
    rules = prep.fit_encode(df, "onehot", ["a"])
    with pytest.raises(ValueError, match="a_x"):
        prep.apply_rules(df, rules)


def test_dotted_features_and_unknown_parameters(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(10)], "`a.b` double, y double")
    m = models.train_model(df, ["a.b"], "y", "linear_regression", "regression")
    assert m.transform(df).where(F.abs(F.col("prediction") - F.col("y")) > 1e-6).count() == 0
    for bad in ({"n_estimatorz": 3}, {"min_samples_split": 5}):
        with pytest.raises(ValueError):
            models.train_model(df, ["a.b"], "y", "decision_tree", "regression", **bad)


def test_csv_quotes_line_breaks_and_types(spark, tmp_path):
    rows = [["t", "n", "m"], ['he said "hi", ok', "1", "12d"], ["two\nlines", "2.5", "3f"], ["plain", "NA", "1"]]
    d = tmp_path / "in"
    d.mkdir()
    with open(d / "x.csv", "w", newline="") as f:
        csv.writer(f).writerows(rows)
    df = kcsv.read_csv_typed(spark, str(d / "x.csv"))
    assert dict(df.dtypes) == {"t": "string", "n": "double", "m": "string"}
    assert {r.t for r in df.collect()} == {r[0] for r in rows[1:]}
    out = kcsv.write_csv(df.select("t").coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*.csv"))
    with open(part, newline="") as f:
        assert sorted(r[0] for r in list(csv.reader(f))[1:]) == sorted(r[0] for r in rows[1:])
    assert out


def test_listing_of_odd_roots_and_empty_files(spark, tmp_path):
    root = tmp_path / "l+s (x)"
    root.mkdir()
    (root / "a.csv").write_text("x\n1\n2\n")
    (root / "head only.csv").write_text("x\n")
    assert {r.relative_path for r in files.list_files(spark, str(root)).collect()} == {"a.csv", "head only.csv"}
    counts = {r.path.rsplit("/", 1)[1].replace("%20", " "): r.n_rows for r in files.rows_per_file(spark, str(root)).collect()}
    assert counts == {"a.csv": 2, "head only.csv": 0}
    assert set(files.load_files(spark, str(root))) == {"a.csv", "head only.csv"}
