"""Rows with more fields than the header are reported, and samples end at a hash."""

import pytest
from pyspark.sql import functions as F

from kiln.functions.columns import key_hash
from kiln.operators.profile import scatter_sample
from kiln.sources import csv as kcsv

RAGGED = 'a,b\n1,2\n3,4,5\n6\n7,"8\n8"\n9,10,11,"x,""y""",13\n12,13,\n,14\n"q""r",15,"s,t"\n'


@pytest.fixture()
def ragged(tmp_path):
    (tmp_path / "r.csv").write_text(RAGGED)
    return str(tmp_path / "r.csv")


def test_surplus_fields_are_an_error(spark, ragged):
    with pytest.raises(ValueError, match="3 rows of .* more than 2 fields.*3,4,5"):
        kcsv.read_csv_typed(spark, ragged)
    with pytest.raises(ValueError, match="ragged"):
        kcsv.read_csv_typed(spark, ragged, ragged="cut")


def test_ragged_rows_are_listed_whole(spark, ragged):
    rows = kcsv.ragged_rows(spark, ragged).collect()
    assert sorted(r.record for r in rows) == sorted(["3,4,5", '9,10,11,"x,""y""",13', '"q""r",15,"s,t"'])
    assert all(r.path.endswith("r.csv") for r in rows)


def test_ragged_rows_dropped_or_rescued(spark, ragged):
    kept = {(r.a, r.b) for r in kcsv.read_csv_typed(spark, ragged, ragged="drop").collect()}
    assert kept == {(1, "2"), (6, None), (7, "8\n8"), (12, "13"), (None, "14")}     # an empty field at the end is no surplus
    rescued = kcsv.read_csv_typed(spark, ragged, ragged="rescue")
    assert rescued.columns == ["a", "b", kcsv.RECORD]
    got = {r.a: (r.b, r[kcsv.RECORD]) for r in rescued.collect()}
    assert got["3"] == ("4", "3,4,5") and got["1"] == ("2", None) and got["6"] == (None, None) and got['q"r'][1] == '"q""r",15,"s,t"'
    assert got["9"] == ("10", '9,10,11,"x,""y""",13') and got["12"] == ("13", None)


def test_even_files_read_as_before(spark, tmp_path):
    (tmp_path / "e.csv").write_text('x,y,z\n1,,"a"\n2,NA,""\n3,4.5,b\n')
    out = kcsv.read_csv_typed(spark, str(tmp_path / "e.csv"))
    assert out.dtypes == [("x", "bigint"), ("y", "double"), ("z", "string")]
    assert sorted(map(tuple, out.collect()), key=str) == [(1, None, "a"), (2, None, None), (3, 4.5, "b")]


def test_sample_equals_the_ordered_prefix(spark):
    df = spark.range(3000).select((F.col("id") % 2500).alias("k"), F.col("id").alias("v")).unionByName(
        spark.createDataFrame([(None, -1), (None, -2)], "k long, v long"))
    for n in (1, 7, 250, 2999, 3000, 3001, 3002, 5000):
        got = [r.k for r in scatter_sample(df, "k", n).collect()]
        want = [r.k for r in df.orderBy(F.col("k").isNull(), key_hash(F.col("k")), "k").limit(n).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert scatter_sample(df, "k", None).count() == 3002
    assert scatter_sample(df.limit(0), "k", 5).count() == 0


def test_sample_of_one_hot_key(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    assert len({r.id for r in scatter_sample(df, "k", 400).collect()}) == 400


def test_sample_plan_has_no_merge_of_all_rows(spark):
    """Only the rows at the last hash are ordered; the others are filtered in place."""
    plan = scatter_sample(spark.range(10_000), "id", 4000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 1 and "Union" in plan


def test_files_without_quotes_are_read_in_splits(spark, tmp_path):
    from kiln.sources import csv
    plain, quoted = tmp_path / "plain.csv", tmp_path / "quoted.csv"
    plain.write_text("a,b\n" + "".join(f"{i},x{i % 7}\n" for i in range(20000)))
    quoted.write_text('a,b\n1,"two\nlines"\n2,y\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = csv.read_csv_typed(spark, str(plain))
        assert df.rdd.getNumPartitions() > 1
        assert df.selectExpr("count(*)", "sum(a)", "count(distinct b)").first() == (20000, 199990000, 7)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [tuple(r) for r in csv.read_csv_typed(spark, str(quoted)).orderBy("a").collect()] == [(1, "two\nlines"), (2, "y")]
    for text in ("a,b\r\n1,x\r\n", "a,b\n \n1,x\n"):
        other = tmp_path / f"other{len(text)}.csv"
        other.write_bytes(text.encode())
        assert not csv._one_line_records(spark, str(other))
