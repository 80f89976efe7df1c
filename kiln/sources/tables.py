"""Reading tables for profiling and preparation: one missing-value form (NULL) from the start."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kiln.functions.columns import nan_to_null
from kiln.sources.csv import read_csv_typed


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Parquet/ORC/JSON/CSV with float NaN turned into NULL (CSV also maps the pandas tokens)."""
    if fmt == "csv":
        return nan_to_null(read_csv_typed(spark, path, **options))
    return nan_to_null(spark.read.format(fmt).options(**options).load(path))
