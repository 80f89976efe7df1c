"""Schema classes and small column expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Numeric = Spark numeric types (the counterpart of numpy number dtypes);
# categorical = strings.  Booleans, timestamps and nested types are in neither class.
_FIXED_WIDTH = {
    T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.BooleanType: 1, T.DateType: 4,
    T.TimestampType: 8, T.TimestampNTZType: 8,
}


def qcol(name: str) -> Column:
    """Column by exact name; dots, spaces and back-quotes are not interpreted."""
    return F.col("`" + name.replace("`", "``") + "`")


def num(name: str) -> Column:
    """A numeric column as double with NaN read as NULL (one missing-value form, as pandas has)."""
    return F.nanvl(qcol(name).cast("double"), F.lit(None).cast("double"))


def is_missing(df: DataFrame, name: str) -> Column:
    """Whether a cell is missing: NULL, or NaN in a float column."""
    c = qcol(name)
    floating = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
    return c.isNull() | F.isnan(c) if floating else c.isNull()


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def fixed_width(dt: T.DataType) -> int | None:
    for cls, w in _FIXED_WIDTH.items():
        if isinstance(dt, cls):
            return w
    if isinstance(dt, T.DecimalType):
        return 8 if dt.precision <= 18 else 16
    return None


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One projection turning float NaN into NULL, so a missing value has one form."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if columns is not None:
        floats &= set(columns)
    if not floats:
        return df
    return df.select(*[
        (F.when(F.isnan(qcol(c)), F.lit(None)).otherwise(qcol(c)).alias(c) if c in floats else qcol(c))
        for c in df.columns
    ])


def key_bucket(key: Column, seed: int = 42, buckets: int = 10000) -> Column:
    """Stable bucket in [0, buckets) from the md5 of ``key#seed``.

    Depends on the key value only — not on partitioning, task order or retries — so a
    recomputed partition after an executor loss yields the same rows, and DuckDB/any engine
    with md5 reproduces it.
    """
    h = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}"))), 1, 8), 16, 10)
    return (h.cast("bigint") % F.lit(buckets)).cast("int")


def key_hash(key: Column, seed: int = 42) -> Column:
    """32-bit md5 prefix of ``key#seed`` as a bigint (sampling order)."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}"))), 1, 8), 16, 10).cast("bigint")


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every float column (for stable comparison across engines)."""
    return df.select(*[
        F.round(qcol(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else qcol(f.name)
        for f in df.schema.fields
    ])
