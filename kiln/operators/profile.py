"""Table profiles: summary, describe, value counts, missing values, sizes, previews.

Each profile is one fused aggregate over the table (plus a second pass for exact
quantiles in ``describe_numeric``); results are small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from kiln.functions.columns import (is_missing, categorical_columns, fixed_width, key_hash, num, numeric_columns,
                                    qcol)
from kiln.operators import stats

DESCRIBE_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()), T.StructField("count", T.LongType()),
    T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType()),
    T.StructField("min", T.DoubleType()), T.StructField("q25", T.DoubleType()),
    T.StructField("q50", T.DoubleType()), T.StructField("q75", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
])


def select_numeric(df: DataFrame) -> DataFrame:
    """The numeric columns."""
    return df.select(*[qcol(c) for c in numeric_columns(df)])


def select_categorical(df: DataFrame) -> DataFrame:
    """The string columns."""
    return df.select(*[qcol(c) for c in categorical_columns(df)])


def columns_with_nulls(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Columns holding at least one null (one aggregate over all columns)."""
    cols = columns or df.columns
    row = df.agg(*[F.max(is_missing(df, c).cast("int")).alias(f"c{i}")
                   for i, c in enumerate(cols)]).collect()[0]
    return [c for i, c in enumerate(cols) if row[f"c{i}"] == 1]


def null_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """P2 as a table: (column) for every column holding a null — one aggregate, then unpivot."""
    cols = columns or df.columns
    wide = df.agg(*[F.max(is_missing(df, c).cast("int")).alias(f"c{i}") for i, c in enumerate(cols)])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("has_null")) for i, c in enumerate(cols)]))
        .alias("s"))
    return long.where(F.col("s.has_null") == 1).select(F.col("s.column").alias("column"))


def head_preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows by key (a bounded top-k, no global sort)."""
    return df.orderBy(*[qcol(c) for c in order_by]).limit(n)


def table_summary(df: DataFrame) -> DataFrame:
    """A1: rows, columns, numeric / categorical column counts, columns per type ("type:count"
    joined by ', ', types sorted) and null cells — one aggregate."""
    num_cols, cat = numeric_columns(df), categorical_columns(df)
    per_type = ", ".join(f"{t}:{n}" for t, n in sorted(columns_per_type(df).items()))
    nulls = [F.sum(is_missing(df, c).cast("long")) for c in df.columns]
    total_nulls = nulls[0] if len(nulls) == 1 else sum(nulls[1:], nulls[0])
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(len(num_cols)).cast("long").alias("n_numeric"),
        F.lit(len(cat)).cast("long").alias("n_categorical"),
        F.lit(per_type).alias("column_types"),
        F.coalesce(total_nulls, F.lit(0)).cast("long").alias("n_missing_cells"),
    )


def columns_per_type(df: DataFrame) -> dict[str, int]:
    """A1: number of columns per Spark type name (schema only)."""
    out: dict[str, int] = {}
    for f in df.schema.fields:
        out[f.dataType.simpleString()] = out.get(f.dataType.simpleString(), 0) + 1
    return out


def describe_numeric(df: DataFrame, columns: list[str] | None = None,
                     approx: bool = False) -> DataFrame:
    """A2: count, mean, sample std, min, quartiles, max per numeric column (long form).

    Quartiles come first from one exact pass (``stats.quantiles``: a (column, value) count
    shuffle, small columns finished from their pairs, large ones by rank selection) and
    enter the plan as literals; the returned plan is one aggregate over the table for the
    moments, unpivoted to one row per column.  ``approx=True`` puts ``percentile_approx``
    into that aggregate instead.
    """
    cols = columns or numeric_columns(df)
    probs = [0.25, 0.5, 0.75]
    q = {} if approx else stats.quantiles(df, cols, probs)
    aggs = []
    for i, c in enumerate(cols):
        x = num(c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if approx:
            aggs.append(F.percentile_approx(x, probs, 10000).alias(f"q{i}"))
        else:
            aggs.append(F.array(*[F.lit(v).cast("double") for v in q[c]]).alias(f"q{i}"))
    wide = df.agg(*aggs)
    long = wide.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"m{i}").alias("mean"),
        F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"),
        F.element_at(F.col(f"q{i}"), 1).alias("q25"), F.element_at(F.col(f"q{i}"), 2).alias("q50"),
        F.element_at(F.col(f"q{i}"), 3).alias("q75"), F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(cols)])).alias("r"))
    return long.select(*[F.col(f"r.{f.name}").cast(f.dataType).alias(f.name) for f in DESCRIBE_SCHEMA.fields])


def value_counts_all(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A3: (column, value, count) for every categorical column, nulls excluded.

    All columns go through one Expand + one partially aggregated shuffle.
    """
    cols = columns or categorical_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, count bigint")
    long = stats.unpivot(df, cols, "string").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy("column", F.desc("count"), "value")


def missing_by_column(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A4: null count and percent of rows per column (one aggregate, then unpivot)."""
    cols = columns or df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.sum(is_missing(df, c).cast("long")).alias(f"c{i}") for i, c in enumerate(cols)])
    long = wide.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("n_missing"))
        for i, c in enumerate(cols)])).alias("s"))
    out = long.select(
        F.col("s.column").alias("column"), F.col("s.n_missing").alias("n_missing"),
        (F.try_divide(F.col("s.n_missing") * F.lit(100.0), F.col("_n"))).alias("pct_missing"))
    return out.orderBy(F.desc("pct_missing"), F.asc("column"))       # one row per column


NO_MISSING = "No missing values"


def missing_patterns(df: DataFrame, columns: list[str] | None = None,
                     columns_have_nulls: bool = False) -> DataFrame:
    """A5: one row per distinct null pattern over the columns that have nulls.

    ``pattern`` joins the names of the missing columns with ', ' (or says there are none);
    ``n_rows`` counts rows with that pattern.  With ``columns_have_nulls=True`` the given
    columns are taken as the null-holding ones (no extra pass to find them).
    """
    cols = list(columns or []) if columns_have_nulls else columns_with_nulls(df, columns)
    if not cols:
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(NO_MISSING).alias("pattern"), "n_rows")
    if len(cols) > 62:
        label = F.concat_ws(", ", *[F.when(is_missing(df, c), F.lit(c)) for c in cols])
        pattern = F.when(label == "", F.lit(NO_MISSING)).otherwise(label)
        return df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n_rows")) \
            .orderBy(F.desc("n_rows"), "pattern")
    # Group on a bitmask of null flags (one long per row); build the text label only for
    # the few aggregated patterns.
    mask = sum((F.when(is_missing(df, c), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
                for i, c in enumerate(cols)), F.lit(0).cast("long"))
    counts = df.groupBy(mask.alias("_mask")).agg(F.count(F.lit(1)).alias("n_rows"))
    label = F.concat_ws(", ", *[F.when(F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(c))
                                for i, c in enumerate(cols)])
    return counts.select(F.when(F.col("_mask") == 0, F.lit(NO_MISSING)).otherwise(label).alias("pattern"),
                         "n_rows").orderBy(F.desc("n_rows"), "pattern")


def _bytes_expr(f: T.StructField):
    c = qcol(f.name)
    w = fixed_width(f.dataType)
    if w is not None:
        return F.count(c) * F.lit(w)
    if isinstance(f.dataType, T.StringType):
        return F.sum(F.octet_length(c))
    if isinstance(f.dataType, T.BinaryType):
        return F.sum(F.octet_length(c))
    if isinstance(f.dataType, T.ArrayType) and fixed_width(f.dataType.elementType):
        return F.sum(F.size(c)) * F.lit(fixed_width(f.dataType.elementType))
    return None


def column_bytes(df: DataFrame) -> DataFrame:
    """Logical data bytes per column (fixed width × non-null values; UTF-8 bytes of text)."""
    fields = [f for f in df.schema.fields if _bytes_expr(f) is not None]
    wide = df.agg(*[F.coalesce(_bytes_expr(f), F.lit(0)).cast("long").alias(f"b{i}")
                    for i, f in enumerate(fields)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.col(f"b{i}").alias("n_bytes"))
        for i, f in enumerate(fields)])).alias("s")).select("s.column", "s.n_bytes")


def dataset_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and logical bytes per dataset (one aggregate per dataset, unioned)."""
    parts = []
    for name, df in tables.items():
        fields = [f for f in df.schema.fields if _bytes_expr(f) is not None]
        b = [F.coalesce(_bytes_expr(f), F.lit(0)).cast("long") for f in fields]
        total = sum(b[1:], b[0]) if b else F.lit(0).cast("long")
        parts.append(df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("n_rows"),
                            F.lit(len(df.columns)).cast("long").alias("n_columns"),
                            total.alias("n_bytes")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def batch_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """Number of datasets, rows and logical bytes over all of them."""
    return dataset_totals(tables).agg(F.count(F.lit(1)).alias("n_datasets"), F.sum("n_rows").alias("n_rows"),
                                      F.sum("n_bytes").alias("n_bytes"))


def category_share(df: DataFrame, column: str) -> DataFrame:
    """Count and share of all non-null values per category.

    The total is a scalar subquery (one value), not a join.
    """
    c = qcol(column)
    nonnull = df.where(c.isNotNull())
    total = nonnull.select(F.count(F.lit(1))).scalar()
    counts = nonnull.groupBy(c.alias("category")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select("category", "count", (F.col("count") / total).alias("share")) \
        .orderBy(F.desc("count"), "category")


def scatter_sample(df: DataFrame, key: str, n: int | None, seed: int = 42) -> DataFrame:
    """The ``n`` rows of smallest (md5(key#seed), key) — exact size, stable under repartition.

    Counts by the upper and then the lower half of the 32-bit hash (2**16 numbers each) give the hash at which the
    sample ends.  Rows below it are filtered where they lie; only rows that share that one hash are put in
    order.  ``n=None`` or 0 keeps every row, in no order."""
    if not n:
        return df
    h = key_hash(qcol(key), seed)
    upper, lower = F.shiftright(h, 16), h.bitwiseAND(0xFFFF)

    def cut(rows: DataFrame, half, want: int) -> tuple[int | None, int]:
        """(the half at which ``want`` rows are reached, rows before it); None if there are fewer."""
        before = 0
        for r in sorted(rows.groupBy(half.alias("h")).agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: r["h"]):
            if before + r["c"] >= want:
                return r["h"], before
            before += r["c"]
        return None, before

    hashed = df.where(qcol(key).isNotNull())
    top, before = cut(hashed, upper, n)
    if top is None:                                       # fewer hashed rows than asked for: rows without a key make up
        return hashed.unionByName(df.where(qcol(key).isNull()).limit(n - before))
    low, more = cut(hashed.where(upper == top), lower, n - before)
    last = (top << 16) + low
    return hashed.where(h < last).unionByName(hashed.where(h == last).orderBy(qcol(key)).limit(n - before - more))


class FeatureTypeError(ValueError):
    """Raised when model features are not numeric."""


def feature_target(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """Keep features + target; every feature must be numeric (checked on the schema)."""
    feats = features or [c for c in df.columns if c != target]
    types = {f.name: f.dataType for f in df.schema.fields}
    bad = [c for c in feats if not isinstance(types[c], T.NumericType)]
    if bad:
        raise FeatureTypeError("non-numeric feature columns: " + ", ".join(bad))
    return df.select(*[qcol(c) for c in feats], qcol(target))


def target_classes(df: DataFrame, target: str) -> DataFrame:
    """P5: classes of an int-cast target with their row counts; a null target raises."""
    t = qcol(target)
    n_null = df.where(t.isNull()).limit(1).count()
    if n_null:
        raise ValueError(f"target column {target!r} holds nulls")
    return df.groupBy(t.cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n_rows"))


def profile_table(df: DataFrame, correlation: str = "pearson",
                  numeric: list[str] | None = None) -> dict[str, DataFrame]:
    """The analysis page in one call: summary, describe, value counts, missing values,
    missing patterns, data bytes and a correlation matrix (all small result tables).

    Summary, missing counts, data bytes and the describe moments come from ONE fused
    aggregate (its single row is collected once); the quantile pass, value counts, missing
    patterns and the correlation add one scan each — instead of a scan per table.
    """
    from kiln.operators.corr import correlation_matrix
    spark = df.sparkSession
    cols = df.columns
    num_cols = numeric or numeric_columns(df)
    cat = categorical_columns(df)
    fields = [f for f in df.schema.fields if _bytes_expr(f) is not None]
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(is_missing(df, c).cast("long")).alias(f"z{i}") for i, c in enumerate(cols)]
    aggs += [F.coalesce(_bytes_expr(f), F.lit(0)).cast("long").alias(f"b{i}") for i, f in enumerate(fields)]
    for i, c in enumerate(num_cols):
        x = num(c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggs).collect()[0]                      # one row: a few values per column
    n = row["_n"]
    nulls = {c: row[f"z{i}"] or 0 for i, c in enumerate(cols)}
    per_type = ", ".join(f"{t}:{k}" for t, k in sorted(columns_per_type(df).items()))
    summary = spark.createDataFrame(
        [(n, len(cols), len(numeric_columns(df)), len(cat), per_type, sum(nulls.values()))],
        "n_rows bigint, n_columns bigint, n_numeric bigint, n_categorical bigint, column_types string, "
        "n_missing_cells bigint")
    missing = spark.createDataFrame(
        [(c, nulls[c], (nulls[c] * 100.0 / n) if n else None) for c in cols],
        "column string, n_missing bigint, pct_missing double").orderBy(F.desc("pct_missing"), "column")
    bytes_ = spark.createDataFrame([(f.name, row[f"b{i}"]) for i, f in enumerate(fields)],
                                   "column string, n_bytes bigint")
    q = stats.quantiles(df, num_cols, [0.25, 0.5, 0.75]) if num_cols else {}
    describe = spark.createDataFrame(
        [(c, row[f"n{i}"], row[f"m{i}"], row[f"s{i}"], row[f"lo{i}"], *q[c], row[f"hi{i}"])
         for i, c in enumerate(num_cols)], DESCRIBE_SCHEMA)
    out = {"summary": summary, "describe": describe, "value_counts": value_counts_all(df),
           "missing": missing,
           "missing_patterns": missing_patterns(df, [c for c in cols if nulls[c]], columns_have_nulls=True),
           "bytes": bytes_}
    if len(num_cols) >= 2:
        out["correlation"] = correlation_matrix(df, num_cols, correlation)
    return out
