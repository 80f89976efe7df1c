"""M1: reproducible three-way split by key hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kiln.functions.columns import key_bucket, qcol


def split_three_way(df: DataFrame, key: str, test_size: float = 0.2, val_size: float = 0.2,
                    seed: int = 42, column: str = "split", hash: str = "md5") -> DataFrame:
    """Add ``split`` in {train, validation, test}: ``test_size`` of rows to test, then
    ``val_size`` of the rest to validation (64/16/20 by default).

    The bucket is md5(key#seed) mod 10,000 — a pure function of the key, so the split is
    the same under any partitioning and when a lost partition is recomputed (unlike
    ``randomSplit``).  No shuffle: one projection.  ``hash="xxhash64"`` uses Spark's native
    64-bit hash instead: much cheaper per row, equally stable, but not reproducible outside
    Spark (md5 is, e.g. in the DuckDB oracles).
    """
    if hash == "md5":
        b = key_bucket(qcol(key), seed, 10000)
    elif hash == "xxhash64":
        b = F.pmod(F.xxhash64(qcol(key), F.lit(seed)), F.lit(10000)).cast("int")
    else:
        raise ValueError("hash must be 'md5' or 'xxhash64'")
    t_cut = int(round(test_size * 10000))
    v_cut = t_cut + int(round(val_size * (1 - test_size) * 10000))
    return df.withColumn(column, F.when(b < t_cut, "test").when(b < v_cut, "validation")
                         .otherwise("train"))
