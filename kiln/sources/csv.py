"""CSV scan with pandas-style missing-value tokens and type choice; CSV sink.

The scan reads every field as text, turns missing-value tokens into NULL, and picks one
type per column (bigint, then double, then boolean, else string) from a single
aggregate over all columns.  Spark's own ``inferSchema`` would keep ``NA`` as text and
make the whole column a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kiln.functions.columns import qcol

# The text that pandas' CSV reader treats as missing by default.
PANDAS_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# The text pandas reads as booleans.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]


def _clean(c: Column, tokens: list[str]) -> Column:
    return F.when(c.isin(tokens), F.lit(None)).otherwise(c)


def _bool(c: Column) -> Column:
    return F.when(c.isin(TRUE_TOKENS), F.lit(True)).when(c.isin(FALSE_TOKENS), F.lit(False))


# The text that pandas reads as a number (Java's casts also take a trailing d or f).
_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|Inf|Infinity)$"


# No text that a cast to bigint takes fails this; a cast that fails costs an exception, many times a match.
_DIGITS = r"^[^0-9.]*[0-9]+[^0-9.]*$"


def infer_types(df: DataFrame, tokens: list[str] = PANDAS_NA_TOKENS) -> dict[str, str]:
    """Type per text column, from one aggregate counting which casts succeed."""
    aggs = []
    for i, c in enumerate(df.columns):
        v = _clean(qcol(c), tokens)
        t = F.trim(v)
        aggs += [F.count(v).alias(f"n{i}"), F.count(F.when(t.rlike(_DIGITS), t.try_cast("bigint"))).alias(f"l{i}"),
                 F.count(F.when(t.rlike(_NUMBER), t.try_cast("double"))).alias(f"d{i}"), F.count(_bool(t)).alias(f"b{i}")]
    r = df.agg(*aggs).collect()[0]
    out = {}
    for i, c in enumerate(df.columns):
        n = r[f"n{i}"]
        if n == 0:
            out[c] = "double"                   # an all-missing column is a float column in pandas
        elif r[f"l{i}"] == n:
            out[c] = "bigint"
        elif r[f"d{i}"] == n:
            out[c] = "double"
        elif r[f"b{i}"] == n:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


SURPLUS, RECORD = "_surplus", "_record"


def _one_line_records(spark: SparkSession, path: str) -> bool:
    """Whether every record is one line, for certain: no quote and no carriage return anywhere, nor a line of blanks, which
    only the reader of whole files takes for a record.  One scan in splits."""
    v = F.col("value")
    other = v.contains('"') | v.contains("\r") | v.rlike(r"^[\x00-\x20]+$")
    return not spark.read.option("lineSep", "\n").text(path).agg(F.max(other)).first()[0]


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = True, **options) -> DataFrame:
    """Every field as text under the header's names, plus SURPLUS (the first field beyond the header unless
    empty, else NULL) and RECORD (the
    line of a row whose fields do not match the header's, in number; else NULL)."""
    # a file that may have line breaks in quotes is read by one task, whatever its size
    multi_line = multi_line and (bool(options) or not _one_line_records(spark, path))
    reader = (spark.read.option("header", True).option("inferSchema", False)
              .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
              .option("emptyValue", "").options(**options))
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, SURPLUS, RECORD]])
    return reader.option("columnNameOfCorruptRecord", RECORD).schema(schema).csv(path)


def ragged_rows(spark: SparkSession, path: str, multi_line: bool = True, **options) -> DataFrame:
    """(path, record) of the rows with more fields than the header: what ``read_csv_typed`` refuses, drops or rescues."""
    raw = read_csv_text(spark, path, multi_line, **options)
    # a row with exactly one field too many fits the widened schema, so its line is put together from its fields
    fields = F.concat_ws(",", *[F.coalesce(_quoted(qcol(c)), F.lit("")) for c in raw.columns if c != RECORD])
    return raw.select("*", F.col("_metadata.file_path").alias("path")).where(F.col(SURPLUS).isNotNull()).select(
        "path", F.coalesce(F.col(RECORD), fields).alias("record"))


def _quoted(c: Column) -> Column:
    needs = c.rlike('[",\n\r]')
    return F.when(needs, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def read_csv_typed(spark: SparkSession, path: str, tokens: list[str] = PANDAS_NA_TOKENS,
                   types: dict[str, str] | None = None, multi_line: bool = True, ragged: str = "error", **options) -> DataFrame:
    """Read CSV with a header; missing tokens -> NULL; one type per column (see module doc).

    A row with fewer fields than the header ends in NULLs.  One with more is never cut in silence: ``ragged`` is ``error`` (the
    default: raise, naming how many and some of them), ``drop`` (leave such rows out) or ``rescue`` (keep
    the fields of the header and the whole line in a column RECORD); ``ragged_rows`` lists them.

    Quotes are doubled inside quoted fields (RFC 4180).  ``multi_line`` reads quoted line breaks;
    turn it off for files known to have none, so that Spark can split large files."""
    if ragged not in ("error", "drop", "rescue"):
        raise ValueError(f"ragged must be error, drop or rescue, not {ragged!r}")
    raw = read_csv_text(spark, path, multi_line, **options)
    names = [c for c in raw.columns if c not in (SURPLUS, RECORD)]
    too_long = F.col(SURPLUS).isNotNull()
    if ragged == "error":
        first = raw.where(too_long).limit(3).count()
        if first:
            n, some = raw.where(too_long).count(), [r["record"] for r in ragged_rows(spark, path, multi_line, **options).limit(3).collect()]
            raise ValueError(f"{n} rows of {path} have more than {len(names)} fields, such as {some}")
    elif ragged == "drop":
        raw = raw.where(~too_long)
    text = raw.select(*[_clean(qcol(c), tokens).alias(c) for c in names])
    types = types or infer_types(text, tokens)
    sel = []
    for c in names:
        t = types[c]
        v = _clean(qcol(c), tokens)
        if t == "boolean":
            sel.append(_bool(F.trim(v)).alias(c))
        elif t == "string":
            sel.append(v.alias(c))
        else:
            sel.append(F.trim(v).cast(t).alias(c))
    if ragged == "rescue":
        fields = F.concat_ws(",", *[F.coalesce(_quoted(qcol(c)), F.lit("")) for c in [*names, SURPLUS]])
        sel.append(F.when(too_long, F.coalesce(F.col(RECORD), fields)).alias(RECORD))
    return raw.select(*sel)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header row, no index; booleans as True/False like the reference's files."""
    out = df.select(*[
        F.when(qcol(f.name), F.lit("True")).when(~qcol(f.name), F.lit("False")).alias(f.name)
        if f.dataType.simpleString() == "boolean" else qcol(f.name)
        for f in df.schema.fields])
    out.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path
