"""Recursive file listing and multi-file loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kiln.session import run_concurrently
from kiln.sources.csv import read_csv_typed

# Extensions the listing keeps, and the format each stands for.
DATA_EXTENSIONS = [".csv", ".xlsx"]
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg"]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every data or image file below ``root``: (path, relative_path, name, extension, format,
    length, modification_time).  Hidden entries (a path part starting with '.') are skipped;
    the extension test ignores case.  The ``content`` column is pruned from the scan, so no
    file body is read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select("path", "length", F.col("modificationTime").alias("modification_time")))
    prefix = root.rstrip("/")
    at = F.instr(F.col("path"), prefix + "/")            # the root is text here, not a pattern
    rel = F.when(at > 0, F.substr(F.col("path"), at + F.lit(len(prefix) + 1))).otherwise(F.col("path"))
    name = F.element_at(F.split(rel, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    fmt = (F.when(ext.isin(DATA_EXTENSIONS), F.lit("data"))
           .when(ext.isin(IMAGE_EXTENSIONS), F.lit("image")))
    out = files.select("path", rel.alias("relative_path"), name.alias("name"), ext.alias("extension"),
                       fmt.alias("format"), "length", "modification_time")
    hidden = F.exists(F.split(F.col("relative_path"), "/"), lambda p: p.startswith("."))
    return out.where(F.col("format").isNotNull() & ~hidden)


def rows_per_file(spark: SparkSession, root: str) -> DataFrame:
    """S3 for same-schema CSV files: one scan of all of them, rows counted per source file; a file
    with a header only has 0."""
    df = (spark.read.option("header", True).option("recursiveFileLookup", True).option("quote", '"').option("escape", '"')
          .option("multiLine", True).option("pathGlobFilter", "*.[cC][sS][vV]").csv(root))
    counts = df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_rows"))
    # the listing has plain paths, the scan's metadata has URIs
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    decoded = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    listed = list_files(spark, root).where(F.col("extension") == ".csv").select(
        F.regexp_replace("path", "^file:/+", "file:///").alias("listed"), plain(F.col("path")).alias("_key"))
    return (listed.join(counts.withColumn("_key", plain(decoded)), "_key", "left")
            .select(F.coalesce("path", "listed").alias("path"), F.coalesce("n_rows", F.lit(0)).alias("n_rows")))


def load_files(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """S3 for files with different schemas: relative path -> lazily typed DataFrame.

    Only the listing is collected (one row per file, as each becomes a DataFrame; same-schema
    directories of any size go through ``rows_per_file`` / one ``read_csv_typed`` instead).
    A file that fails type inference is reported in the ``__errors__`` entry and skipped.
    """
    out: dict[str, DataFrame] = {}
    errors = {}
    listing = list_files(spark, root).where(F.col("extension") == ".csv").select(
        "path", "relative_path").collect()

    def read(r):
        try:
            return r["relative_path"], read_csv_typed(spark, r["path"]), None
        except Exception as e:  # noqa: BLE001 — reported, not hidden
            return r["relative_path"], None, str(e)

    for name, df, error in run_concurrently(read, listing):
        if error is None:
            out[name] = df
        else:
            errors[name] = error
    if errors:
        out["__errors__"] = spark.createDataFrame(list(errors.items()), "path string, error string")
    return out
