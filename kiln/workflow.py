"""The reference's two file-level flows, as Spark jobs.

``prepare_file``: read a CSV, fit the recorded steps, save the rules, replay them on the
original file and write the result (the replayed output is what the reference keeps).
``apply_rules_file``: replay saved rules on another CSV without refitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kiln.operators import prep
from kiln.session import scratch_path
from kiln.sources.csv import write_csv
from kiln.sources.rules_io import load_rules, save_rules
from kiln.sources.tables import read_table


def prepare_file(spark: SparkSession, input_csv: str, steps: list, rules_path: str,
                 output_csv: str | None = None) -> DataFrame:
    # the text is parsed once: every fit and the replay scan the columns they need of a typed copy
    typed = scratch_path(spark, "typed-csv")
    read_table(spark, input_csv, "csv").write.parquet(typed)
    df = spark.read.parquet(typed)
    rules, _ = prep.fit_pipeline(df, steps)
    save_rules(spark, rules, rules_path)
    out = prep.apply_rules(df, load_rules(spark, rules_path))
    if output_csv:
        write_csv(out, output_csv)
    return out


def apply_rules_file(spark: SparkSession, input_csv: str, rules_path: str,
                     output_csv: str | None = None) -> DataFrame:
    out = prep.apply_rules(read_table(spark, input_csv, "csv"), load_rules(spark, rules_path))
    if output_csv:
        write_csv(out, output_csv)
    return out
