"""Fitted rules are projections and filters, so they run unchanged on a streaming DataFrame.

``start_rules_stream`` starts a query: file source -> ``apply_rules`` (-> model) -> parquet
sink, with its checkpoint under the shared ``spark.checkpoint.dir``; a restarted query
resumes from that checkpoint after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kiln.operators.prep import Rule, apply_rules
from kiln.session import scratch_path


def start_rules_stream(spark: SparkSession, source: str, schema, rules: list[Rule], sink: str,
                       *, fmt: str = "parquet", prepare: Callable[[DataFrame], DataFrame] | None = None,
                       model=None, checkpoint: str | None = None, available_now: bool = True,
                       max_files_per_trigger: int | None = None) -> StreamingQuery:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source)
    if prepare is not None:
        stream = prepare(stream)
    out = apply_rules(stream, rules)
    if model is not None:
        out = model.transform(out)
    writer = (out.writeStream.format("parquet").option("path", sink)
              .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def stream_apply_rules(spark: SparkSession, source: str, schema, rules: list[Rule], **kw) -> DataFrame:
    """Run the stream over everything available now and return the written result table."""
    sink = kw.pop("sink", None) or scratch_path(spark, "stream-out")
    q = start_rules_stream(spark, source, schema, rules, sink, **kw)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(sink)
