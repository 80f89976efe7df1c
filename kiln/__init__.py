"""kiln — table profiling, preparation rules, splits, models and evaluation on Spark.

Every operator takes and returns ``pyspark.sql.DataFrame`` objects.  Statistics are
computed as fused distributed aggregates; the fitted results ("rules") are small
driver-side values that replay as plain projections and filters.
"""

from kiln.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
__version__ = "0.1.0"
