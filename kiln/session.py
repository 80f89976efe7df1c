"""Session construction and cluster-shared locations."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings we want on every session unless the cluster already decided otherwise.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "kiln",
              shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Return the active session or build one.

    ``master`` and ``shuffle_partitions`` are only for local runs and tests; on a cluster
    leave them unset so the deployment's values apply.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Taken from ``spark.checkpoint.dir`` (or the context's checkpoint dir).  Only a local
    session without one gets a private temporary folder; a cluster session without one
    is a configuration error, because a machine-local folder is not visible to executors.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
        return d
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    d = tempfile.mkdtemp(prefix="kiln-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for a written intermediate table."""
    base = checkpoint_dir(spark).rstrip("/")
    import uuid
    return f"{base}/kiln-{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that a later one replaces."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def default_parallelism(spark: SparkSession) -> int:
    try:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover
        return spark.sparkContext.defaultParallelism


def run_concurrently(fn, items, max_workers: int = 4) -> list:
    """Submit independent Spark jobs from a few driver threads (results keep input order).

    Only job submission is concurrent; every job still runs distributed.
    """
    items = list(items)
    if len(items) <= 1:
        return [fn(x) for x in items]
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    # worker threads keep the caller's job group, tags, description and scheduler pool
    active = SparkSession.getActiveSession()
    run = inheritable_thread_target(active)(fn) if active is not None else inheritable_thread_target(fn)
    with ThreadPoolExecutor(max_workers=min(max_workers, len(items))) as pool:
        return list(pool.map(run, items))


__all__ = ["get_spark", "checkpoint_dir", "scratch_path", "drop_scratch", "default_parallelism", "run_concurrently"]
