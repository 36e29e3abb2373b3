"""Session helpers: building a session and cutting lineage safely."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

TASK_ROWS = 40_000  # rows of one task of an iterative fit


def get_spark(app: str = "winnow", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # files go when their table is no longer held
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables that all executors see.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a temporary folder of this machine.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    d = tempfile.mkdtemp(prefix="winnow-")
    spark.conf.set("spark.checkpoint.dir", d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage, so that iterative plans stay short
    and a lost executor does not replay the loop."""
    spark = df.sparkSession
    d = shared_dir(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows of ``df`` over partitions of about TASK_ROWS rows, by key: a small file of many rows is read by one
    task, and so would be every pass of a fit.  Tables of one task's rows stay as they are."""
    parts = -(-n // TASK_ROWS)
    if parts <= 1:
        return df
    name = f"`{key}`"
    return df.repartition(parts, name).sortWithinPartitions(name)  # in order, so that seeded draws repeat


def text_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of whole texts by rows, unless the session already says otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "1000")
