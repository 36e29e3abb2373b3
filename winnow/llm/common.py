"""Helpers the operators of this folder share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

SPACES = r"[\x20\x09-\x0D]+"
SAMPLE_PER_CUT = 32


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later steps start from files that
    every executor can reach, so a lost executor replays no more than its own tasks."""
    path = f"{shared_dir(df.sparkSession)}/winnow-{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of whole texts by rows, unless the session already says otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "1000")


def text_of(docs: DataFrame, name: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def hex_long(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x.cast("bigint"))), 16, "0")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sampled_cuts(df: DataFrame, key: Column, by: Column, n: int) -> list[str]:
    """At most ``n - 1`` cut points of a text key, from a sample of about 32 rows for each cut.

    ``by`` is the column whose hash picks the sampled rows.  The sample only places the cuts: every row
    then goes to one of the ranges, so no result depends on it.  What reaches the driver is bounded by ``n``."""
    total = df.count()
    share = min(1.0, n * SAMPLE_PER_CUT / max(total, 1))
    picked = df.where(F.pmod(F.xxhash64(by, F.lit(17)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    keys = sorted(r[0] for r in picked.select(key.alias("k")).collect())
    cuts = [keys[i * len(keys) // n] for i in range(1, n)] if keys else []
    return sorted(set(cuts))


def range_of(key: Column, cuts: list[str]) -> Column:
    """Number of the range between sorted ``cuts`` (without commas) that holds ``key``: a binary search."""
    if not cuts:
        return F.lit(0)
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    table = F.split(F.lit(",".join(cuts)), ",")
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                       lambda low, step: F.when(F.get(table, low + step - F.lit(1)) <= key, low + step).otherwise(low))
