"""Sampling and paging.  Samples are reproducible: the order comes from a hash of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import c, require
from ..functions.keys import attach
from ..functions.stats import exact_quantiles
from .ordered import with_row_index

TAKE_LIMIT = 10_000   # beyond this many rows a sort-and-limit would gather too much in one task
SLICES = 65_536
SEED = 42


def resolve_size(total: int, n: int | None = None, frac: float | None = None) -> int:
    """Rows to draw: a clamped fraction, a clamped count, or at most 100."""
    if frac is not None:
        return max(1, int(total * min(1.0, max(0.01, frac))))
    if n is None:
        return min(100, total)
    return min(max(1, n), total)


def hash_order(key: str, seed: int = SEED) -> Column:
    """53 hash bits of the key, exact as a double."""
    return F.shiftrightunsigned(F.xxhash64(c(key), F.lit(seed)), 11)


def head(df: DataFrame, key: str, n: int) -> DataFrame:
    if n <= TAKE_LIMIT:
        return df.orderBy(c(key)).limit(n)
    return with_row_index(df, key, "_i").where(F.col("_i") < n).drop("_i")


def tail(df: DataFrame, key: str, n: int) -> DataFrame:
    if n <= TAKE_LIMIT:
        return df.orderBy(c(key).desc()).limit(n)
    total = df.count()
    return with_row_index(df, key, "_i").where(F.col("_i") >= total - n).drop("_i")


def page(df: DataFrame, key: str, number: int, size: int) -> DataFrame:
    """1-based page in key order; the number is clamped to the pages there are."""
    total = df.count()
    pages = max(1, -(-total // size))
    at = (min(max(1, number), pages) - 1) * size
    if at + size <= TAKE_LIMIT:
        return df.orderBy(c(key)).offset(at).limit(size)
    return with_row_index(df, key, "_i").where((F.col("_i") >= at) & (F.col("_i") < at + size)).drop("_i")


def page_after(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """Next page by key, for walking a table of any size."""
    return df.where(c(key) > F.lit(last)).orderBy(c(key)).limit(size)


def systematic(df: DataFrame, key: str, n: int) -> DataFrame:
    """Every k-th row in key order, n rows."""
    step = max(1, df.count() // n)
    i = F.col("_i")
    return with_row_index(df, key, "_i").where((i % step == 0) & (i < F.lit(n) * step)).drop("_i")


def random_sample(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """Exactly n rows: those with the smallest key hashes."""
    require(df, key)
    h = hash_order(key, seed)
    if n <= TAKE_LIMIT:
        return df.orderBy(h, c(key)).limit(n)
    total = df.count()
    if n >= total:
        return df
    # half way between the last hash that is in and the first that is out
    cut = exact_quantiles(df, {"h": h.cast("double")}, [(n - 0.5) / (total - 1)])["h"][0]
    inside = df.where(h.cast("double") <= F.lit(cut))
    if inside.count() == n:
        return inside
    # both have the same hash: the key decides among its rows
    sure = df.where(h < F.lit(int(cut)))
    tied = df.where(h == F.lit(int(cut))).orderBy(c(key)).limit(n - sure.count())
    return sure.unionByName(tied)


def stratified(df: DataFrame, key: str, by: str, n: int, seed: int = SEED) -> DataFrame:
    """max(1, round(stratum · n/total)) rows per stratum, by smallest key hash.

    Counting hash slices per stratum finds the slice where each quota ends; only rows of that
    slice are ranked, so a stratum of any size is spread over all tasks."""
    require(df, key, by)
    total = df.count()
    rows = df.where(c(by).isNotNull())
    h = hash_order(key, seed)
    sl = F.floor(h / F.lit(float(2 ** 53 // SLICES))).cast("int")
    cells = rows.groupBy(c(by).alias("_by"), sl.alias("_sl")).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy("_by")  # at most SLICES rows per stratum
    cum = F.sum("_k").over(w.orderBy("_sl"))
    quota = F.greatest(F.lit(1), F.rint(F.col("_t") * F.lit(n / total)).cast("bigint"))
    cut = (cells.withColumns({"_t": F.sum("_k").over(w), "_c": cum}).withColumn("_quota", quota)
           .where((F.col("_c") >= F.col("_quota")) & (F.col("_c") - F.col("_k") < F.col("_quota")))
           .select(F.col("_by").alias(by), F.col("_sl").alias("_cut"),
                   (F.col("_quota") - F.col("_c") + F.col("_k")).alias("_left"), F.col("_t").alias("_rows")))
    j = attach(rows.withColumns({"_sl": sl, "_h": h}), cut, [by], "_rows")
    sure = j.where(F.col("_sl") < F.col("_cut"))
    edge = j.where(F.col("_sl") == F.col("_cut")).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(c(by)).orderBy("_h", c(key))))
    edge = edge.where(F.col("_rn") <= F.col("_left")).drop("_rn")
    return sure.unionByName(edge).select(*[c(x) for x in df.columns])


def sample_info(df: DataFrame, sample: DataFrame, method: str) -> DataFrame:
    total, got = df.count(), sample.count()
    return df.sparkSession.createDataFrame(
        [(total, got, round(got / max(total, 1), 4), method)],
        "original_rows bigint, sample_rows bigint, sampling_ratio double, method string")


def plot_sample(df: DataFrame, key: str, k: int) -> DataFrame:
    """k rows for a plot: those whose keys have the smallest hashes, so every part of the key range shows."""
    return df.orderBy(F.md5(c(key).cast("string").cast("binary")), c(key)).limit(k)
