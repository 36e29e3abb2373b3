"""Attaching per-key results to rows without piling a hot key onto one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .core import c
from .stats import plain_join_ok, stats_row

HOT_KEYS = 1000          # a key above 1/HOT_KEYS of all rows is hot, so fewer than this many exist
BROADCAST_KEYS = 200_000  # lookups with no more keys and measured bytes than these are broadcast whole
BROADCAST_BYTES = 64 << 20
SALTS = 256


def attach(df: DataFrame, lookup: DataFrame, on: Sequence[str], n_col: str, null_safe: bool = False) -> DataFrame:
    """Left-join ``lookup`` (one row per key, ``n_col`` = rows of that key) onto ``df``.

    Few keys: the lookup is broadcast after its rows and bytes have been counted.  Many keys: hot
    ones, fewer than HOT_KEYS by construction, are resolved by broadcast and their rows
    are salted over all partitions for the shuffled join of the remaining keys.
    ``n_col`` is dropped from the result.
    """
    on = list(on)
    extra = [n for n in lookup.columns if n not in on and n != n_col]
    right = lookup.select(*[c(k).alias(f"_k{i}") for i, k in enumerate(on)],
                          *[c(n) for n in extra], c(n_col).alias("_attached_rows"))

    def cond(left, r, more=None):
        out = more
        for i, k in enumerate(on):
            eq = left[k].eqNullSafe(r[f"_k{i}"]) if null_safe else left[k] == r[f"_k{i}"]
            out = eq if out is None else out & eq
        return out

    keys = [f"_k{i}" for i in range(len(on))]
    if plain_join_ok(lookup):
        return df.join(right, cond(df, right), "left").drop(*keys, "_attached_rows")
    # used three times below: aggregate once, then read the result.  The salt column is stored with
    # it, because the optimizer would fold a literal out of the join key and undo the spreading.
    right = cut_lineage(right.withColumn("_ks", F.lit(0)))
    got = stats_row(right, {"keys": F.count(F.lit(1)), "rows": F.sum("_attached_rows"), "bytes": F.sum(F.length(F.to_json(F.struct("*"))))})
    if got["keys"] <= BROADCAST_KEYS and (got["bytes"] or 0) <= BROADCAST_BYTES:
        return df.join(F.broadcast(right), cond(df, right), "left").drop(*keys, "_attached_rows", "_ks")
    floor = got["rows"] // HOT_KEYS
    hot = right.where(F.col("_attached_rows") > floor)
    hot = hot.select(*[F.col(k) for k in keys], F.struct(*[c(n) for n in extra]).alias("_hot"))
    warm = right.where(F.col("_attached_rows") <= floor).select(
        *[F.col(k) for k in keys], F.struct(*[c(n) for n in extra]).alias("_warm"), F.col("_ks"))
    left = df.join(F.broadcast(hot), cond(df, hot), "left").drop(*keys)
    spread = F.col("_hot").isNotNull()
    if not null_safe:
        for k in on:
            spread = spread | c(k).isNull()
    salt = F.lit(1) + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    left = left.withColumn("_salt", F.when(spread, salt).otherwise(F.lit(0)))
    joined = left.join(warm, cond(left, warm, left["_salt"] == warm["_ks"]), "left")
    return joined.select(*[c(n) for n in df.columns],
                         *[F.coalesce(F.col("_hot"), F.col("_warm"))[n].alias(n) for n in extra])


def apply_map(df: DataFrame, column: str, mapping: DataFrame, key: str, value: str, n_col: str, out: str) -> DataFrame:
    """Look each cell up in a (key, value, rows) table and store the result in ``out``."""
    small = mapping.select(c(key).alias("_mk"), c(value).alias("_mv"), c(n_col).alias("_mn"))
    tmp = df.withColumn("_mk", c(column))
    got = attach(tmp, small, ["_mk"], "_mn")
    return got.withColumn(out, F.col("_mv")).drop("_mk", "_mv")
