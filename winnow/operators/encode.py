"""Categorical encoders.  Dictionaries are tables; a look-up is a join."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import c, num, require
from ..functions.keys import apply_map
from ..functions.stats import distinct_counts, few_values, stats_row
from ..session import cut_lineage

ONEHOT_LIMIT = 1000
ONE_TASK_VALUES = 200_000


def sorted_index(values: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Number the (distinct) values 0.. in sort order.

    Up to a counted size one task numbers them.  Beyond it the values are range-sorted and
    materialised, and each sorted partition is shifted by the sizes of those before it."""
    n = values.count()
    if n <= ONE_TASK_VALUES:
        return values.withColumn(out, F.row_number().over(Window.orderBy(c(column))).cast("bigint") - 1)
    s = cut_lineage(values.orderBy(c(column)).withColumn("_m", F.monotonically_increasing_id()))
    s = s.withColumn("_p", F.shiftright("_m", 33))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    offs = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    low = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return s.join(F.broadcast(offs), "_p").withColumn(out, (low + F.col("_o")).cast("bigint")).drop("_m", "_p", "_o")


def _filled(df: DataFrame, column: str):
    return F.coalesce(c(column).cast("string"), F.lit("Missing"))


def label_map(df: DataFrame, column: str) -> DataFrame:
    """(value, rows, code): codes follow the sorted values, NULL counts as 'Missing'."""
    vc = df.groupBy(_filled(df, column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return sorted_index(vc, "value")


def encode_label(df: DataFrame, column: str, mapping: DataFrame | None = None) -> DataFrame:
    require(df, column)
    mapping = label_map(df, column) if mapping is None else mapping
    order = df.columns
    d = apply_map(df.withColumn("_v", _filled(df, column)), "_v", mapping, "value", "code", "rows", column)
    return d.drop("_v").select(*[c(n) for n in order])


def encode_ordinal(df: DataFrame, column: str, mapping: DataFrame | None = None) -> DataFrame:
    """Label codes as doubles; a value the mapping does not know becomes -1."""
    d = encode_label(df, column, mapping)
    return d.withColumn(column, F.coalesce(c(column).cast("double"), F.lit(-1.0)))


def encode_binary(df: DataFrame, column: str) -> DataFrame:
    """Label code as bit columns, lowest bit first."""
    mapping = label_map(df, column)
    top = stats_row(mapping, {"m": F.max("code")})["m"] or 0
    bits = max(1, math.ceil(math.log2(top + 1))) if top > 0 else 1
    d = encode_label(df, column, mapping)
    d = d.withColumns({f"{column}_bin_{b}": F.getbit(c(column), F.lit(b)).cast("int") for b in range(bits)})
    return d.drop(column)


def encode_onehot(df: DataFrame, column: str, drop_first: bool = True, limit: int = ONEHOT_LIMIT) -> DataFrame:
    """0/1 column per sorted category (the first dropped); refuses more than ``limit`` categories."""
    require(df, column)
    vals = few_values(df, [column], limit)[column]
    if vals is None:
        raise ValueError(f"{column} has more than {limit} categories; use frequency or target encoding")
    x = c(column).cast("string")
    new = {f"{column}_{v}": F.coalesce((x == v).cast("int"), F.lit(0)) for v in vals[1 if drop_first else 0:]}
    out = df.withColumns(new) if new else df
    return out.drop(column)


def encode_frequency(df: DataFrame, column: str, out: str | None = None, keep_null: bool = False) -> DataFrame:
    """Share of each value among the non-null ones; NULL becomes 0 unless kept."""
    require(df, column)
    total = stats_row(df, {"n": F.count(c(column))})["n"]
    vc = df.where(c(column).isNotNull()).groupBy(c(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    vc = vc.withColumn("share", F.col("rows") / F.lit(float(max(total, 1))))
    d = apply_map(df, column, vc, "value", "share", "rows", out or column)
    return d if keep_null else d.withColumn(out or column, F.coalesce(c(out or column), F.lit(0.0)))


def encode_target(df: DataFrame, column: str, target: str) -> DataFrame:
    """Mean target per value; NULL or unseen values get the global mean."""
    require(df, column, target)
    y = num(df, target)
    mean = stats_row(df, {"m": F.avg(y)})["m"]
    vc = df.where(c(column).isNotNull()).groupBy(c(column).alias("value")).agg(
        F.avg(y).alias("mean"), F.count(F.lit(1)).alias("rows"))
    d = apply_map(df, column, vc, "value", "mean", "rows", column)
    return d.withColumn(column, F.coalesce(c(column), F.lit(mean)))


def encode_auto(df: DataFrame, column: str) -> DataFrame:
    """One-hot up to ten categories, frequency beyond."""
    few = distinct_counts(df, [column])[column] <= 10
    return encode_onehot(df, column) if few else encode_frequency(df, column, keep_null=True)
