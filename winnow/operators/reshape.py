"""Grouping, pivoting, melting, transposing, binning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import c, is_numeric, num, require
from ..functions.stats import exact_quantiles, few_values, grouped_quantiles, stats_row, value_counts

AGGS = ("sum", "mean", "count", "min", "max", "std", "median", "nunique")
PIVOT_LIMIT = 10_000


def _agg(df: DataFrame, column: str, func: str) -> Column:
    x = c(column)
    return {
        "sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max,
        "std": F.stddev_samp, "nunique": F.count_distinct,
    }[func](x)


def group_agg(df: DataFrame, by: str | Sequence[str], aggs: dict[str, Sequence[str]]) -> DataFrame:
    """Group and aggregate; results are named ``<column>_<function>``; rows with a NULL key are dropped."""
    by = [by] if isinstance(by, str) else list(by)
    require(df, *by, *aggs)
    bad = {f for fs in aggs.values() for f in fs} - set(AGGS)
    if bad:
        raise ValueError(f"unknown aggregation {sorted(bad)}")
    src = df.dropna(subset=by)
    plain = [_agg(df, n, f).alias(f"{n}_{f}") for n, fs in aggs.items() for f in fs if f != "median"]
    out = src.groupBy(*[c(n) for n in by]).agg(*(plain or [F.count(F.lit(1)).alias("_n")]))
    for n, fs in aggs.items():
        if "median" in fs:
            q = grouped_quantiles(src, by, num(df, n), [0.5])
            out = out.join(q.select(*[c(k) for k in by], F.col("q")[0].alias(f"{n}_median")), by, "left")
    return out.select(*[c(k) for k in by], *[c(f"{n}_{f}") for n, fs in aggs.items() for f in fs])


def pivot_table(df: DataFrame, index: str | Sequence[str], columns: str, value: str, func: str = "mean") -> DataFrame:
    """Spread ``func(value)`` over the distinct values of ``columns``; empty cells are 0.

    Aggregates to one row per cell first, then pivots those."""
    index = [index] if isinstance(index, str) else list(index)
    if func not in ("sum", "mean", "count", "min", "max", "std", "median"):
        func = "mean"
    vals = few_values(df, [columns], PIVOT_LIMIT)[columns]
    if vals is None:
        raise ValueError(f"{columns} has more than {PIVOT_LIMIT} distinct values")
    cells = group_agg(df, [*index, columns], {value: [func]})
    wide = cells.withColumn("_p", c(columns).cast("string")).groupBy(*[c(n) for n in index]) \
        .pivot("_p", vals).agg(F.first(c(f"{value}_{func}")))
    return wide.fillna(0, subset=vals)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var_name: str = "variable",
         value_name: str = "value") -> DataFrame:
    return df.unpivot([c(n) for n in ids], [c(n) for n in values], var_name, value_name)


def transpose_small(df: DataFrame, key: str) -> DataFrame:
    """Rows become columns named by ``key``; bounded by spark.sql.transposeMaxValues."""
    return df.transpose(c(key))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10, normalize: bool = False) -> DataFrame:
    """The k most frequent values per column (smallest value first on ties).

    Values are counted before they are ranked, and the rank filter keeps k rows per column in
    each partition before the shuffle."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    out = (value_counts(df, columns).withColumn("_r", F.row_number().over(w))
           .where(F.col("_r") <= k).drop("_r"))
    if normalize:
        got = stats_row(df, {n: F.count(c(n)) for n in columns})
        total = F.create_map(*[F.lit(v) for n in columns for v in (n, float(max(got[n], 1)))])
        out = out.withColumn("share", F.round(F.col("n") / F.element_at(total, F.col("column")), 6))
    return out


# ---------------------------------------------------------------- histogram and bins

def _edges(lo: float, hi: float, bins: int) -> list[float]:
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return [float(x) for x in np.linspace(lo, hi, bins + 1)]


def bin_index(x: Column, edges: Sequence[float], right: bool = False) -> Column:
    """Index of the interval holding x: [e, f) with a closed last one, or (e, f] with a closed first one."""
    k = len(edges) - 1
    out = None
    if right:
        cond = x < edges[0]
        out = F.when(cond, F.lit(None).cast("int"))
        for i in range(k):
            out = out.when(x <= edges[i + 1], F.lit(i))
        return F.when(x.isNotNull(), out)
    out = F.when((x < edges[0]) | (x > edges[-1]), F.lit(None).cast("int"))
    for i in range(k - 1):
        out = out.when(x < edges[i + 1], F.lit(i))
    return F.when(x.isNotNull(), out.otherwise(F.lit(k - 1)))


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Equal-width bins over the range, empty ones included: (bin, bin_start, bin_end, n).

    Without ``bins``: at most ten, at least two, no more than there are distinct values.  Infinite values lie in no
    bin; ``infinite_values`` counts them."""
    x = num(df, column)
    x = F.when(F.abs(x) < float("inf"), x)
    got = stats_row(df, {"lo": F.min(x), "hi": F.max(x), "u": F.approx_count_distinct(x)})
    if got["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, bin_end double, n bigint")
    if bins is None:
        # only a handful of values is counted exactly
        few = 10 if got["u"] > 40 else df.select(F.count_distinct(x)).first()[0]
        bins = min(10, max(2, few))
    e = _edges(got["lo"], got["hi"], bins)
    counts = df.select(bin_index(x, e).alias("bin")).where("bin is not null") \
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.createDataFrame([(i, e[i], e[i + 1]) for i in range(bins)],
                                            "bin int, bin_start double, bin_end double")
    return spine.join(counts, "bin", "left").select(
        "bin", "bin_start", "bin_end", F.coalesce("n", F.lit(0)).alias("n"))


def infinite_values(df: DataFrame, column: str) -> DataFrame:
    """(below, above): how many values are negative and positive infinity."""
    x = num(df, column)
    return df.agg(F.count(F.when(x == float("-inf"), 1)).alias("below"), F.count(F.when(x == float("inf"), 1)).alias("above"))


def bin_edges(df: DataFrame, column: str, method: str, bins) -> list[float]:
    """Edges of (lo, hi] intervals: equal_width, equal_frequency or the given ones."""
    if method == "custom":
        return [float(b) for b in bins]
    if method == "equal_frequency":
        qs = exact_quantiles(df, [column], [i / bins for i in range(bins + 1)])[column]
        return sorted(set(qs))
    if method != "equal_width":
        raise ValueError(f"unknown method {method!r}")
    x = num(df, column)
    got = stats_row(df, {"lo": F.min(x), "hi": F.max(x)})
    lo, hi = got["lo"], got["hi"]
    if lo == hi:
        lo -= 0.001 * abs(lo) if lo else 0.001
        hi += 0.001 * abs(hi) if hi else 0.001
        return [float(v) for v in np.linspace(lo, hi, bins + 1)]
    e = [float(v) for v in np.linspace(lo, hi, bins + 1)]
    e[0] -= (hi - lo) * 0.001
    return e


def interval_labels(edges: Sequence[float]) -> list[str]:
    """Interval names as pandas prints them, from the (few) edges."""
    return [str(i) for i in pd.cut(pd.Series([], dtype="float64"), bins=list(edges), include_lowest=True).cat.categories]


def bin_numeric(df: DataFrame, column: str, method: str = "equal_width", bins=5,
                labels: Sequence[str] | None = None) -> DataFrame:
    """Add ``<column>_bin`` (index) and ``<column>_binned`` (label)."""
    require(df, column)
    e = bin_edges(df, column, method, bins)
    names = list(labels) if labels else interval_labels(e)
    idx = bin_index(num(df, column), e, right=True)
    out = df.withColumn(f"{column}_bin", idx)
    return out.withColumn(f"{column}_binned", F.get(F.array(*[F.lit(n) for n in names]), c(f"{column}_bin")))


def concat_tables(first: DataFrame, second: DataFrame, origin: str | None = None) -> DataFrame:
    """The rows of both tables, columns matched by name; a column that one lacks is NULL there.

    A column that both have under different types takes the wider one of numbers and text otherwise, and ``origin`` names a column
    that says where a row comes from (0 or 1)."""
    a, b = dict(first.dtypes), dict(second.dtypes)

    def shaped(df: DataFrame, other: dict[str, str], side: int) -> DataFrame:
        cells = [c(n) if other.get(n, t) == t or (is_numeric(first, n) and is_numeric(second, n)) else c(n).cast("string").alias(n)
                 for n, t in df.dtypes]
        return df.select(*cells, *([F.lit(side).alias(origin)] if origin else []))

    return shaped(first, b, 0).unionByName(shaped(second, a, 1), allowMissingColumns=True)
