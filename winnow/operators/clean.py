"""Cleaning: duplicates, missing values, outliers, text and date standardisation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import (c, count_if, dtype, flat_cols, is_missing, is_numeric, is_text, num,
                              numeric_cols, present, require, strip, text_cols)
from ..functions.dates import as_date, parse_date, strftime_to_java
from ..functions.gather import together
from ..functions.keys import attach
from ..functions.stats import column_modes, exact_quantiles, stats_row, value_stats
from ..functions.text import TEXT_OPS, apply_case, collapse_spaces
from ..session import text_batches


# ---------------------------------------------------------------- duplicates

def remove_duplicates(df: DataFrame, subset: Sequence[str] | None = None, key: str | None = None) -> DataFrame:
    """Keep one row per distinct ``subset``; with ``key``, the row with the smallest key survives.

    The survivor is picked by a partially aggregated minimum, not by a window over the group."""
    if key is None:
        return df.dropDuplicates(list(subset) if subset else None)
    subset = list(subset or [n for n in df.columns if n != key])
    rest = [n for n in df.columns if n not in subset]
    # an ordering that is never NULL: rows without a key come last, and keep all their values
    best = df.groupBy(*[c(n) for n in subset]).agg(
        F.min_by(F.struct(*[c(n) for n in rest]), F.struct(c(key).isNull(), c(key))).alias("_b"))
    return best.select(*[c(n) if n in subset else F.col("_b")[n].alias(n) for n in df.columns])


def row_digest(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """128 hash bits of a row plus which cells are NULL (the hash skips those): a short stand-in for
    whole rows where only their equality matters, so that a wide table is not shuffled."""
    xs = [F.when(~F.isnan(c(n)), c(n) + F.lit(0.0)) if isinstance(dtype(df, n), (T.FloatType, T.DoubleType)) else c(n)
          for n in cols]  # -0.0 is 0.0, NaN is missing
    gaps = [F.concat(*[F.when(x.isNull(), F.lit("1")).otherwise(F.lit("0")) for x in xs])]
    return [F.xxhash64(F.lit(1), *xs).alias("_h1"), F.xxhash64(F.lit(2), *xs).alias("_h2"), F.xxhash64(*gaps).alias("_h3")]


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> int:
    """Rows beyond the first of each distinct row (NULLs equal each other)."""
    cols = list(subset) if subset else flat_cols(df)
    return value_stats(df, {"row": F.struct(*row_digest(df, cols))})["row"].extra


def duplicate_flag(df: DataFrame, subset: Sequence[str], key: str, out: str = "is_duplicate") -> DataFrame:
    """True for every row after the first (by key) of its group; rows without a key come last, and in a group
    without any key no row is told apart, so none is flagged."""
    g = df.groupBy(*[c(n) for n in subset]).agg(F.min(c(key)).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    j = attach(df, g, subset, "_rows", null_safe=True)
    return j.withColumn(out, ~c(key).eqNullSafe(F.col("_first"))).drop("_first")


def duplicate_members(df: DataFrame, subset: Sequence[str], out: str = "is_member") -> DataFrame:
    """True for every row whose values occur more than once."""
    g = df.groupBy(*[c(n) for n in subset]).agg(F.count(F.lit(1)).alias("_rows"))
    g = g.withColumn("_many", F.col("_rows") > 1)
    return attach(df, g, subset, "_rows", null_safe=True).withColumnRenamed("_many", out)


# ---------------------------------------------------------------- missing values

def exact_type(df: DataFrame, column: str) -> T.DataType | None:
    """The type of an integer or decimal column, whose values a double may not hold exactly."""
    t = dtype(df, column)
    return t if isinstance(t, (T.IntegralType, T.DecimalType)) else None


def _numeric_fill(df: DataFrame, column: str, value: float | None) -> Column:
    """Present values as they are; integer and decimal columns keep their type and take the rounded value."""
    t = exact_type(df, column)
    if t is None:
        return F.coalesce(num(df, column), F.lit(value).cast("double"))
    digits = t.scale if isinstance(t, T.DecimalType) else 0
    return F.coalesce(c(column), F.round(F.lit(value).cast("double"), digits).cast(t))


def fill_missing(df: DataFrame, column: str, method: str = "auto", value=None, sentinels: bool = True) -> DataFrame:
    """Fill one column: mean, median, mode, custom_value or auto (mean for numbers, mode otherwise)."""
    require(df, column)
    numeric = is_numeric(df, column)
    if method not in ("mean", "median", "mode", "custom_value", "auto"):
        raise ValueError(f"unknown method {method!r}")
    if method == "custom_value":
        if value is None:
            return df
        if numeric:
            return df.withColumn(column, F.coalesce(c(column) if exact_type(df, column) else num(df, column),
                                                    F.lit(str(value)).try_cast(exact_type(df, column) or "double")))
        return df.withColumn(column, F.coalesce(present(df, column, sentinels), F.lit(value)))
    if numeric and method in ("mean", "auto"):
        got = stats_row(df, {"m": F.avg(num(df, column)), "k": count_if(num(df, column).isNull())})
        return df.withColumn(column, _numeric_fill(df, column, got["m"])) if got["k"] else df
    if numeric and method == "median":
        return df.withColumn(column, _numeric_fill(df, column, exact_quantiles(df, [column], [0.5])[column][0]))
    m = column_modes(df, {column: present(df, column, sentinels)})[column]
    if m is None:
        return df
    return df.withColumn(column, F.coalesce(present(df, column, sentinels), F.lit(m)))


def fill_plan(df: DataFrame, sentinels: bool = True) -> tuple[dict[str, Column], int]:
    """Expressions that fill every column with missing cells, and how many cells they fill."""
    cols = flat_cols(df)
    aggs = {("k", n): count_if(is_missing(df, n, sentinels)) for n in cols}
    aggs.update({("m", n): F.avg(num(df, n)) for n in numeric_cols(df)})
    got = stats_row(df, aggs)
    need = [n for n in cols if got[("k", n)]]
    modes = column_modes(df, {n: present(df, n, sentinels) for n in need if not is_numeric(df, n)})
    out, filled = {}, 0
    for n in need:
        if is_numeric(df, n):
            if got[("m", n)] is None:
                continue
            out[n] = _numeric_fill(df, n, got[("m", n)])
        else:
            if modes[n] is None:
                continue
            out[n] = F.coalesce(present(df, n, sentinels), F.lit(modes[n]))
        filled += got[("k", n)]
    return out, filled


def fill_all_missing(df: DataFrame, sentinels: bool = True) -> DataFrame:
    """Mean for numbers, mode for everything else, over all columns with two stats jobs."""
    exprs, _ = fill_plan(df, sentinels)
    return df.withColumns(exprs) if exprs else df


# ---------------------------------------------------------------- outliers

@dataclass(frozen=True)
class Fence:
    q1: float
    median: float
    q3: float
    lower: float
    upper: float
    tol: float
    cap_lower: float
    cap_upper: float

    @property
    def iqr(self) -> float:
        return self.q3 - self.q1


def fences(df: DataFrame, columns: Sequence[str], factor: float = 1.5, fallback: bool = True) -> dict[str, Fence]:
    """Outlier fences per column: quartiles ± factor·IQR.

    With ``fallback``, a zero IQR switches to median ± 3·1.4826·MAD, and a zero MAD to the
    median itself; a column with a single value has no fence."""
    qs = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    flat = [n for n in columns if qs[n][0] is not None and qs[n][0] == qs[n][2]]
    mads, ends = together(
        lambda: exact_quantiles(df, {n: F.abs(num(df, n) - qs[n][1]) for n in flat}, [0.5]),
        lambda: stats_row(df, {(k, n): f(num(df, n)) for n in flat for k, f in (("lo", F.min), ("hi", F.max))})) \
        if flat and fallback else ({}, {})
    out: dict[str, Fence] = {}
    for n in columns:
        q1, m, q3 = qs[n]
        if q1 is None:
            continue
        iqr = q3 - q1
        if iqr > 0 or not fallback:
            lo, hi, unit = q1 - factor * iqr, q3 + factor * iqr, iqr
            tol, step = 1e-9 * unit, 1e-5 * unit
        else:
            mad = mads[n][0]
            if mad and mad > 0:
                lo, hi = m - 3.0 * 1.4826 * mad, m + 3.0 * 1.4826 * mad
                tol, step = 1e-9 * mad, 1e-5 * mad
            elif ends[("lo", n)] != ends[("hi", n)]:
                lo = hi = m
                tol, step = 1e-9, 1e-7
            else:
                continue
        out[n] = Fence(q1, m, q3, lo, hi, tol, lo + step, hi - step)
    return out


def below(x: Column, f: Fence) -> Column:
    return x < f.lower - f.tol


def above(x: Column, f: Fence) -> Column:
    return x > f.upper + f.tol


def is_outlier(x: Column, f: Fence) -> Column:
    return F.coalesce(below(x, f) | above(x, f), F.lit(False))


def fix_outliers(df: DataFrame, column: str, method: str = "cap", exact_clip: bool = False,
                 fence: Fence | None = None) -> DataFrame:
    """cap (just inside the fence, or exactly at it), impute/median, mean, or remove."""
    require(df, column)
    f = fence or fences(df, [column], fallback=not exact_clip).get(column)
    if f is None:
        return df
    x = num(df, column)
    if method == "remove":
        return df.where(~is_outlier(x, f))
    if method == "cap":
        if exact_clip:
            new = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(f.lower)), F.lit(f.upper)))
        else:
            new = F.when(below(x, f), F.lit(f.cap_lower)).when(above(x, f), F.lit(f.cap_upper)).otherwise(x)
    elif method in ("impute", "median"):
        new = F.when(is_outlier(x, f), F.lit(f.median)).otherwise(x)
    elif method == "mean":
        mean = stats_row(df, {"m": F.avg(x)})["m"]
        new = F.when(is_outlier(x, f), F.lit(mean)).otherwise(x)
    else:
        raise ValueError(f"unknown method {method!r}")
    t = exact_type(df, column)
    if t is not None:  # caps of integers are rounded inward, of decimals to their scale; all other values stay what they are
        up, down = (F.ceil(new).cast(t), F.floor(new).cast(t)) if isinstance(t, T.IntegralType) else (new.cast(t), new.cast(t))
        new = F.when(below(x, f), up).when(above(x, f), down).otherwise(c(column))
    return df.withColumn(column, new)


def cap_all_outliers(df: DataFrame, columns: Sequence[str] | None = None, method: str = "cap") -> DataFrame:
    """fix_outliers on every numeric column.

    Capping and imputing leave other columns alone, so one quantile pass serves all columns;
    removing rows changes the next column's quartiles and stays sequential."""
    cols = list(columns or numeric_cols(df))
    if method == "remove":
        for n in cols:
            df = fix_outliers(df, n, "remove")
        return df
    fs = fences(df, cols)
    for n, f in fs.items():
        df = fix_outliers(df, n, method, fence=f)
    return df


def winsorize(df: DataFrame, column: str, low: float = 0.05, high: float = 0.05, ranks: bool = False) -> DataFrame:
    """Clip at the low and 1-high percentiles.  With ``ranks``, at the order statistics that
    leave floor(n·low) and floor(n·high) values outside.  Needs five values."""
    require(df, column)
    x = num(df, column)
    n = stats_row(df, {"n": F.count(x)})["n"]
    if n < 5:
        return df
    ps = [low, 1.0 - high]
    if ranks:
        ps = [int(n * low) / (n - 1), (n - 1 - int(n * high)) / (n - 1)]
    lo, hi = exact_quantiles(df, [column], ps)[column]
    t = exact_type(df, column)
    if t is None:
        return df.withColumn(column, F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi))))
    low_cap, high_cap = (F.ceil(F.lit(lo)), F.floor(F.lit(hi))) if isinstance(t, T.IntegralType) else (F.lit(lo), F.lit(hi))
    return df.withColumn(column, F.when(x < lo, low_cap.cast(t)).when(x > hi, high_cap.cast(t)).otherwise(c(column)))


# ---------------------------------------------------------------- text

def changed_cells(df: DataFrame, new: dict[str, Column]) -> int:
    got = stats_row(df, {n: count_if(~c(n).eqNullSafe(x)) for n, x in new.items()}) if new else {}
    return sum(got.values())


def trim_plan(df: DataFrame, column: str | None = None) -> dict[str, Column]:
    return {n: strip(c(n)) for n in ([column] if column else text_cols(df)) if is_text(df, n)}


def trim_whitespace(df: DataFrame, column: str | None = None) -> DataFrame:
    new = trim_plan(df, column)
    return df.withColumns(new) if new else df


def case_plan(df: DataFrame, column: str | None = None, case: str = "lower") -> dict[str, Column]:
    return {n: apply_case(c(n), case) for n in ([column] if column else text_cols(df))}


def standardize_case(df: DataFrame, column: str | None = None, case: str = "lower") -> DataFrame:
    new = case_plan(df, column, case)
    return df.withColumns(new) if new else df


def standardize_text(df: DataFrame, column: str | None = None) -> DataFrame:
    """Trim and collapse inner whitespace."""
    return df.withColumns({n: collapse_spaces(c(n)) for n in ([column] if column else text_cols(df))})


def clean_text(df: DataFrame, column: str, operations: Sequence[str]) -> DataFrame:
    """Apply text operations in the given order."""
    require(df, column)
    text_batches(df.sparkSession)
    x = c(column).cast("string")
    for op in operations:
        x = TEXT_OPS[op.lower().strip()](x)
    return df.withColumn(column, x)


def map_categories(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    require(df, column)
    return df.replace(mapping, subset=[column])


# ---------------------------------------------------------------- dates

def convert_dates(df: DataFrame, column: str, fmt: str = "%Y-%m-%d") -> DataFrame:
    """Rewrite dates in one format; text that is no date stays, missing becomes NULL."""
    require(df, column)
    x = present(df, column)
    ts = parse_date(x) if is_text(df, column) else as_date(df, column)
    return df.withColumn(column, F.coalesce(F.date_format(ts, strftime_to_java(fmt)), x.cast("string")))


def parse_dates_report(df: DataFrame, column: str) -> DataFrame:
    """converted, failed and up to five failing samples (smallest values)."""
    require(df, column)
    x = c(column).cast("string")
    given = x.isNotNull() & (strip(x) != "")
    parsed = parse_date(x)
    bad = given & parsed.isNull()
    got = stats_row(df, {"ok": count_if(given & parsed.isNotNull()), "bad": count_if(bad)})
    samples = df.where(bad).select(x.alias("v")).distinct().orderBy("v").limit(5)
    rows = [r["v"] for r in samples.collect()]
    return df.sparkSession.createDataFrame([(got["ok"], got["bad"], ", ".join(rows))],
                                           "converted_count bigint, failed_count bigint, failed_samples string")


