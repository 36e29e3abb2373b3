"""Projections: rename, drop, cast, merge, split, compute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import (c, count_if, flat_cols, is_missing, num, parse_number, require,
                              strip, text_cols)
from ..functions.dates import as_date, parse_date
from ..functions.stats import stats_row
from ..functions.text import word_count


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def rename_snake(df: DataFrame) -> DataFrame:
    """Replace blanks in all column names by underscores."""
    return df.toDF(*[n.replace(" ", "_") for n in df.columns])


def drop_column(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def change_dtype(df: DataFrame, column: str, to: str) -> DataFrame:
    """Cast to int, float, str or datetime; what cannot be read becomes NULL."""
    require(df, column)
    if to == "int":
        new = num(df, column).try_cast("bigint")
    elif to == "float":
        new = num(df, column)
    elif to == "str":
        new = c(column).cast("string")
    elif to == "datetime":
        new = as_date(df, column)
    else:
        raise ValueError(f"unknown type {to!r}")
    return df.withColumn(column, new)


def convert_types(df: DataFrame) -> DataFrame:
    """Cast text columns that are more than 90 % numeric, else more than 80 % dates."""
    cols = text_cols(df)
    aggs = {"n": F.count(F.lit(1))}
    for n in cols:
        aggs[("num", n)] = F.count(parse_number(c(n)))
        aggs[("date", n)] = F.count(parse_date(c(n)))
    got = stats_row(df, aggs)
    total = max(got["n"], 1)
    new = {}
    for n in cols:
        if got[("num", n)] / total > 0.9:
            new[n] = parse_number(c(n))
        elif got[("date", n)] / total > 0.8:
            new[n] = parse_date(c(n))
    return df.withColumns(new) if new else df


def empty_column_names(df: DataFrame, at_least: float = 80.0, sentinels: bool = True,
                       strict: bool = False) -> list[str]:
    cols = flat_cols(df)
    got = stats_row(df, {"n": F.count(F.lit(1)), **{n: count_if(is_missing(df, n, sentinels)) for n in cols}})
    pct = {n: got[n] * 100.0 / got["n"] if got["n"] else 0.0 for n in cols}
    return [n for n in cols if (pct[n] > at_least if strict else pct[n] >= at_least)]


def remove_empty_columns(df: DataFrame, at_least: float = 80.0, sentinels: bool = True,
                         strict: bool = False) -> DataFrame:
    """Drop columns with too many missing cells (sentinel strings count unless switched off)."""
    return df.drop(*empty_column_names(df, at_least, sentinels, strict))


def constant_column_names(df: DataFrame, null_is_value: bool = False) -> list[str]:
    """Columns with one distinct value: equal minimum and maximum, without a distinct pass."""
    cols = flat_cols(df)
    aggs = {}
    for n in cols:
        x = c(n)
        aggs[("lo", n)], aggs[("hi", n)], aggs[("k", n)] = F.min(x), F.max(x), F.count(x)
    got = stats_row(df, {"n": F.count(F.lit(1)), **aggs})
    out = []
    for n in cols:
        k, one = got[("k", n)], got[("lo", n)] == got[("hi", n)]
        if null_is_value:
            if k == 0 or (one and k == got["n"]):
                out.append(n)
        elif k > 0 and one:
            out.append(n)
    return out


def remove_constant_columns(df: DataFrame, null_is_value: bool = False) -> DataFrame:
    return df.drop(*constant_column_names(df, null_is_value))


def merge_columns(df: DataFrame, first: str, second: str, strategy: str, new: str) -> DataFrame:
    """Replace two columns by one: prefer_first, prefer_second, concatenate, sum or average."""
    require(df, first, second)
    a, b = c(first), c(second)
    if strategy == "prefer_second":
        merged = F.coalesce(b, a)
    elif strategy == "concatenate":
        both = F.concat(F.coalesce(a.cast("string"), F.lit("")), F.lit(" "), F.coalesce(b.cast("string"), F.lit("")))
        merged = F.nullif(strip(both), F.lit(""))
    elif strategy == "sum":
        merged = F.coalesce(num(df, first), F.lit(0.0)) + F.coalesce(num(df, second), F.lit(0.0))
    elif strategy == "average":
        x, y = num(df, first), num(df, second)
        merged = F.coalesce((x + y) / 2, x, y)
    else:
        merged = F.coalesce(a, b)
    keep = [c(n) for n in df.columns if n not in (first, second)]
    return df.select(*keep, merged.alias(new))


def concat_columns(df: DataFrame, columns: Sequence[str], sep: str, new: str) -> DataFrame:
    require(df, *columns)
    return df.withColumn(new, F.concat_ws(sep, *[F.coalesce(c(n).cast("string"), F.lit("")) for n in columns]))


def split_column(df: DataFrame, column: str, delimiter: str, names: Sequence[str]) -> DataFrame:
    """Split on a literal delimiter into at most ``len(names)`` trimmed parts, '' where absent."""
    import re

    require(df, column)
    parts = F.split(c(column).cast("string"), re.escape(delimiter), len(names))
    return df.withColumns({n: F.coalesce(strip(F.get(parts, F.lit(i))), F.lit("")) for i, n in enumerate(names)})


def calc_column(df: DataFrame, new: str, formula: str) -> DataFrame:
    """Add a column from a SQL expression over the others."""
    return df.withColumn(new, F.expr(formula))


_BINARY = {
    "add": lambda x, y: x + y,
    "subtract": lambda x, y: x - y,
    "multiply": lambda x, y: x * y,
    "divide": F.try_divide,
    "power": F.pow,
}


def non_negative(x: Column) -> Column:
    return F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))


def math_operation(df: DataFrame, column: str, operation: str, value: float | None = None,
                   other: str | None = None) -> DataFrame:
    """Arithmetic with a number or another column, or log / sqrt / abs in place."""
    require(df, column)
    x = num(df, column)
    if operation in _BINARY:
        if other is not None:
            y = num(df, other)
        elif value is not None:
            if operation == "divide" and value == 0:
                raise ValueError("cannot divide by zero")
            y = F.lit(float(value))
        elif operation == "power":
            y = F.lit(2.0)
        else:
            raise ValueError(f"{operation} needs a value or another column")
        return df.withColumn(column, _BINARY[operation](x, y))
    unary = {"log": lambda v: F.log1p(non_negative(v)), "sqrt": lambda v: F.sqrt(non_negative(v)), "abs": F.abs}
    if operation not in unary:
        raise ValueError(f"unsupported operation {operation!r}")
    return df.withColumn(column, unary[operation](x))


def ratio_feature(df: DataFrame, numerator: str, denominator: str, new: str | None = None) -> DataFrame:
    new = new or f"{numerator}_div_{denominator}"
    r = F.try_divide(num(df, numerator), F.nullif(num(df, denominator), F.lit(0.0)))
    return df.withColumn(new, F.coalesce(r, F.lit(0.0)))


def text_metrics(df: DataFrame, column: str) -> DataFrame:
    x = c(column).cast("string")
    return df.withColumns({f"{column}_char_length": F.length(x), f"{column}_word_count": word_count(x)})


def binary_column_names(df: DataFrame) -> list[str]:
    """Numeric columns that hold nothing but 0 and 1."""
    from ..functions.core import numeric_cols

    cols = numeric_cols(df)
    got = stats_row(df, {(k, n): f for n in cols for k, f in (
        ("seen", F.count(num(df, n))), ("other", count_if(~num(df, n).isin(0.0, 1.0))))})
    return [n for n in cols if got[("seen", n)] and not got[("other", n)]]


def cast_bool(df: DataFrame, column: str) -> DataFrame:
    """0/1 column to boolean, refusing any other value."""
    if column not in binary_column_names(df.select(c(column))):
        raise ValueError(f"{column} holds values other than 0 and 1")
    return df.withColumn(column, c(column).cast("boolean"))


