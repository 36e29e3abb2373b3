"""Feature scaling with fitted parameters kept as a small table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import c, num, require
from ..functions.stats import exact_quantiles, rows_to_df, stats_row
from .columns import non_negative

PARAM_SCHEMA = "column string, method string, fill double, center double, scale double"
FITTED = ("minmax", "standard", "robust")


def fit_scaler(df: DataFrame, columns: Sequence[str], method: str) -> list[tuple]:
    """(column, method, fill, center, scale); missing values count as the median."""
    require(df, *columns)
    method = method.lower()
    if method in ("log", "sqrt"):
        return [(n, method, 0.0, 0.0, 1.0) for n in columns]
    if method not in FITTED:
        raise ValueError(f"unknown scaling method {method!r}")
    med = {n: q[0] for n, q in exact_quantiles(df, columns, [0.5]).items()}
    filled = {n: F.coalesce(num(df, n), F.lit(med[n]).cast("double")) for n in columns}
    if method == "robust":
        qs = exact_quantiles(df, filled, [0.25, 0.5, 0.75])
        cs = {n: (q[1], q[2] - q[0]) if q[1] is not None else (None, None) for n, q in qs.items()}
    elif method == "minmax":
        got = stats_row(df, {(k, n): f(filled[n]) for n in columns for k, f in (("lo", F.min), ("hi", F.max))})
        cs = {n: (got[("lo", n)], got[("hi", n)] - got[("lo", n)]) if got[("lo", n)] is not None else (None, None) for n in columns}
    else:
        got = stats_row(df, {(k, n): f(filled[n]) for n in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))})
        cs = {n: (got[("m", n)], got[("s", n)]) for n in columns}
    # a column without a value stays NULL, under neutral parameters
    return [(n, method, med[n], float(cs[n][0] or 0.0), float(cs[n][1] or 0.0) or 1.0) for n in columns]


def scaled(df: DataFrame, param: tuple) -> Column:
    n, method, fill, center, scale = param
    x = num(df, n)
    if method == "log":
        return F.log1p(non_negative(x))
    if method == "sqrt":
        return F.sqrt(non_negative(x))
    return (F.coalesce(x, F.lit(fill).cast("double")) - F.lit(center)) / F.lit(scale)


def scale(df: DataFrame, params: list[tuple]) -> DataFrame:
    return df.withColumns({p[0]: scaled(df, p) for p in params})


def scale_features(df: DataFrame, columns: Sequence[str], method: str) -> tuple[DataFrame, list[tuple]]:
    params = fit_scaler(df, columns, method)
    return scale(df, params), params


def inverse_scale(df: DataFrame, params: list[tuple]) -> DataFrame:
    def back(p):
        n, method, _, center, s = p
        if method == "log":
            return F.expm1(c(n))
        if method == "sqrt":
            return c(n) * c(n)
        return c(n) * F.lit(s) + F.lit(center)

    return df.withColumns({p[0]: back(p) for p in params})


def params_table(df: DataFrame, params: list[tuple]) -> DataFrame:
    return rows_to_df(df.sparkSession, params, PARAM_SCHEMA)
