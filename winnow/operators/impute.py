"""Model-based imputation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import c, num, numeric_cols, require
from ..functions.stats import covariances, exact_quantiles, stats_row
from ..session import cut_lineage
from .clean import exact_type
from .neighbors import knn


def filled(df: DataFrame, column: str, value: Column) -> Column:
    """The column with its missing cells filled; integer and decimal columns keep their type and all values they have."""
    t = exact_type(df, column)
    if t is None:
        return F.coalesce(num(df, column), value)
    return F.coalesce(c(column), F.round(value, t.scale if isinstance(t, T.DecimalType) else 0).cast(t))


def knn_impute(df: DataFrame, column: str, key: str, cols: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Fill a number with the mean of its k nearest donors.

    Distances use the coordinates both rows have, scaled up for those they lack.  Rows are
    grouped by which coordinates they have; each pair of groups is one exact search over the
    shared coordinates, and the best k across the donor groups win."""
    require(df, column, key)
    cols = [n for n in (cols or numeric_cols(df)) if n not in (column, key)]
    x = {n: num(df, n) for n in cols}
    d = df.select(c(key).alias("_k"), num(df, column).alias("_y"), *[x[n].alias(n) for n in cols])
    mask = F.concat(*[F.when(c(n).isNotNull(), F.lit("1")).otherwise(F.lit("0")) for n in cols])
    d = d.withColumn("_m", mask)
    pats = d.groupBy("_m", F.col("_y").isNull().alias("_q")).agg(F.count(F.lit(1)).alias("_n")).collect()
    need = [r["_m"] for r in pats if r["_q"]]
    give = [r["_m"] for r in pats if not r["_q"]]
    mean = stats_row(d, {"m": F.avg("_y")})["m"]
    found = None
    for a in need:
        for b in give:
            shared = [n for n, i, j in zip(cols, a, b) if i == j == "1"]
            if not shared:
                continue
            q = d.where((F.col("_m") == a) & F.col("_y").isNull())
            s = d.where((F.col("_m") == b) & F.col("_y").isNotNull()).withColumnRenamed("_k", "_donor")
            nn = knn(q, s, "_k", "_donor", shared, k)
            part = nn.select("_k", F.col("neighbour"),
                             (F.col("distance") * F.lit(((len(cols) + 1) / len(shared)) ** 0.5)).alias("_d"))
            found = part if found is None else found.unionByName(part)
    if found is None:
        return df.withColumn(column, filled(df, column, F.lit(mean).cast("double")))
    best = found.groupBy("_k").agg(F.slice(F.array_sort(F.collect_list(F.struct("_d", "neighbour"))), 1, k).alias("_b"))
    near = best.select("_k", F.explode("_b").alias("_b")).select("_k", F.col("_b.neighbour").alias("_donor"))
    y = d.select(F.col("_k").alias("_donor"), "_y")
    val = near.join(y, "_donor").groupBy("_k").agg(F.avg("_y").alias("_v"))
    out = df.join(val.withColumnRenamed("_k", "_vk"), c(key) == F.col("_vk"), "left")
    return out.withColumn(column, filled(df, column, F.coalesce(F.col("_v"), F.lit(mean).cast("double")))).drop("_vk", "_v")


def least_squares(df: DataFrame, y: Column, xs: Sequence[Column]) -> tuple[float, list[float]]:
    """Intercept and slopes of y on xs over complete rows, from their means and covariances."""
    _, mean, cov = covariances(df, [y, *xs])
    m = np.array(cov)
    beta = np.linalg.lstsq(m[1:, 1:], m[1:, 0], rcond=None)[0]
    return mean[0] - float(np.dot(beta, mean[1:])), beta.tolist()


def _predict(start: float, beta: Sequence[float], xs: Sequence[Column]) -> Column:
    out = F.lit(start)
    for b, x in zip(beta, xs):
        out = out + F.lit(b) * x
    return out


def regression_impute(df: DataFrame, column: str, predictors: Sequence[str] | None = None) -> DataFrame:
    """Fill a number by linear regression on the others; predictors missing there count as their mean.

    Falls back to the median without predictors or with fewer than three complete rows."""
    require(df, column)
    preds = list(predictors or [n for n in numeric_cols(df) if n != column])
    y, xs = num(df, column), [num(df, n) for n in preds]
    whole = y.isNotNull()
    for x in xs:
        whole = whole & x.isNotNull()
    got = stats_row(df, {"n": F.count(F.when(whole, 1)), **{n: F.avg(x) for n, x in zip(preds, xs)}})
    if not preds or got["n"] < 3:
        med = exact_quantiles(df, [column], [0.5])[column][0]
        return df.withColumn(column, filled(df, column, F.lit(med).cast("double")))
    start, beta = least_squares(df.where(whole), y, xs)
    full = [F.coalesce(x, F.lit(got[n]).cast("double")) for n, x in zip(preds, xs)]
    return df.withColumn(column, filled(df, column, _predict(start, beta, full)))


def iterative_impute(df: DataFrame, columns: Sequence[str] | None = None, rounds: int = 10, tol: float = 1e-3, key: str | None = None) -> DataFrame:
    """Chained regressions: start from means, then refit every incomplete column on all others in turn.

    A fit is one aggregate; each round is materialised, so plans do not grow.  Stops early when
    no filled value moves by more than ``tol`` of the largest observed value.  Only missing cells change: complete columns and
    ``key``, which is no predictor, stay as they are, and integer and decimal columns keep their type and take rounded values."""
    cols = list(columns or [n for n in numeric_cols(df) if n != key])
    own = df.columns
    xs = {n: num(df, n) for n in cols}
    got = stats_row(df, {(k, n): f for n in cols for k, f in (
        ("m", F.avg(xs[n])), ("k", F.sum(F.when(xs[n].isNull(), 1).otherwise(0))), ("a", F.max(F.abs(xs[n]))))})
    todo = sorted((n for n in cols if got[("k", n)]), key=lambda n: got[("k", n)])
    if not todo:
        return df
    x = {n: f"_x_{n}" for n in cols}  # the numbers that are worked with; the columns themselves are filled at the end
    cur = df.withColumns({**{f"_gap_{n}": xs[n].isNull() for n in todo},
                          **{x[n]: F.coalesce(xs[n], F.lit(got[("m", n)]).cast("double")) for n in cols}})
    scale = max(got[("a", n)] or 0.0 for n in cols)
    for _ in range(rounds if len(cols) > 1 else 0):
        moved = []
        for n in todo:
            rest = [c(x[m]) for m in cols if m != n]
            start, beta = least_squares(cur.where(~c(f"_gap_{n}")), c(x[n]), rest)
            cur = cur.withColumns({f"_old_{n}": c(x[n]), x[n]: F.when(c(f"_gap_{n}"), _predict(start, beta, rest)).otherwise(c(x[n]))})
            moved.append(F.max(F.abs(c(x[n]) - c(f"_old_{n}"))))
        cur = cut_lineage(cur)
        step = stats_row(cur, {i: m for i, m in enumerate(moved)})
        cur = cur.drop(*[f"_old_{n}" for n in todo])
        if max(v or 0.0 for v in step.values()) < tol * scale:
            break
    return cur.withColumns({n: filled(df, n, c(x[n])) for n in todo}).select(*[c(n) for n in own])
