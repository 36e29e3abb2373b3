"""Anomaly detectors and their repairs.

Detectors return findings (type, severity, column, count, example); ``flags`` gives the rows of the row-wise ones,
``all_flags`` those of every detector.
Examples are the smallest offending value, so results do not depend on row order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import (BUSINESS_WORDS, DATE_WORDS, EMAIL_WORDS, FUTURE_OK_WORDS, ID_WORDS, PERCENT_WORDS_WIDE,
                              POSITIVE_WORDS_WIDE, c, count_if, flat_cols, is_date, name_has, num, numeric_cols,
                              require, text_cols)
from ..functions.dates import as_date, parse_date
from ..functions.gather import shared, together
from ..functions.keys import attach
from ..functions.pii import EMAIL_QUALITY
from ..functions.stats import (as_text, chi2_quantile, covariances, exact_quantiles, rows_to_df, stats_row, value_stats)
from .clean import duplicate_flag, exact_type
from .ordered import date_gaps, diff_previous, median3, with_neighbours, with_streaks

SCHEMA = "type string, severity string, column string, count bigint, example string"


def _cols(df: DataFrame, columns, default) -> list[str]:
    return default(df) if columns is None else list(columns)


def _text(x) -> str | None:
    return None if x is None else str(x)


def findings(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return rows_to_df(df.sparkSession, rows, SCHEMA)


# ---------------------------------------------------------------- row predicates from statistics

def zscore_flags(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    got = stats_row(df, {(k, n): f(num(df, n)) for n in cols
                         for k, f in (("m", F.avg), ("s", F.stddev_samp), ("k", F.count))})
    out = {}
    for n in cols:
        m, s = got[("m", n)], got[("s", n)]
        if got[("k", n)] >= 5 and s is not None and s > 1e-9:
            out[n] = F.abs(num(df, n) - F.lit(m)) / F.lit(s) > 3.0
    return out


def iqr_flags(df: DataFrame, cols: Sequence[str], factor: float = 3.0) -> dict[str, Column]:
    qs, got = together(lambda: exact_quantiles(df, cols, [0.25, 0.75]), lambda: stats_row(df, {n: F.count(num(df, n)) for n in cols}))
    out = {}
    for n in cols:
        a, b = qs[n]
        if got[n] >= 5 and b - a > 0:
            x = num(df, n)
            out[n] = (x < a - factor * (b - a)) | (x > b + factor * (b - a))
    return out


def zero_flags(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """Zeros that look like missing: over 3 % of the values while all positive ones exceed 50."""
    got = stats_row(df, {(k, n): f for n in cols for k, f in (
        ("k", F.count(num(df, n))), ("z", count_if(num(df, n) == 0)),
        ("p", F.min(F.when(num(df, n) > 0, num(df, n)))))})
    return {n: num(df, n) == 0 for n in cols
            if got[("k", n)] >= 10 and got[("p", n)] is not None and got[("p", n)] > 50
            and got[("z", n)] / got[("k", n)] > 0.03}


def length_flags(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    got = stats_row(df, {(k, n): f(F.length(c(n))) for n in cols
                         for k, f in (("m", F.avg), ("s", F.stddev_samp), ("k", F.count))})
    return {n: F.length(c(n)) > got[("m", n)] + 3.0 * got[("s", n)] for n in cols
            if got[("k", n)] >= 5 and got[("s", n)] is not None and got[("s", n)] > 2}


def email_columns(df: DataFrame, cols: Sequence[str], over: float = 0.4) -> list[str]:
    got = stats_row(df, {(k, n): f for n in cols for k, f in (
        ("k", F.count(c(n))), ("at", count_if(c(n).contains("@"))))})
    return [n for n in cols if got[("k", n)] and
            (name_has(n, EMAIL_WORDS) or got[("at", n)] > over * got[("k", n)])]


def email_flags(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    return {n: ~c(n).rlike(EMAIL_QUALITY) for n in email_columns(df, cols)}


def negative_flags(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    return {n: num(df, n) < 0 for n in cols if name_has(n, POSITIVE_WORDS_WIDE)}


def percent_flags(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    return {n: num(df, n) > 100 for n in cols if name_has(n, PERCENT_WORDS_WIDE)}


def _report(df: DataFrame, kind: str, flags: dict[str, Column], severity) -> DataFrame:
    """Count the flags of all columns in one pass."""
    aggs = {"n": F.count(F.lit(1))}
    for n, f in flags.items():
        aggs.update({("c", n): count_if(f), ("e", n): F.min(F.when(f, c(n))).cast("string"),
                     ("k", n): F.count(c(n))})
    got = stats_row(df, aggs) if flags else {}
    rows = [(kind, severity(got[("c", n)], got[("k", n)]) if callable(severity) else severity, n, got[("c", n)],
             got[("e", n)]) for n in flags if got[("c", n)]]
    return findings(df, rows)


# ---------------------------------------------------------------- statistical and pattern detectors

def zscore(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    flags = zscore_flags(df, _cols(df, columns, numeric_cols))
    return _report(df, "statistical_zscore", flags, lambda k, n: "critical" if k / n > 0.05 else "warning")


def iqr_extreme(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _report(df, "statistical_iqr_extreme", iqr_flags(df, _cols(df, columns, numeric_cols)), "critical")


def mahalanobis_model(df: DataFrame, cols: Sequence[str]) -> tuple[list[float], list[list[float]], int]:
    """Means and pseudo-inverse covariance over complete rows: one aggregate and a p-by-p inverse."""
    import numpy as np

    n, mean, cov = covariances(df, [num(df, x) for x in cols])
    return mean, np.linalg.pinv(np.array(cov) * (n / (n - 1) if n > 1 else 0.0)).tolist(), n


def mahalanobis_distance(df: DataFrame, cols: Sequence[str], out: str = "distance") -> DataFrame:
    """Distance of every complete row from the mean; rows with a missing value get NULL."""
    mean, inv, _ = mahalanobis_model(df, cols)
    d = [num(df, n) - F.lit(m) for n, m in zip(cols, mean)]
    total = None
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            t = d[i] * d[j] * F.lit(inv[i][j] * (1 if i == j else 2))
            total = t if total is None else total + t
    return df.withColumn(out, F.when(total.isNotNull(), F.sqrt(F.greatest(total, F.lit(0.0)))))


def mahalanobis(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the 99.9 % chi-square radius."""
    cols = _cols(df, columns, numeric_cols)
    if len(cols) < 2:
        return findings(df, [])
    cut = math.sqrt(chi2_quantile(0.999, len(cols)))
    d = mahalanobis_distance(df, cols, "_d")
    got = stats_row(d, {"k": count_if(F.col("_d") > cut), "n": F.count("_d")})
    if not got["k"] or got["n"] <= len(cols) * 2:
        return findings(df, [])
    return findings(df, [("multivariate_mahalanobis", "warning", ", ".join(cols), got["k"], None)])


def _jump_limits(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Three standard deviations of every column that has enough values and varies."""
    got = stats_row(df, {(k, n): f(num(df, n)) for n in columns for k, f in (("s", F.stddev_samp), ("k", F.count))})
    return {n: 3.0 * got[("s", n)] for n in columns
            if got[("k", n)] >= 10 and got[("s", n)] and got[("s", n)] > 1e-9}


def sudden_jump(df: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """Steps between consecutive values larger than three standard deviations."""
    def one(n: str, limit: float) -> dict:
        d = diff_previous(df.select(c(order), c(n)), n, order, "_d")
        hit = F.abs(F.col("_d")) > limit
        return stats_row(d, {"k": count_if(hit), "e": F.min(F.when(hit, num(df, n)))})

    limits = _jump_limits(df, columns)
    got = together(*[lambda n=n, limit=limit: one(n, limit) for n, limit in limits.items()])
    return findings(df, [("pattern_sudden_jump", "warning", n, r["k"], _text(r["e"])) for n, r in zip(limits, got, strict=True) if r["k"]])


def repeated_sequence(df: DataFrame, order: str, columns: Sequence[str], least: int = 10) -> DataFrame:
    """Values repeated at least ten times in a row."""
    def one(n: str) -> dict:
        d = with_streaks(df.select(c(order), c(n)), n, order, "_s")
        hit = F.col("_s") >= least
        return stats_row(d, {"n": F.count(F.lit(1)), "k": count_if(hit), "e": F.min(F.when(hit, num(df, n)))})

    got = together(*[lambda n=n: one(n) for n in columns])
    return findings(df, [("pattern_repeated_sequence", "warning", n, r["k"], _text(r["e"])) for n, r in zip(columns, got, strict=True)
                         if r["n"] >= 10 and r["k"]])


def _round_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[int, float]]:
    """(multiples of ten, smallest whole number) of the columns with a bias to round numbers."""
    aggs = {}
    for n in cols:
        x = num(df, n)
        whole = (x == F.rint(x)) & (x > 0)
        aggs.update({("k", n): F.count(x), ("w", n): count_if(whole), ("r", n): count_if(whole & (x % 10 == 0)),
                     ("e", n): F.min(F.when(whole, x))})
    got = stats_row(df, aggs)
    return {n: (got[("r", n)], got[("e", n)]) for n in cols
            if got[("k", n)] >= 20 and got[("w", n)] > 0.7 * got[("k", n)] and got[("r", n)] / got[("w", n)] >= 0.8}


def round_flags(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    return {n: (num(df, n) > 0) & (num(df, n) % 10 == 0) for n in _round_stats(df, cols)}


def round_bias(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Positive whole numbers that are mostly multiples of ten."""
    got = _round_stats(df, _cols(df, columns, numeric_cols))
    return findings(df, [("pattern_round_number_bias", "info", n, k, _text(e)) for n, (k, e) in got.items()])


def suspicious_zeros(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _report(df, "pattern_suspicious_zeros", zero_flags(df, _cols(df, columns, numeric_cols)), "warning")


# ---------------------------------------------------------------- text

def extreme_length(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    flags = length_flags(df, _cols(df, columns, text_cols))
    aggs = {}
    for n, f in flags.items():
        aggs.update({("c", n): count_if(f), ("e", n): F.max(F.when(f, F.length(c(n))))})
    got = stats_row(df, aggs) if flags else {}
    return findings(df, [("text_extreme_length", "warning", n, got[("c", n)], f"{got[('e', n)]} characters")
                         for n in flags if got[("c", n)]])


def copy_paste(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The most repeated text of more than 40 characters, from five copies on.

    Whole texts are counted by their hash; only the winner's text is looked at again.  Without text columns there is no finding."""
    cols = _cols(df, columns, text_cols)
    long = {n: F.when(F.length(c(n)) > 40, F.md5(c(n))) for n in cols}
    top = {n: v for n, v in value_stats(df, long).items() if v.most >= 5}
    shown = stats_row(df, {n: F.min(F.when(long[n] == v.last_mode, F.substring(c(n), 1, 60))) for n, v in top.items()})
    return findings(df, [("text_copy_paste_anomaly", "info", n, top[n].most, shown[n]) for n in cols if n in top])


def script_flags(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """Values with non-ASCII characters, in the columns where they and plain values each exceed 5 %."""
    hit = {n: c(n).rlike(r"[^\x00-\x7F]") for n in cols}
    got = stats_row(df, {(k, n): f for n in cols for k, f in (("k", F.count(c(n))), ("x", count_if(hit[n])))})
    return {n: hit[n] for n in cols if got[("k", n)] >= 5 and 0.05 < got[("x", n)] / got[("k", n)] < 0.95}


def mixed_scripts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """ASCII and non-ASCII values side by side, each in more than 5 % of the cells."""
    flags = script_flags(df, _cols(df, columns, text_cols))
    got = stats_row(df, {n: count_if(f) for n, f in flags.items()}) if flags else {}
    return findings(df, [("text_mixed_scripts", "info", n, got[n], None) for n in flags])


# ---------------------------------------------------------------- dates

def date_like(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Typed dates, and text columns named like dates of which over half parse."""
    cols = list(columns or flat_cols(df))
    named = [n for n in cols if n in text_cols(df) and name_has(n, DATE_WORDS)]
    got = stats_row(df, {"n": F.count(F.lit(1)), **{n: F.count(parse_date(c(n))) for n in named}}) if named else {}
    return [n for n in cols if is_date(df, n) or (n in named and got[n] > 0.5 * got["n"])]


def _date_report(df, kind, severity, cols, cond) -> DataFrame:
    aggs = {}
    for n in cols:
        ts = as_date(df, n)
        aggs.update({("c", n): count_if(cond(ts)),
                     ("e", n): F.date_format(F.min(F.when(cond(ts), ts)), "yyyy-MM-dd")})
    got = stats_row(df, aggs) if cols else {}
    return findings(df, [(kind, severity, n, got[("c", n)], got[("e", n)]) for n in cols if got[("c", n)]])


def date_future(df: DataFrame, as_of: str, columns: Sequence[str] | None = None) -> DataFrame:
    cols = [n for n in date_like(df, columns) if not name_has(n, FUTURE_OK_WORDS)]
    now = F.lit(as_of).cast("timestamp")
    return _date_report(df, "date_future", "critical", cols, lambda ts: ts > now)


def date_old(df: DataFrame, columns: Sequence[str] | None = None, before: str = "1900-01-01") -> DataFrame:
    limit = F.lit(before).cast("timestamp")
    return _date_report(df, "date_historic_old", "warning", date_like(df, columns), lambda ts: ts < limit)


def date_gap_jump(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cols = date_like(df, columns)
    found = together(*[lambda n=n: stats_row(date_gaps(df, n), {"k": F.count(F.lit(1)), "d": F.min("gap_days")}) for n in cols])
    return findings(df, [("date_gap_jump", "warning", n, got["k"], f"{got['d']} days gap") for n, got in zip(cols, found, strict=True) if got["k"]])


def date_weekend(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Weekend dates in the given columns, or in those with a business name."""
    cols = list(columns) if columns else [n for n in date_like(df) if name_has(n, BUSINESS_WORDS)]
    return _date_report(df, "date_weekend_business", "info", cols, lambda ts: F.weekday(ts) >= 5)


# ---------------------------------------------------------------- business rules

def negative_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _report(df, "business_negative_value", negative_flags(df, _cols(df, columns, numeric_cols)), "critical")


def percentage_over_100(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _report(df, "business_percentage_over_100", percent_flags(df, _cols(df, columns, numeric_cols)), "critical")


def id_columns(df: DataFrame) -> list[str]:
    return [n for n in flat_cols(df) if name_has(n, ID_WORDS, suffix_from=3) and not n.lower().endswith("_idx")]


def duplicate_identifier(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Identifier columns whose values repeat: all rows of repeated values count."""
    got = value_stats(df, {n: as_text(df, n) for n in _cols(df, columns, id_columns)})
    return findings(df, [("business_duplicate_identifier", "critical", n, v.repeated, v.least_repeated) for n, v in got.items() if v.repeated])


def invalid_email(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _report(df, "business_invalid_email", email_flags(df, _cols(df, columns, text_cols)), "warning")


# ---------------------------------------------------------------- all together

def detect_all(df: DataFrame, order: str | None = None, as_of: str | None = None, key: str | None = None) -> DataFrame:
    """Every detector; order-dependent ones need ``order``, future dates need ``as_of``, and are left out without it.
    A numeric ``key`` or ``order`` column is no measurement.  The detectors run side by side over shared scans."""
    nums = [n for n in numeric_cols(df) if n not in (key, order)]
    measures = (zscore, iqr_extreme, mahalanobis, round_bias, suspicious_zeros, negative_values, percentage_over_100)
    parts = [lambda d, f=f: f(d, nums) for f in measures]
    parts += [extreme_length, copy_paste, mixed_scripts, date_old, date_gap_jump, date_weekend, duplicate_identifier, invalid_email]
    if order:
        parts += [lambda d: sudden_jump(d, order, nums), lambda d: repeated_sequence(d, order, nums)]
    if as_of:
        parts.append(lambda d: date_future(d, as_of))
    out = None
    for part in shared(df, parts):
        out = part if out is None else out.unionByName(part)
    return out


def _hits(df: DataFrame, key: str, sets: dict[str, dict[str, Column]]) -> DataFrame:
    hits = [F.when(f, F.struct(F.lit(t).alias("type"), F.lit(n).alias("column"))) for t, fs in sets.items()
            for n, f in fs.items()]
    if not hits:
        return df.select(c(key), F.lit("").alias("type"), F.lit("").alias("column")).where(F.lit(False))
    return df.select(c(key), F.inline(F.array_compact(F.array(*hits))))


def _row_sets(df: DataFrame, nums: Sequence[str], texts: Sequence[str]) -> dict[str, dict[str, Column]]:
    return {"statistical_zscore": zscore_flags(df, nums), "statistical_iqr_extreme": iqr_flags(df, nums),
            "pattern_suspicious_zeros": zero_flags(df, nums), "text_extreme_length": length_flags(df, texts),
            "business_negative_value": negative_flags(df, nums), "business_percentage_over_100": percent_flags(df, nums),
            "business_invalid_email": email_flags(df, texts)}


def flags(df: DataFrame, key: str) -> DataFrame:
    """(key, type, column) for every row hit by a row-wise detector."""
    return _hits(df, key, _row_sets(df, [n for n in numeric_cols(df) if n != key], text_cols(df)))


def _repeated(df: DataFrame, key: str, kind: str, column: str, value: Column, least: int) -> DataFrame:
    """Rows of values that occur ``least`` times or more; values are counted before any row is joined."""
    rows = df.select(c(key), value.alias("_v")).where(F.col("_v").isNotNull())
    many = rows.groupBy("_v").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).withColumn("_many", F.lit(True))
    return attach(rows, many, ["_v"], "_n").where(F.col("_many")).select(
        c(key), F.lit(kind).alias("type"), F.lit(column).alias("column"))


def all_flags(df: DataFrame, key: str, order: str | None = None, as_of: str | None = None) -> DataFrame:
    """(key, type, column) for every row behind every finding of ``detect_all``.

    Row-wise detectors share one pass.  Copied texts and repeated identifiers give all rows of every such value; a date
    gap gives the rows at its later end; a jump the row after it; a multivariate outlier names all its columns.  Jumps and
    streaks need ``order``, future dates ``as_of``: without them these detectors are left out.  A numeric
    ``key`` or ``order`` is no measurement."""
    nums, texts = [n for n in numeric_cols(df) if n not in (key, order)], text_cols(df)
    dates = date_like(df)
    ts = {n: as_date(df, n) for n in dates}
    sets = _row_sets(df, nums, texts)
    sets["pattern_round_number_bias"] = round_flags(df, nums)
    sets["text_mixed_scripts"] = script_flags(df, texts)
    sets["date_historic_old"] = {n: ts[n] < F.lit("1900-01-01").cast("timestamp") for n in dates}
    sets["date_weekend_business"] = {n: F.weekday(ts[n]) >= 5 for n in dates if name_has(n, BUSINESS_WORDS)}
    if as_of:
        sets["date_future"] = {n: ts[n] > F.lit(as_of).cast("timestamp") for n in dates if not name_has(n, FUTURE_OK_WORDS)}
    whole = df
    if len(nums) >= 2:
        whole = mahalanobis_distance(df, nums, "_distance")
        if stats_row(whole, {"n": F.count("_distance")})["n"] > len(nums) * 2:
            sets["multivariate_mahalanobis"] = {
                ", ".join(nums): F.col("_distance") > math.sqrt(chi2_quantile(0.999, len(nums)))}
    out = _hits(whole, key, sets)

    def also(rows: DataFrame, kind: str, column: str) -> None:
        nonlocal out
        out = out.unionByName(rows.select(c(key), F.lit(kind).alias("type"), F.lit(column).alias("column")))

    for n in id_columns(df):
        out = out.unionByName(_repeated(df, key, "business_duplicate_identifier", n, as_text(df, n), 2))
    for n in texts:
        long = F.when(F.length(c(n)) > 40, F.md5(c(n)))
        out = out.unionByName(_repeated(df, key, "text_copy_paste_anomaly", n, long, 5))
    for n in dates:
        late = date_gaps(df, n).select(F.col("to_ts").alias("_t")).distinct()
        rows = df.select(c(key), ts[n].alias("_t"))
        also(rows.join(F.broadcast(late), "_t"), "date_gap_jump", n)  # at most one gap a calendar year
    if order:
        keep = list(dict.fromkeys([key, order]))
        for n, limit in _jump_limits(df, nums).items():
            d = diff_previous(df.select(*map(c, keep), c(n)), n, order, "_d")
            also(d.where(F.abs(F.col("_d")) > limit), "pattern_sudden_jump", n)
        have = stats_row(df, {n: F.count(num(df, n)) for n in nums}) if nums else {}
        for n in nums:
            if have[n] >= 10:
                d = with_streaks(df.select(*map(c, keep), c(n)), n, order, "_s")
                also(d.where(F.col("_s") >= 10), "pattern_repeated_sequence", n)
    return out


def by_column(anomalies: DataFrame, column: str) -> DataFrame:
    return anomalies.where(F.col("column") == column)


# ---------------------------------------------------------------- repairs

def fix_negative(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.withColumn(column, F.abs(c(column)))


def _repaired(df: DataFrame, column: str, *cases: tuple[Column, Column]) -> DataFrame:
    """Each value replaced by the first case that holds.  Integer and decimal columns keep their type, and all other values as they are."""
    t = exact_type(df, column)
    new = None
    for when, value in cases:
        value = value.cast(t) if t is not None else value.cast("double")
        new = F.when(when, value) if new is None else new.when(when, value)
    return df.withColumn(column, new.otherwise(c(column) if t is not None else num(df, column)))


def _inward(df: DataFrame, column: str, lo: float, hi: float) -> tuple[Column, Column]:
    """Both ends of a range; of integer columns the first and last whole number inside it."""
    whole = isinstance(exact_type(df, column), T.IntegralType)
    return (F.ceil(F.lit(lo)), F.floor(F.lit(hi))) if whole else (F.lit(lo), F.lit(hi))


def fix_percentage(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return _repaired(df, column, (num(df, column) > 100, F.lit(100)))


def fix_extreme(df: DataFrame, column: str, factor: float = 2.5) -> DataFrame:
    """Clip to quartiles ± 2.5·IQR; integers to the whole numbers inside."""
    require(df, column)
    a, b = exact_quantiles(df, [column], [0.25, 0.75])[column]
    if a is None:
        return df
    x = num(df, column)
    lo, hi = a - factor * (b - a), b + factor * (b - a)
    low, high = _inward(df, column, lo, hi)
    return _repaired(df, column, (x < lo, low), (x > hi, high))


def fix_zeros(df: DataFrame, column: str) -> DataFrame:
    """Zeros become the median of the positive values, rounded in integer columns."""
    require(df, column)
    x = num(df, column)
    med = exact_quantiles(df, {column: F.when(x > 0, x)}, [0.5])[column][0]
    value = F.lit(med).cast("double")
    return _repaired(df, column, (x == 0, F.round(value) if isinstance(exact_type(df, column), T.IntegralType) else value))


def fix_email(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.when(c(column).rlike(EMAIL_QUALITY), c(column)))


def fix_text_length(df: DataFrame, column: str) -> DataFrame:
    """Cut texts at mean + 3 standard deviations of the length."""
    got = stats_row(df, {"m": F.avg(F.length(c(column))), "s": F.stddev_samp(F.length(c(column)))})
    if got["m"] is None or got["s"] is None:
        return df
    cut = int(got["m"] + 3 * got["s"])
    return df.withColumn(column, F.substring(c(column), 1, cut))


def fix_duplicate_id(df: DataFrame, column: str, key: str) -> DataFrame:
    """Later copies of an identifier get ``_dup_<key>`` appended."""
    d = duplicate_flag(df, [column], key, "_dup")
    x = as_text(df, column)
    return d.withColumn(column, F.when(F.col("_dup"), F.concat(x, F.lit("_dup_"), c(key).cast("string")))
                        .otherwise(x)).drop("_dup")


def fix_jump(df: DataFrame, column: str, order: str) -> DataFrame:
    """Where the column has sudden jumps, smooth it by the centred median of three."""
    s = stats_row(df, {"s": F.stddev_samp(num(df, column))})["s"]
    if not s or s <= 1e-9:
        return df
    d = diff_previous(df.select(c(order), c(column)), column, order, "_d")
    if not stats_row(d, {"k": count_if(F.abs(F.col("_d")) > 3.0 * s)})["k"]:
        return df
    t = exact_type(df, column)
    x = num(df, column) if t is None else c(column)
    j = with_neighbours(df, order, {"v": x}, nxt=True)
    new = median3(F.col("_prev_v"), x, F.col("_next_v"), None if t is None else lambda a, b: _middle(a, b, t))
    return j.withColumn(column, new).select(*[c(n) for n in df.columns])


def _middle(a: Column, b: Column, t: T.DataType) -> Column:
    """Half way between two exact values, in their type; their sum may not fit in it."""
    wide = T.DecimalType(38, t.scale if isinstance(t, T.DecimalType) else 0)
    return F.round((a.cast(wide) + b.cast(wide)) / 2, wide.scale).cast(t)


def fix_all(df: DataFrame, key: str, found: DataFrame | None = None, order: str | None = None, as_of: str | None = None) -> DataFrame:
    """Repair what ``detect_all`` finds, in the order the detectors report it.  ``key`` and ``order`` stay as they are."""
    found = detect_all(df, order, as_of, key) if found is None else found
    for r in found.collect():  # a few rows per column
        kind, n = r["type"], r["column"]
        if n not in df.columns or n in (key, order):
            continue
        if kind == "business_negative_value":
            df = fix_negative(df, n)
        elif kind == "business_percentage_over_100":
            df = fix_percentage(df, n)
        elif kind in ("statistical_zscore", "statistical_iqr_extreme"):
            df = fix_extreme(df, n)
        elif kind == "pattern_suspicious_zeros":
            df = fix_zeros(df, n)
        elif kind == "business_invalid_email":
            df = fix_email(df, n)
        elif kind == "text_extreme_length":
            df = fix_text_length(df, n)
        elif kind == "business_duplicate_identifier":
            df = fix_duplicate_id(df, n, key)
        elif kind == "pattern_sudden_jump" and order:
            df = fix_jump(df, n, order)
    return df

