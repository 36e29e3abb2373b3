"""Column and table profiles as tidy reports."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import (c, count_if, date_cols, flat_cols, is_bool, is_date, is_integral, is_missing,
                              is_numeric, is_text, num, numeric_cols, present, sentinel, strip, text_cols)
from ..functions.dates import as_date, parse_date
from ..functions.gather import bounded_rows, shared, together
from ..functions.stats import (column_modes, correlations, distinct_counts, exact_quantiles, modes_and_distinct, pair_correlations,
                               rows_to_df, sample_kurtosis, sample_skew, spread, stats_row)
from .clean import Fence, duplicate_count, fences, is_outlier
from .ordered import date_gaps
from .sample import plot_sample

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def rnd(x, digits: int = 4):
    """Round half away from zero, as SQL does; non-finite values become NULL."""
    if x is None or (isinstance(x, float) and not math.isfinite(x)):
        return None
    unit = 10 ** digits
    return math.copysign(math.floor(abs(float(x)) * unit + 0.5) / unit, x)


def pct(part, whole, digits: int = 2) -> float:
    return rnd(part / max(whole, 1) * 100, digits)


def _records(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return rows_to_df(df.sparkSession, rows, schema)


# ---------------------------------------------------------------- missing values

def missing_values(df: DataFrame, sentinels: bool = True) -> DataFrame:
    """(column, missing_count, missing_pct) of the columns that have missing cells."""
    cols = flat_cols(df)
    got = stats_row(df, {"n": F.count(F.lit(1)), **{n: count_if(is_missing(df, n, sentinels)) for n in cols}})
    return _records(df, [(n, got[n], pct(got[n], got["n"])) for n in cols if got[n]],
                    "column string, missing_count bigint, missing_pct double")


def missing_by_column(df: DataFrame) -> DataFrame:
    """Native NULLs of every column with the imputation to try."""
    cols = flat_cols(df)
    got = stats_row(df, {"n": F.count(F.lit(1)), **{n: count_if(is_missing(df, n, False)) for n in cols}})
    return _records(df, [(n, got[n], pct(got[n], got["n"]),
                          "KNN / Iterative" if is_numeric(df, n) else "Mode / Constant") for n in cols],
                    "column string, missing_count bigint, missing_pct double, recommended_imputation string")


def missing_pattern(df: DataFrame) -> DataFrame:
    """MCAR / MAR / possible MNAR from the strongest correlation between missing indicators."""
    cols = flat_cols(df)
    ind = {n: is_missing(df, n, False).cast("double") for n in cols}
    miss, got = together(lambda: stats_row(df, {n: F.sum(x) for n, x in ind.items()}), lambda: pair_correlations(df, ind))
    rs = [abs(r) for r in got.values() if r is not None and math.isfinite(r)]
    top = max(rs, default=0.0) if any(miss.values()) else 0.0
    label = "MAR" if top > 0.5 else ("Possible MNAR" if top > 0.2 else "MCAR")
    return _records(df, [(rnd(top), label)], "max_abs_corr double, pattern string")


# ---------------------------------------------------------------- numeric columns

# Names of the distribution shapes.
NORMAL = "Normal / Bell-shaped"
RIGHT_SKEWED = "Right-Skewed (Positive)"
LEFT_SKEWED = "Left-Skewed (Negative)"
UNIFORM = "Uniform"
OTHER_SHAPE = "Multi-modal / Complex"


def distribution_label(skew: float, kurt: float, std: float, lo: float, hi: float) -> str:
    """Shape by skewness and kurtosis; a uniform spread has a deviation of about 0.288 ranges."""
    if abs(skew) < 0.5 and abs(kurt) < 1.0:
        return NORMAL
    if abs(skew) > 1.0:
        return RIGHT_SKEWED if skew > 0 else LEFT_SKEWED
    even = hi > lo and abs(std / (hi - lo + 1e-9) - 0.288) < 0.05
    return UNIFORM if even else OTHER_SHAPE


def _moments(df: DataFrame, cols: Sequence[str]) -> dict:
    aggs = {"n": F.count(F.lit(1))}
    for n in cols:
        x = num(df, n)
        aggs.update({("count", n): F.count(x), ("mean", n): F.avg(x), ("std", n): F.stddev_samp(x),
                     ("var", n): F.var_samp(x), ("lo", n): F.min(x), ("hi", n): F.max(x),
                     ("skew", n): sample_skew(x), ("kurt", n): sample_kurtosis(x)})
    return stats_row(df, aggs)


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column."""
    cols = list(columns or numeric_cols(df))
    got, qs = shared(df, [lambda d: _moments(d, cols), lambda d: exact_quantiles(d, cols, [0.25, 0.5, 0.75])])
    return _records(df, [(n, got[("count", n)], rnd(got[("mean", n)]), rnd(got[("std", n)]), rnd(got[("lo", n)]),
                          *[rnd(q) for q in qs[n]], rnd(got[("hi", n)])) for n in cols],
                    "column string, count bigint, mean double, std double, min double, q25 double, q50 double, "
                    "q75 double, max double")


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Full numeric profile: moments, mode, percentiles, fences, shape label, whiskers."""
    cols = list(columns or numeric_cols(df))

    def spots(d: DataFrame) -> tuple:
        qs = exact_quantiles(d, cols, PERCENTILES)
        fen = {n: (q[2] - 1.5 * (q[4] - q[2]), q[4] + 1.5 * (q[4] - q[2])) for n, q in qs.items() if q[0] is not None}
        return qs, fen, stats_row(d, {n: count_if((num(d, n) < lo) | (num(d, n) > hi)) for n, (lo, hi) in fen.items()})

    got, found, (qs, fen, out_n) = shared(df, [lambda d: _moments(d, cols), lambda d: modes_and_distinct(d, cols), spots])
    modes, uniq = {n: m for n, (m, _) in found.items()}, {n: u for n, (_, u) in found.items()}
    rows = []
    for n in cols:
        k, total = got[("count", n)], got["n"]
        if not k:
            rows.append((n, total, 0, total, pct(total, total), 0, 0.0) + (None,) * 23)
            continue
        lo, hi, std = got[("lo", n)], got[("hi", n)], got[("std", n)] or 0.0
        sk, ku = got[("skew", n)] or 0.0, got[("kurt", n)] or 0.0
        sk, ku = (0.0 if math.isnan(sk) else sk), (0.0 if math.isnan(ku) else ku)
        q = qs[n]
        f_lo, f_hi = fen[n]
        rows.append((n, total, k, total - k, pct(total - k, total), uniq[n], pct(uniq[n], total),
                     rnd(got[("mean", n)]), rnd(q[3]), rnd(modes[n]), rnd(std), rnd(got[("var", n)] or 0.0),
                     rnd(lo), rnd(hi), rnd(hi - lo), rnd(q[4] - q[2]), rnd(sk), rnd(ku), *[rnd(v) for v in q],
                     out_n[n], pct(out_n[n], k), distribution_label(sk, ku, std, lo, hi),
                     rnd(max(lo, f_lo)), rnd(min(hi, f_hi))))
    return _records(df, rows,
                    "column string, total bigint, count bigint, missing bigint, missing_pct double, unique bigint, "
                    "unique_pct double, mean double, median double, mode double, std double, variance double, "
                    "min double, max double, range double, iqr double, skewness double, kurtosis double, p1 double, "
                    "p5 double, p25 double, p50 double, p75 double, p95 double, p99 double, outlier_count bigint, "
                    "outlier_pct double, distribution string, lower_whisker double, upper_whisker double")


def profile_quick(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Short profile of any column: moments for numbers, top five values and mean length for the rest."""
    cols = list(columns or flat_cols(df))
    numeric = [n for n in cols if is_numeric(df, n)]
    other = [n for n in cols if n not in numeric]
    from .reshape import top_values

    got, more, med, uniq, most = shared(df, [
        lambda d: _moments(d, numeric),
        lambda d: stats_row(d, {**{("miss", n): count_if(is_missing(d, n, False)) for n in cols},
                                **{("len", n): F.avg(F.length(c(n).cast("string"))) for n in other}}),
        lambda d: exact_quantiles(d, numeric, [0.5]), lambda d: distinct_counts(d, cols),
        lambda d: bounded_rows(top_values(d, other, 5)) if other else []])  # five rows per column
    got.update(more)
    tops: dict[str, list[str]] = {}
    for r in sorted(most, key=lambda r: (r["column"], -r["n"], r["value"])):
        tops.setdefault(r["column"], []).append(f"{r['value']}={r['n']}")
    total = got["n"]
    rows = []
    for n in cols:
        base = (n, "numeric" if n in numeric else "categorical", got[("miss", n)], pct(got[("miss", n)], total, 1),
                uniq[n], pct(uniq[n], total, 1))
        if n in numeric:
            rows.append(base + (rnd(got[("mean", n)]), rnd(med[n][0]), rnd(got[("std", n)]), rnd(got[("lo", n)]),
                                rnd(got[("hi", n)]), rnd(got[("skew", n)]), rnd(got[("kurt", n)]), None, None))
        else:
            rows.append(base + (None,) * 7 + ("; ".join(tops.get(n, [])), rnd(got[("len", n)] or 0.0, 1)))
    return _records(df, rows,
                    "column string, type string, missing bigint, missing_pct double, unique bigint, "
                    "unique_pct double, mean double, median double, std double, min double, max double, "
                    "skewness double, kurtosis double, top_values string, avg_length double")


# ---------------------------------------------------------------- dates and text

def profile_date(df: DataFrame, column: str) -> DataFrame:
    """Range, most common year / month / day, and whether a gap over a year exists."""
    ts = as_date(df, column)
    got = stats_row(df, {"lo": F.min(ts), "hi": F.max(ts),
                         "span": F.floor((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / F.lit(86400000000)),
                         "lo_s": F.date_format(F.min(ts), "yyyy-MM-dd"),
                         "hi_s": F.date_format(F.max(ts), "yyyy-MM-dd")})
    if got["lo"] is None:
        return _records(df, [], DATE_SCHEMA)
    m, gap = shared(df, [lambda d: column_modes(d, {"y": F.year(ts), "m": F.month(ts), "d": F.dayofmonth(ts)}),
                         lambda d: gap_count(d, column) > 0])
    return _records(df, [(column, got["lo_s"], got["hi_s"], got["span"], m["y"], m["m"], m["d"], gap)], DATE_SCHEMA)


def gap_count(df: DataFrame, column: str) -> int:
    """How many gaps of over a year the dates have."""
    return bounded_rows(date_gaps(df, column).agg(F.count(F.lit(1)).alias("n")))[0]["n"]


DATE_SCHEMA = ("column string, min_date string, max_date string, date_range_days bigint, most_common_year int, "
               "most_common_month int, most_common_day int, date_gaps_detected boolean")


def profile_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Lengths and character classes per text column, over whole texts."""
    cols = list(columns or text_cols(df))
    aggs = {}
    for n in cols:
        x = c(n).cast("string")
        ln = F.length(x)
        aggs.update({("avg", n): F.avg(ln), ("lo", n): F.min(ln), ("hi", n): F.max(ln),
                     ("dig", n): F.bool_or(x.rlike(r"[0-9]")), ("spec", n): F.bool_or(x.rlike(r"(?U)[^\w\s]"))})
    got = stats_row(spread(df.select(*[c(n) for n in cols])), aggs)
    return _records(df, [(n, rnd(got[("avg", n)], 1), got[("lo", n)], got[("hi", n)], got[("dig", n)],
                          got[("spec", n)]) for n in cols],
                    "column string, avg_length double, min_length int, max_length int, contains_numbers boolean, "
                    "contains_special_chars boolean")


def distinct_sample(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k smallest distinct values."""
    return df.select(c(column).alias("value")).where("value is not null").distinct().orderBy("value").limit(k)


# ---------------------------------------------------------------- semantic types

# Words that make a text column boolean.
BOOL_TOKENS = ("true", "false", "yes", "no", "0", "1")


def detect_types(df: DataFrame) -> dict[str, str]:
    """number, text, date, boolean, mixed or empty per column.

    Text is judged on its non-missing values: at most ten distinct values that are all
    boolean words, then over 95 % numbers (80 %: mixed), then over 70 % dates."""
    cols = flat_cols(df)
    aggs = {}
    for n in cols:
        x = present(df, n)
        aggs[("k", n)] = F.count(x)
        if is_text(df, n):
            t = F.lower(strip(x))
            v = F.when(x.isNotNull(), num(df, n))
            aggs.update({("num", n): F.count(v), ("date", n): F.count(parse_date(x)),
                         ("bool", n): count_if(t.isin(*BOOL_TOKENS))})
        elif is_numeric(df, n):
            aggs[("bit", n)] = count_if(num(df, n).isin(0.0, 1.0))
    got = stats_row(df, aggs)
    maybe_bool = [n for n in cols if is_text(df, n) and got[("k", n)] and got[("bool", n)] == got[("k", n)]]
    uniq = distinct_counts(df, maybe_bool)
    out = {}
    for n in cols:
        k = got[("k", n)]
        if not k:
            out[n] = "empty"
        elif is_bool(df, n):
            out[n] = "boolean"
        elif is_date(df, n):
            out[n] = "date"
        elif is_numeric(df, n):
            out[n] = "boolean" if is_integral(df, n) and got[("bit", n)] == k else "number"
        elif not is_text(df, n):
            out[n] = "text"
        elif n in maybe_bool and uniq[n] <= 10:
            out[n] = "boolean"
        elif got[("num", n)] / k > 0.8:
            out[n] = "number" if got[("num", n)] / k > 0.95 else "mixed"
        elif got[("date", n)] / k > 0.7:
            out[n] = "date"
        else:
            out[n] = "text"
    return out


def type_report(df: DataFrame) -> DataFrame:
    return _records(df, list(detect_types(df).items()), "column string, semantic_type string")


def numeric_like(df: DataFrame, types: dict[str, str] | None = None) -> list[str]:
    """Columns outlier checks apply to: numbers (typed or detected) that are not 0/1 flags."""
    types = types or detect_types(df)
    return [n for n in flat_cols(df) if types[n] != "boolean" and not is_bool(df, n)
            and (is_numeric(df, n) or types[n] == "number")]


def outlier_counts(df: DataFrame, cols: Sequence[str], fs: dict[str, Fence] | None = None) -> dict[str, int]:
    fs = fences(df, cols) if fs is None else fs
    return stats_row(df, {n: count_if(is_outlier(num(df, n), f)) for n, f in fs.items()}) if fs else {}


def beyond_counts(df: DataFrame, cols: Sequence[str], fs: dict[str, Fence] | None = None) -> dict[str, int]:
    """Values outside the plain 1.5·IQR fences."""
    fs = fences(df, cols, fallback=False) if fs is None else fs
    return stats_row(df, {n: count_if((num(df, n) < f.lower) | (num(df, n) > f.upper)) for n, f in fs.items()}) if fs else {}


def outliers_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with outliers, their fences and counts (MAD and median fall-backs included)."""
    cols = list(columns) if columns else numeric_like(df)
    fs = fences(df, cols)
    cnt = outlier_counts(df, cols, fs)
    return _records(df, [(n, cnt[n], rnd(f.lower), rnd(f.upper), rnd(f.q1), rnd(f.q3), rnd(f.iqr))
                         for n, f in fs.items() if cnt[n]],
                    "column string, outlier_count bigint, lower_bound double, upper_bound double, q1 double, "
                    "q3 double, iqr double")


def outliers_simple(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Plain 1.5·IQR report of all numeric columns with the extreme outliers."""
    cols = list(columns or numeric_cols(df))
    fs = fences(df, cols, fallback=False)
    aggs = {"n": F.count(F.lit(1))}
    for n, f in fs.items():
        x = num(df, n)
        o = F.when((x < f.lower) | (x > f.upper), x)
        aggs.update({("k", n): F.count(o), ("lo", n): F.min(o), ("hi", n): F.max(o)})
    got = stats_row(df, aggs)
    return _records(df, [(n, got[("k", n)], pct(got[("k", n)], got["n"]), rnd(f.lower, 3), rnd(f.upper, 3),
                          rnd(got[("lo", n)], 3), rnd(got[("hi", n)], 3)) for n, f in fs.items()],
                    "column string, count bigint, percentage double, lower_bound double, upper_bound double, "
                    "min_outlier double, max_outlier double")


def outlier_row_count(df: DataFrame, columns: Sequence[str] | None = None) -> int:
    """Rows with at least one value outside a 1.5·IQR fence (columns with IQR 0 are skipped)."""
    cols = list(columns or numeric_cols(df))
    fs = {n: f for n, f in fences(df, cols, fallback=False).items() if f.iqr > 0}
    any_out = F.lit(False)
    for n, f in fs.items():
        x = num(df, n)
        any_out = any_out | F.coalesce((x < f.lower) | (x > f.upper), F.lit(False))
    return stats_row(df, {"k": count_if(any_out)})["k"]


def column_statistics(df: DataFrame) -> DataFrame:
    """One row per column: type, missing, unique, outliers, range, centre, spread, commonest and
    shortest/longest text (smallest on ties)."""
    cols = flat_cols(df)
    texts = [n for n in cols if is_text(df, n)]
    nums = numeric_cols(df)
    aggs = {"n": F.count(F.lit(1))}
    for n in cols:
        aggs[("miss", n)] = count_if(is_missing(df, n))
    for n in nums:
        x = num(df, n)
        aggs.update({("lo", n): F.min(x), ("hi", n): F.max(x), ("mean", n): F.avg(x), ("std", n): F.stddev_samp(x)})
    for n in texts:
        v = F.when(~sentinel(c(n)), c(n))
        aggs[("short", n)] = F.min(F.when(v.isNotNull(), F.struct(F.length(v).alias("l"), v.alias("v"))))
        aggs[("long", n)] = F.min(F.when(v.isNotNull(), F.struct((-F.length(v)).alias("l"), v.alias("v"))))

    def typed(d: DataFrame) -> tuple:
        types = detect_types(d)
        return types, outlier_counts(d, numeric_like(d, types))

    got, (types, out_n), uniq, modes, med = shared(df, [
        lambda d: stats_row(d, aggs), typed, lambda d: distinct_counts(d, nums + texts),
        lambda d: column_modes(d, {n: F.when(~sentinel(c(n)), c(n)) for n in texts}), lambda d: exact_quantiles(d, nums, [0.5])])
    rows = []
    for n in cols:
        g = lambda k: got.get((k, n))
        sv, lv = g("short"), g("long")
        rows.append((n, types[n], got["n"], g("miss"), pct(g("miss"), got["n"]), uniq.get(n), out_n.get(n, 0),
                     rnd(g("lo")), rnd(g("hi")), rnd(g("mean")), rnd(med[n][0]) if n in med else None, rnd(g("std")),
                     modes.get(n), sv["v"] if sv else None, lv["v"] if lv else None))
    return _records(df, rows,
                    "column string, data_type string, total_count bigint, missing_count bigint, "
                    "missing_pct double, unique_count bigint, outlier_count bigint, min_value double, "
                    "max_value double, mean_value double, median_value double, std_value double, "
                    "most_common string, shortest_value string, longest_value string")


# ---------------------------------------------------------------- correlations

def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(col1, col2, correlation, note) over pairwise-complete rows; undefined ones count as 0."""
    cols = list(columns or numeric_cols(df))
    rs = correlations(df, cols)
    rows = []
    for (a, b), r in rs.items():
        r = 0.0 if r is None else rnd(r, 3)
        note = ("Nearly identical" if abs(r) > 0.95 else "Highly correlated") if abs(r) > 0.85 else None
        rows.append((a, b, r, note))
    return _records(df, rows, "col1 string, col2 string, correlation double, note string")


def corr_top_pairs(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """The k strongest pairs over complete rows, with a collinearity flag above 0.85."""
    cols = list(columns or numeric_cols(df))
    rs = {p: r for p, r in correlations(df, cols, complete=True).items() if r is not None}
    top = sorted(rs.items(), key=lambda t: -abs(t[1]))[:k]
    return _records(df, [(a, b, rnd(r, 3), abs(r) > 0.85) for (a, b), r in top],
                    "col1 string, col2 string, correlation double, collinear boolean")


def corr_strength(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """Pairs above 0.5: moderate, strong above 0.7, very strong above 0.9, with the sign."""
    cols = list(columns or numeric_cols(df))
    rows = []
    for (a, b), r in correlations(df, cols).items():
        r = rnd(r, 3) if r is not None else 0.0
        if abs(r) > 0.5:
            s = "very_strong" if abs(r) > 0.9 else "strong" if abs(r) > 0.7 else "moderate"
            rows.append((a, b, r, s, "positive" if r > 0 else "negative"))
    rows.sort(key=lambda t: -abs(t[2]))
    return _records(df, rows[:k], "col1 string, col2 string, correlation double, strength string, direction string")


def vif(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Variance inflation: the diagonal of the inverse correlation matrix (complete rows), capped at 999.9."""
    import numpy as np

    cols = list(columns or numeric_cols(df))
    rs = correlations(df, cols, complete=True)
    m = np.eye(len(cols))
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            m[i, j] = m[j, i] = rs[(a, cols[j])] or 0.0
    diag = np.diag(np.linalg.pinv(m, hermitian=True))
    rows = []
    for n, d in zip(cols, map(float, diag)):
        r2 = max(0.0, 1 - 1 / d) if d > 0 else 1.0
        rows.append((n, 999.9 if r2 >= 0.999 else rnd(1.0 / (1.0 - r2), 2)))
    return _records(df, rows, "column string, vif double")


# ---------------------------------------------------------------- whole table

def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, cells, columns per type, duplicates, missing cells."""
    cols = flat_cols(df)
    got, dup = shared(df, [lambda d: stats_row(d, {"n": F.count(F.lit(1)), **{n: count_if(is_missing(d, n, False)) for n in cols}}),
                           duplicate_count])
    miss = sum(got[n] for n in cols)
    n, k = got["n"], len(df.columns)
    return _records(df, [(n, k, n * k, len(numeric_cols(df)), len(text_cols(df)), len(date_cols(df)),
                          sum(is_bool(df, x) for x in df.columns), dup, pct(dup, n), miss, pct(miss, n * k))],
                    "total_rows bigint, total_columns int, total_cells bigint, numeric_columns int, "
                    "text_columns int, date_columns int, boolean_columns int, duplicate_rows bigint, "
                    "duplicate_pct double, missing_cells bigint, missing_pct double")


def dataset_summary(df: DataFrame) -> DataFrame:
    """Missing cells, duplicate rows and 1.5·IQR outlier cells of a table."""
    cols = flat_cols(df)
    got, out, dup = shared(df, [
        lambda d: stats_row(d, {"n": F.count(F.lit(1)), **{n: count_if(is_missing(d, n, False)) for n in cols}}),
        lambda d: beyond_counts(d, numeric_cols(d)), duplicate_count])
    return _records(df, [(got["n"], len(df.columns), sum(got[n] for n in cols), dup, sum(out.values()))],
                    "total_rows bigint, total_columns int, missing_cells bigint, duplicate_rows bigint, "
                    "outlier_cells bigint")


def group_mean(df: DataFrame, x: str, y: str, k: int | None = None) -> DataFrame:
    """Mean and count of y for every group of x, or for the k largest groups (ties: the smaller label)."""
    out = (df.where(c(x).isNotNull()).groupBy(c(x).alias("label"))
           .agg(F.round(F.avg(num(df, y)), 2).alias("mean"), F.count(num(df, y)).alias("n")))
    return out if k is None else out.orderBy(F.desc("n"), "label").limit(k)


def scatter_points(df: DataFrame, key: str, x: str, y: str, k: int = 100) -> DataFrame:
    """k complete (x, y) pairs, drawn by the hash of their key."""
    pairs_ = df.select(c(key).alias("k"), num(df, x).alias("x"), num(df, y).alias("y")).dropna(subset=["x", "y"])
    return plot_sample(pairs_, "k", k).select("x", "y")


def full_profile(df: DataFrame) -> DataFrame:
    """All sections in one long table: (section, subject, metric, value).

    The sections are made side by side over shared scans; only their bounded rows are put together."""
    from .quality import quality_report
    from .recommend import recommendations

    nums = numeric_cols(df)
    sections = [("overview", overview, [])]
    if nums:
        sections.append(("columns", lambda d: profile_numeric(d, nums), ["column"]))
    if text_cols(df):
        sections.append(("columns", profile_text, ["column"]))
    sections += [("columns", lambda d, n=n: profile_date(d, n), ["column"]) for n in date_cols(df)]
    if len(nums) >= 2:
        sections.append(("correlations", lambda d: corr_top_pairs(d, nums), ["col1", "col2"]))
    if len(nums) > 2:
        sections.append(("vif", lambda d: vif(d, nums), ["column"]))
    sections += [("missing", missing_by_column, ["column"]), ("missing_pattern", missing_pattern, [])]
    if nums:
        sections.append(("outliers", lambda d: outliers_simple(d, nums), ["column"]))
    sections += [("quality", quality_report, []), ("recommendations", recommendations, ["kind", "column"])]
    out = None
    for (section, _, subject), report in zip(sections, shared(df, [make for _, make, _ in sections]), strict=True):
        who = F.concat_ws(", ", *[c(n) for n in subject]) if subject else F.lit("table")
        cells = F.array(*[F.struct(F.lit(n).alias("metric"), c(n).cast("string").alias("value")) for n in report.columns if n not in subject])
        part = report.select(F.lit(section).alias("section"), who.alias("subject"), F.inline(cells))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("value").isNotNull())
