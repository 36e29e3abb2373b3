"""Rule-based recommendations with impact and effort, and applying the critical ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import (DATE_WORDS_WIDE, c, count_if, flat_cols, is_missing, is_numeric, name_has, num,
                              numeric_cols, parse_number, strip, text_cols)
from ..functions.dates import parse_date
from ..functions.gather import shared
from ..functions.stats import correlations, distinct_counts, rows_to_df, sample_skew, stats_row
from .clean import duplicate_count, fences, remove_duplicates
from .columns import binary_column_names
from .quality import variant_columns

SCHEMA = ("category string, kind string, column string, affected bigint, impact int, effort int, priority double, "
          "fix string")
ORDER = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}


def _row(category, kind, column, affected, impact, effort, priority, fix):
    return (category, kind, column, affected, impact, effort, float(priority), fix)


def missing_stats(df: DataFrame) -> dict:
    cols = flat_cols(df)
    aggs = {"n": F.count(F.lit(1))}
    for n in cols:
        aggs.update({("m", n): count_if(is_missing(df, n, False)), ("lo", n): F.min(c(n)), ("hi", n): F.max(c(n))})
    return stats_row(df, aggs)


def critical(df: DataFrame, got: dict | None = None) -> list[tuple]:
    """Empty columns, over half missing, at least 5 % duplicate rows, constant columns."""
    got, cols = got or missing_stats(df), flat_cols(df)
    n = got["n"]
    rows = [_row("Critical", "empty_column", x, n, 10, 1, 10, "drop_column") for x in cols if got[("m", x)] == n]
    rows += [_row("Critical", "mostly_missing", x, got[("m", x)], 9, 2, 4.5, "drop_column") for x in cols
             if n and 50.0 < got[("m", x)] / n * 100 < 100.0]
    dup = duplicate_count(df)
    if n and dup / n * 100 >= 5.0:
        rows.append(_row("Critical", "duplicate_rows", "ALL", dup, 10, 1, 10, "drop_duplicates"))
    rows += [_row("Critical", "constant_column", x, n, 9, 1, 9, "drop_column") for x in cols
             if got[("m", x)] < n and got[("lo", x)] == got[("hi", x)]]
    return rows


def numeric_text(df: DataFrame) -> list[tuple]:
    cols = text_cols(df)
    aggs = {}
    for n in cols:
        aggs[("k", n)] = F.count(c(n))
        aggs[("v", n)] = F.count(parse_number(strip(F.regexp_replace(c(n), r"[\$,%]", ""))))
    got = stats_row(df, aggs) if cols else {}
    return [_row("High", "numeric_as_text", n, got[("k", n)], 8, 1, 8, "cast_type") for n in cols
            if got[("k", n)] and got[("v", n)] / got[("k", n)] >= 0.85]


def date_text(df: DataFrame) -> list[tuple]:
    cols = [n for n in text_cols(df) if name_has(n, DATE_WORDS_WIDE)]
    got = stats_row(df, {"n": F.count(F.lit(1)), **{n: F.count(parse_date(c(n))) for n in cols}}) if cols else {}
    return [_row("High", "date_as_text", n, got[n], 8, 2, 4, "parse_dates") for n in cols if got[n] >= 0.7 * got["n"]]


def impute(df: DataFrame, got: dict | None = None) -> list[tuple]:
    got = got or missing_stats(df)
    n = max(got["n"], 1)
    return [_row("High", "impute", x, got[("m", x)], 8, 2, 4, "knn_impute" if is_numeric(df, x) else "fill_missing")
            for x in flat_cols(df) if 10.0 <= got[("m", x)] / n * 100 <= 50.0]


def high_cardinality(df: DataFrame) -> list[tuple]:
    """Text columns with over 90 % distinct values: a sketch screens, exact counts confirm."""
    cols = text_cols(df)
    got = stats_row(df, {"n": F.count(F.lit(1)), **{n: F.approx_count_distinct(c(n), 0.02) for n in cols}})
    n = got["n"]
    if n <= 30:
        return []
    maybe = [x for x in cols if got[x] / n > 0.75]
    uniq = distinct_counts(df, maybe)
    return [_row("High", "high_cardinality", x, n, 7, 1, 7, "drop_column") for x in maybe if uniq[x] / n > 0.90]


def skewed(df: DataFrame) -> list[tuple]:
    cols = numeric_cols(df)
    aggs = {}
    for n in cols:
        x = num(df, n)
        aggs.update({("k", n): F.count(x), ("lo", n): F.min(x), ("s", n): sample_skew(x)})
    got = stats_row(df, aggs) if cols else {}
    return [_row("High", "skewed", n, got[("k", n)], 7, 2, 3.5, "scale_log") for n in cols
            if got[("k", n)] > 10 and got[("lo", n)] > 0 and (got[("s", n)] or 0.0) > 2.0]


def outliers(df: DataFrame) -> list[tuple]:
    cols = numeric_cols(df)
    fs = {n: f for n, f in fences(df, cols, fallback=False).items() if f.iqr > 0}
    aggs = {}
    for n, f in fs.items():
        x = num(df, n)
        aggs.update({("k", n): F.count(x), ("o", n): count_if((x < f.lower) | (x > f.upper))})
    got = stats_row(df, aggs) if fs else {}
    return [_row("High", "outliers", n, got[("o", n)], 7, 2, 3.5, "winsorize") for n in fs
            if got[("k", n)] > 10 and got[("o", n)] / got[("k", n)] * 100 >= 5.0]


def variants(df: DataFrame, limit: int = 40) -> list[tuple]:
    """Columns of at most ``limit`` values with several spellings of one."""
    cols = text_cols(df)
    if not cols:
        return []
    hit = set(variant_columns(df, cols, limit))
    got = stats_row(df, {n: F.count(c(n)) for n in cols if n in hit}) if hit else {}
    return [_row("Medium", "category_variants", n, got[n], 6, 1, 6, "standardize_categories") for n in cols if n in hit]


def whitespace(df: DataFrame) -> list[tuple]:
    cols = text_cols(df)
    got = stats_row(df, {n: count_if(c(n) != strip(c(n))) for n in cols}) if cols else {}
    return [_row("Medium", "whitespace", n, got[n], 5, 1, 5, "clean_text") for n in cols if got[n]]


def collinear(df: DataFrame, rows: int) -> list[tuple]:
    rs = correlations(df, numeric_cols(df))
    return [_row("Medium", "collinear", b, rows, 6, 2, 3, "drop_column") for (_, b), r in rs.items()
            if r is not None and abs(r) > 0.85]


def low(df: DataFrame, rows: int) -> list[tuple]:
    """Blanks in column names; 0/1 columns that could be booleans."""
    out = []
    spaced = [n for n in df.columns if " " in n]
    if spaced:
        out.append(_row("Low", "blank_in_names", ", ".join(spaced), len(spaced), 3, 1, 3, "rename_columns"))
    out += [_row("Low", "boolean_as_number", n, rows, 3, 1, 3, "cast_bool") for n in binary_column_names(df)]
    return out


def all_rows(df: DataFrame) -> list[tuple]:
    got = missing_stats(df)
    n = got["n"]
    if not n:
        return []
    found = shared(df, [lambda d: critical(d, got), numeric_text, date_text, lambda d: impute(d, got), high_cardinality, skewed, outliers,
                        variants, whitespace, lambda d: collinear(d, n), lambda d: low(d, n)])
    rows = [r for part in found for r in part]
    return sorted(rows, key=lambda r: (ORDER[r[0]], -r[6]))


def table(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return rows_to_df(df.sparkSession, rows, SCHEMA)


def recommendations(df: DataFrame) -> DataFrame:
    """All recommendations, critical ones first, then by priority."""
    return table(df, all_rows(df))


def quick_wins(df: DataFrame) -> DataFrame:
    """Little effort (at most 2), much impact (at least 7)."""
    return recommendations(df).where("effort <= 2 and impact >= 7")


def apply_critical(df: DataFrame) -> DataFrame:
    """Drop the columns and duplicate rows the critical recommendations name."""
    rows = critical(df)
    df = df.drop(*[r[2] for r in rows if r[7] == "drop_column"])
    return remove_duplicates(df) if any(r[7] == "drop_duplicates" for r in rows) else df
