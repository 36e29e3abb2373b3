"""Cleaning recipes: lists of steps, folded over a DataFrame.

Row-wise steps only add expressions, so runs of them execute as one plan; a step that needs
statistics of the current data adds one aggregate job.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import c, count_if, flat_cols, ID_WORDS, is_missing, is_text, name_has, num, numeric_cols
from ..functions.stats import plan_bytes, rows_to_df, stats_row
from ..operators import clean, columns
from ..operators.profile import detect_types

# The preset recipes.
PRESETS = {
    "Sales Data": [
        {"operation": "trim_whitespace"},
        {"operation": "remove_duplicates"},
        {"operation": "fill_all_missing"},
        {"operation": "fix_outliers_all", "method": "cap"},
    ],
    "HR Data": [
        {"operation": "trim_whitespace"},
        {"operation": "remove_duplicates"},
        {"operation": "fill_all_missing"},
        {"operation": "standardize_case_all", "case": "title"},
    ],
    "Healthcare Data": [
        {"operation": "trim_whitespace"},
        {"operation": "remove_duplicates"},
        {"operation": "fill_all_missing"},
        {"operation": "fix_outliers_all", "method": "remove"},
    ],
    "Finance Data": [
        {"operation": "trim_whitespace"},
        {"operation": "remove_duplicates"},
        {"operation": "fill_all_missing"},
        {"operation": "fix_outliers_all", "method": "cap"},
        {"operation": "remove_constant_columns"},
    ],
}


def _trim(df, s):
    new = clean.trim_plan(df, s.get("column"))
    return (df.withColumns(new) if new else df), lambda: clean.changed_cells(df, new)


def _case(case=None):
    def run(df, s):
        new = clean.case_plan(df, s.get("column"), case or s.get("case") or s.get("method") or "lower")
        return (df.withColumns(new) if new else df), lambda: clean.changed_cells(df, new)
    return run


def _dedup(df, s):
    return clean.remove_duplicates(df), lambda: clean.duplicate_count(df)


def _fill_all(df, s):
    new, filled = clean.fill_plan(df)
    return (df.withColumns(new) if new else df), lambda: filled


def _fill(method):
    def run(df, s):
        n = s.get("column")
        if not n or n not in df.columns:
            return _fill_all(df, s)
        return clean.fill_missing(df, n, method), lambda: stats_row(df, {"k": count_if(is_missing(df, n))})["k"]
    return run


def is_identifier(name: str) -> bool:
    """Names of keys and codes: their numbers have no outliers to cap."""
    return name_has(name, ID_WORDS, suffix_from=3)


def _outliers(method=None):
    def run(df, s):
        how = method or s.get("method") or "cap"
        if how != "remove":
            cols = [n for n in numeric_cols(df) if not is_identifier(n)]
            fs = clean.fences(df, cols)
            out = df
            for n, f in fs.items():
                out = clean.fix_outliers(out, n, how, fence=f)
            return out, lambda: sum(stats_row(
                df, {n: count_if(clean.is_outlier(num(df, n), f)) for n, f in fs.items()}).values()) if fs else 0
        out, hits = df, []
        for n in numeric_cols(df):  # each removal changes the next column's quartiles
            f = clean.fences(out, [n]).get(n)
            if f is not None:
                hits.append((out, n, f))
                out = clean.fix_outliers(out, n, "remove", fence=f)
        return out, lambda: sum(stats_row(d, {"k": count_if(clean.is_outlier(num(d, n), f))})["k"]
                                for d, n, f in hits)
    return run


def _drop(names: Callable[[DataFrame], list[str]]):
    def run(df, s):
        gone = names(df)
        return df.drop(*gone), lambda: len(gone)
    return run


STEPS: dict[str, Callable] = {
    "trim_whitespace": _trim,
    "remove_duplicates": _dedup,
    "fill_all_missing": _fill_all,
    "fill_missing_mean": _fill("mean"),
    "fill_missing_mode": _fill("mode"),
    "fill_missing_median": _fill("median"),
    "fix_outliers_cap": _outliers("cap"),
    "fix_outliers_remove": _outliers("remove"),
    "fix_outliers_all": _outliers(),
    "fix_outliers": _outliers(),
    "standardize_case_title": _case("title"),
    "standardize_case_all": _case(),
    "standardize_case": _case(),
    "remove_constant_columns": _drop(columns.constant_column_names),
    "remove_empty_columns": _drop(columns.empty_column_names),
}

# A plan is cut to storage between statistics steps once it reads more than this.
CUT_BYTES = 256 << 20


def _settle(df: DataFrame) -> DataFrame:
    """Shuffling steps are written out on big inputs, so the statistics jobs of later steps do not repeat them."""
    from ..session import cut_lineage

    size = plan_bytes(df)
    return df if size is not None and size <= CUT_BYTES else cut_lineage(df)


def run_steps(df: DataFrame, steps: list[dict], report: bool = False):
    """Apply the steps in order; with ``report``, also a table of the cells or rows each one touched."""
    log = []
    for i, s in enumerate(steps, 1):
        op = s["operation"]
        if op not in STEPS:
            raise ValueError(f"unknown step {op!r}")
        df, affected = STEPS[op](df, s)
        if report:
            log.append((i, op, int(affected() or 0)))
        if op == "remove_duplicates":
            df = _settle(df)
    if report:
        return df, rows_to_df(df.sparkSession, log, "step int, operation string, affected bigint")
    return df


def run_preset(df: DataFrame, name: str, report: bool = False):
    return run_steps(df, PRESETS[name], report)


def auto_clean(df: DataFrame, report: bool = False):
    """Empty columns, constant columns, duplicates, whitespace, missing cells, outliers, dates."""
    first = ["remove_empty_columns", "remove_constant_columns", "remove_duplicates", "trim_whitespace",
             "fill_all_missing"]
    got = run_steps(df, [{"operation": op} for op in first], report)
    df, log = got if report else (got, None)
    types = detect_types(df)
    nums = [n for n in df.columns if types.get(n) == "number"]
    fs = clean.fences(df, nums)
    capped = df
    for n in nums:
        if n in fs and not is_identifier(n):
            capped = clean.fix_outliers(capped, n, "cap", fence=fs[n])
        elif is_text(df, n):
            capped = capped.withColumn(n, num(df, n))
    dates = [n for n in flat_cols(df) if types.get(n) == "date" and is_text(df, n)]
    out = capped
    for n in dates:
        out = clean.convert_dates(out, n)
    if not report:
        return out
    from ..functions.dates import parse_date

    k = sum(stats_row(df, {n: count_if(clean.is_outlier(num(df, n), f)) for n, f in fs.items()}).values()) if fs else 0
    d = sum(stats_row(capped, {n: F.count(parse_date(c(n))) for n in dates}).values()) if dates else 0
    more = rows_to_df(df.sparkSession, [(6, "fix_outliers", k), (7, "convert_dates", d)],
                      "step int, operation string, affected bigint")
    return out, log.unionByName(more)


# ---------------------------------------------------------------- saved recipes

RECIPE_SCHEMA = "name string, steps string, step_count int, is_preset boolean"


def preset_table(spark: SparkSession) -> DataFrame:
    return rows_to_df(spark, [(n, json.dumps(s), len(s), True) for n, s in PRESETS.items()], RECIPE_SCHEMA)


def save_recipe(spark: SparkSession, path: str, name: str, steps: list[dict]) -> None:
    """Append a named step list to a small Parquet table."""
    for s in steps:
        if s["operation"] not in STEPS:
            raise ValueError(f"unknown step {s['operation']!r}")
    rows_to_df(spark, [(name, json.dumps(steps), len(steps), False)], RECIPE_SCHEMA).write.mode("append").parquet(path)


def list_recipes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Presets and saved recipes."""
    t = preset_table(spark)
    return t.unionByName(spark.read.schema(RECIPE_SCHEMA).parquet(path)) if path else t


def load_recipe(spark: SparkSession, path: str, name: str) -> list[dict]:
    r = list_recipes(spark, path).where(F.col("name") == name).select("steps").limit(1).collect()
    if not r:
        raise ValueError(f"no recipe named {name!r}")
    return json.loads(r[0]["steps"])
