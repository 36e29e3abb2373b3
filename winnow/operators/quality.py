"""Quality scores, issue lists and column relationships."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import (EMAIL_WORDS, PERCENT_WORDS, PHONE_WORDS, POSITIVE_WORDS, QUALITY_DATE_WORDS, c, count_if,
                              flat_cols, is_date, is_missing, is_numeric, is_text, name_has, num,
                              numeric_cols, parse_number, sentinel, strip, text_cols)
from ..functions.dates import as_date, parse_date
from ..functions.gather import bounded_rows, shared, together
from ..functions.gram import pair_matches
from ..functions.pii import EMAIL_QUALITY
from ..functions.stats import GRAM_COLUMNS, correlations, distinct_counts, maybe_few, pairs, rows_to_df, stats_row, value_counts
from ..functions.text import is_lower, is_title, is_upper, title_case
from .clean import duplicate_count, fences
from .columns import constant_column_names
from .profile import beyond_counts, detect_types, gap_count, numeric_like, outlier_counts, pct, rnd


def clamp(x: float, digits: int = 2) -> float:
    return max(0.0, min(100.0, rnd(x, digits)))


# ---------------------------------------------------------------- single checks

def inconsistent_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that mix at least two of upper, lower and title case (sentinels left out)."""
    cols = list(columns or text_cols(df))
    aggs = {}
    for n in cols:
        v = F.when(~sentinel(c(n)), c(n))
        for k, f in (("u", is_upper), ("l", is_lower), ("t", is_title)):
            aggs[(k, n)] = F.coalesce(F.bool_or(f(v)), F.lit(False))
        aggs[("k", n)] = F.count(c(n))
    got = stats_row(df, aggs)
    rows = [(n, got[("u", n)], got[("l", n)], got[("t", n)], got[("k", n)]) for n in cols
            if got[("u", n)] + got[("l", n)] + got[("t", n)] >= 2]
    return rows_to_df(df.sparkSession, rows,
                      "column string, has_upper boolean, has_lower boolean, has_title boolean, cells bigint")


def whitespace_issues(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cells with outer whitespace per text column."""
    cols = list(columns or text_cols(df))
    got = stats_row(df, {"n": F.count(F.lit(1)), **{n: count_if(c(n) != strip(c(n))) for n in cols}})
    return rows_to_df(df.sparkSession, [(n, got[n], pct(got[n], got["n"])) for n in cols if got[n]],
                      "column string, count bigint, percentage double")


def duplicate_names(columns: Sequence[str]) -> list[str]:
    """Names that occur again after their first appearance."""
    seen: set[str] = set()
    return [n for n in columns if n in seen or seen.add(n)]


def date_inconsistency(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Date-like text columns that mix slashes, dashes and dots, counted over all rows."""
    if columns is None:
        columns = [n for n, t in detect_types(df).items() if t == "date" and is_text(df, n)]
    aggs = {}
    for n in columns:
        v = strip(c(n))
        aggs.update({("slash", n): count_if(v.contains("/")), ("dash", n): count_if(v.contains("-")),
                     ("dot", n): count_if(v.contains(".") & ~v.rlike(r"^[0-9.]+$")),
                     ("k", n): F.count(c(n))})
    got = stats_row(df, aggs) if columns else {}
    rows = [(n, got[("slash", n)], got[("dash", n)], got[("dot", n)], got[("k", n)]) for n in columns
            if sum(got[(s, n)] > 0 for s in ("slash", "dash", "dot")) > 1]
    return rows_to_df(df.sparkSession, rows,
                      "column string, slash bigint, dash bigint, dot bigint, cells bigint")


def category_variants(df: DataFrame, columns: Sequence[str] | None = None, limit: int = 50) -> DataFrame:
    """Spellings that agree after trimming and lower-casing, in columns of at most ``limit`` values."""
    cols = maybe_few(df, list(columns or text_cols(df)), limit)
    if not cols:
        return rows_to_df(df.sparkSession, [], "column string, normal string, variants bigint, rows bigint, canonical string")
    g = (value_counts(df, cols).groupBy("column", F.lower(strip(F.col("value"))).alias("normal"))
         .agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("rows"), F.min("value").alias("_v")))
    g = g.withColumn("_u", F.sum("variants").over(Window.partitionBy("column"))).where(F.col("_u") <= limit)  # screened: few values
    return g.where("variants > 1").select("column", "normal", "variants", F.col("rows").cast("bigint").alias("rows"),
                                          title_case(strip(F.col("_v"))).alias("canonical"))


def variant_columns(df: DataFrame, columns: Sequence[str] | None = None, limit: int = 50) -> list[str]:
    """The columns that ``category_variants`` has findings for."""
    found = category_variants(df, columns, limit).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["column"] for r in bounded_rows(found))  # one row a column


# ---------------------------------------------------------------- column relationships

def dup_column_pairs(df: DataFrame) -> list[tuple[str, str]]:
    """Pairs of same-typed columns with equal cells in every row.

    Checksums rule out almost all pairs; only equal ones are compared cell by cell."""
    todo = _same_type_pairs(df)
    sums = stats_row(df, {n: _checksum(n) for n in {x for p in todo for x in p}}) if todo else {}
    maybe = [(a, b) for a, b in todo if sums[a] == sums[b]]
    same = stats_row(df, {p: F.bool_and(c(p[0]).eqNullSafe(c(p[1]))) for p in maybe}) if maybe else {}
    return [p for p in maybe if same[p]]


def dup_column_report(df: DataFrame) -> DataFrame:
    return rows_to_df(df.sparkSession, dup_column_pairs(df), "col1 string, col2 string")


def id_lowvar_columns(df: DataFrame) -> DataFrame:
    """(column, kind): constant, id (text, all distinct) or low_variance (std below 1 % of |mean|)."""
    cols = flat_cols(df)
    aggs = {"n": F.count(F.lit(1))}
    for n in numeric_cols(df):
        aggs.update({("m", n): F.avg(num(df, n)), ("s", n): F.stddev_samp(num(df, n))})
    for n in cols:
        aggs.update({("lo", n): F.min(c(n)), ("hi", n): F.max(c(n)), ("k", n): F.count(c(n))})
    got = stats_row(df, aggs)
    uniq = distinct_counts(df, [n for n in text_cols(df) if got[("k", n)] == got["n"]])
    rows = []
    for n in cols:
        if not got[("k", n)]:
            continue
        if got[("lo", n)] == got[("hi", n)]:
            rows.append((n, "constant"))
        elif uniq.get(n) == got["n"]:
            rows.append((n, "id"))
        elif is_numeric(df, n):
            m, s = got[("m", n)], got[("s", n)]
            if m and s is not None and not math.isnan(s) and s < 0.01 * abs(m):
                rows.append((n, "low_variance"))
    return rows_to_df(df.sparkSession, rows, "column string, kind string")


def _ratio(a: str, b: str) -> float:
    import difflib

    return difflib.SequenceMatcher(None, a, b).ratio()


def similar_columns(df: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Column pairs with similar names, or with mostly equal cells in the same row."""
    cols = flat_cols(df)
    norm = {n: "".join(ch for ch in n.lower() if ch.isascii() and ch.isalnum()) for n in cols}
    t = {n: F.lower(strip(c(n).cast("string"))) for n in cols}
    if len(cols) >= GRAM_COLUMNS:  # one comparison of arrays a batch instead of two expressions a pair
        both, same = pair_matches(df, list(t.values()))
        got = {(a, b): (float(both[i, j]), float(same[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j}
    else:
        aggs = {p: F.struct(count_if(t[p[0]].isNotNull() & t[p[1]].isNotNull()), count_if(t[p[0]] == t[p[1]])) for p in pairs(cols)}
        got = stats_row(df, aggs)
    rows = []
    for a, b in pairs(cols):
        name = _ratio(norm[a], norm[b])
        n, k = got[a, b]
        val = k / n if n else 0.0
        if max(name, val) >= threshold:
            rows.append((a, b, round(max(name, val) * 100, 1), round(name * 100, 1), round(val * 100, 1)))
    return rows_to_df(df.sparkSession, rows, "col1 string, col2 string, similarity double, "
                                             "name_similarity double, value_overlap double")


# ---------------------------------------------------------------- issue list and scores v1 / v3

# What to do about each kind of finding.
ADVICE = (
    ("missing", "Fill or remove missing values to improve data completeness"),
    ("duplicates", "Remove duplicate rows"),
    ("outliers", "Review and handle outlier values"),
    ("empty", "Remove columns that are mostly empty"),
    ("text", "Standardize text casing in affected columns"),
    ("space", "Trim whitespace from text columns"),
)

ISSUE_SCHEMA = "issue_type string, severity string, column string, affected bigint, operation string, method string"


def _issue_parts(df: DataFrame) -> dict:
    """What the issue list and its scores need.  Typed numbers do not wait for the types of text columns."""
    nums, cols = numeric_cols(df), flat_cols(df)

    def missing(d: DataFrame) -> dict:
        return stats_row(d, {"n": F.count(F.lit(1)), **{n: count_if(is_missing(d, n)) for n in cols}})

    def typed(d: DataFrame) -> tuple:
        types = detect_types(d)
        like = numeric_like(d, types)
        dates = [x for x, t in types.items() if t == "date" and is_text(d, x)]
        return (types, like, *together(lambda: outlier_counts(d, [n for n in like if n not in nums]),
                                       lambda: _records(date_inconsistency(d, dates), "cells") if dates else {}))

    got, (types, like, more, dates), known, dup, constant, text, space = shared(df, [
        missing, typed, lambda d: outlier_counts(d, nums), duplicate_count, constant_column_names,
        lambda d: _records(inconsistent_text(d), "cells"), lambda d: _records(whitespace_issues(d), "count")])
    n, found = got["n"], {**known, **more}
    return {
        "rows": n, "cols": cols, "types": types, "missing": {x: got[x] for x in cols if got[x]}, "duplicates": dup,
        "outliers": {x: found[x] for x in like if found.get(x)},
        "empty": [x for x in cols if n and round(got[x] / n * 100, 2) >= 80],
        "constant": constant, "text": text, "space": space, "names": duplicate_names(df.columns), "dates": dates,
    }


def _records(report: DataFrame, value: str) -> dict:
    """{column: value} of a report that is already on the driver."""
    return {r["column"]: r[value] for r in report.collect()}


def _issues(p: dict) -> list[tuple]:
    n, rows = p["rows"], []
    for x, k in p["missing"].items():
        share = round(k / n * 100, 2)
        sev = "critical" if share > 50 else "warning" if share > 10 else "info"
        rows.append(("missing_values", sev, x, k, "fill_missing", "mean"))
    if p["duplicates"]:
        sev = "critical" if p["duplicates"] >= n * 0.1 else "warning"
        rows.append(("duplicate_rows", sev, None, p["duplicates"], "remove_duplicates", None))
    rows += [("outliers", "warning", x, k, "fix_outliers", "cap") for x, k in p["outliers"].items()]
    rows += [("empty_columns", "critical", x, 1, "remove_empty_columns", None) for x in p["empty"]]
    rows += [("constant_columns", "info", x, 1, "remove_constant_columns", None) for x in p["constant"]]
    rows += [("inconsistent_text", "warning", x, k, "standardize_case", "lower") for x, k in p["text"].items()]
    rows += [("whitespace", "warning", x, k, "trim_whitespace", None) for x, k in p["space"].items()]
    if p["names"]:
        rows.append(("duplicate_columns", "warning", None, len(p["names"]), None, None))
    rows += [("date_inconsistency", "warning", x, k, "convert_dates", None) for x, k in p["dates"].items()]
    return rows


def _score_v1(p: dict) -> float:
    n, cells = p["rows"], p["rows"] * len(p["cols"])
    if not cells:
        return 0.0
    other = sum(len(p[k]) for k in ("text", "space", "empty", "constant", "names", "dates"))
    s = 100.0 - sum(p["missing"].values()) / cells * 40 - p["duplicates"] / n * 20 \
        - sum(p["outliers"].values()) / n * 100 - other
    return clamp(s)


def issue_list(df: DataFrame) -> DataFrame:
    """Every finding with severity and the operation that addresses it."""
    return rows_to_df(df.sparkSession, _issues(_issue_parts(df)), ISSUE_SCHEMA)


def quality_score_v1(df: DataFrame) -> DataFrame:
    return rows_to_df(df.sparkSession, [(_score_v1(_issue_parts(df)),)], "quality_score double")


def full_report(df: DataFrame) -> DataFrame:
    """Summary counts, score and the recommendations that apply, as one row."""
    p = _issue_parts(df)
    advice = [text for key, text in ADVICE if p[key]]
    row = (_score_v1(p), len(_issues(p)), len(p["missing"]), sum(p["missing"].values()), p["duplicates"],
           len(p["outliers"]), sum(p["outliers"].values()), len(p["text"]) + len(p["space"]), len(p["empty"]),
           len(p["constant"]), p["rows"], len(p["cols"]), p["rows"] * len(p["cols"]), "; ".join(advice))
    return rows_to_df(df.sparkSession, [row],
                      "quality_score double, total_issues int, missing_columns int, missing_cells bigint, "
                      "duplicate_rows bigint, outlier_columns int, outlier_cells bigint, text_issues int, "
                      "empty_columns int, constant_columns int, total_rows bigint, total_columns int, "
                      "total_cells bigint, recommendations string")


def quality_score_v3(df: DataFrame) -> DataFrame:
    """Score from native NULLs, duplicates and the number of issues (at most 20 points)."""
    cols = flat_cols(df)
    aggs = {"n": F.count(F.lit(1)), **{("m", n): count_if(is_missing(df, n, False)) for n in cols},
            **{("w", n): count_if(c(n) != strip(c(n))) for n in text_cols(df)}}
    got, out, dup = shared(df, [lambda d: stats_row(d, aggs), lambda d: beyond_counts(d, numeric_cols(d)), duplicate_count])
    rows = got["n"]
    miss = sum(got[("m", n)] for n in cols)
    issues = sum(got[("m", n)] > 0 for n in cols) + (dup > 0) + sum(v > 0 for v in out.values()) \
        + sum(got[("w", n)] > 0 for n in text_cols(df))
    cells = rows * len(cols)
    score = 100.0 if not cells else clamp(100 - miss / cells * 40 - dup / max(rows, 1) * 20 - min(issues * 2, 20), 1)
    return rows_to_df(df.sparkSession, [(score, issues, miss, dup)],
                      "quality_score double, total_issues int, missing_total bigint, duplicate_rows bigint")


# ---------------------------------------------------------------- six quality dimensions

# Weight of each dimension in the overall score.
WEIGHTS = (("completeness", 0.30), ("consistency", 0.20), ("accuracy", 0.20), ("uniqueness", 0.15),
           ("validity", 0.10), ("timeliness", 0.05))


def grade(score: float) -> str:
    for floor, g in ((90, "A"), (80, "B"), (70, "C"), (60, "D")):
        if score >= floor:
            return g
    return "F"


def _checksum(n: str):
    h = F.xxhash64(c(n))
    return F.struct(F.bit_xor(h), F.count(c(n)), F.sum(F.pmod(h, F.lit(1 << 20))))


def _same_type_pairs(df: DataFrame) -> list[tuple[str, str]]:
    types = dict(df.dtypes)
    return [(a, b) for a, b in pairs(flat_cols(df)) if types[a] == types[b]]


def quality_metrics(df: DataFrame) -> dict:
    """All six dimensions.  One aggregate answers everything that needs no fence, together with the first steps of quartiles, duplicates
    and spellings; later rounds count outliers, compare columns whose checksums agree and look for date gaps."""
    cols, nums, texts = flat_cols(df), numeric_cols(df), text_cols(df)
    named = [n for n in texts if name_has(n, QUALITY_DATE_WORDS)]
    aggs: dict = {"n": F.count(F.lit(1))}
    for n in cols:
        aggs[("miss", n)] = count_if(is_missing(df, n, False))
    for n in {x for p in _same_type_pairs(df) for x in p}:
        aggs[("sum", n)] = _checksum(n)
    for n in nums:
        x = num(df, n)
        aggs[("k", n)] = F.count(x)
        if name_has(n, POSITIVE_WORDS):
            aggs[("neg", n)] = count_if(x < 0)
        if name_has(n, PERCENT_WORDS):
            aggs[("over", n)] = count_if(x > 100)
    for n in texts:
        x = c(n)
        aggs.update({
            ("k", n): F.count(x), ("at", n): count_if(x.contains("@")), ("mail", n): count_if(~x.rlike(EMAIL_QUALITY)),
            ("num", n): F.count(parse_number(strip(F.regexp_replace(x, r"[\$,%]", "")))),
            ("ws", n): count_if(x != strip(x))})
        if name_has(n, PHONE_WORDS):
            digits = F.regexp_replace(x, r"[\s().-]", "")
            aggs[("phone", n)] = count_if(~digits.rlike(r"^[0-9]+$"))
    for n in [x for x in df.columns if is_date(df, x)] + named:
        ts = as_date(df, n)
        aggs.update({("dated", n): F.count(ts), ("lo", n): F.date_format(F.min(ts), "yyyy-MM-dd"),
                     ("hi", n): F.date_format(F.max(ts), "yyyy-MM-dd")})
    pairs_ = _same_type_pairs(df)

    def counted(d: DataFrame) -> tuple:
        got = stats_row(d, aggs)
        maybe = [p for p in pairs_ if got[("sum", p[0])] == got[("sum", p[1])]]
        dates = [n for n in d.columns if is_date(d, n) or (n in named and got[("dated", n)] > 0.6 * got["n"])]
        same, gaps = together(
            lambda: stats_row(d, {p: F.bool_and(c(p[0]).eqNullSafe(c(p[1]))) for p in maybe}) if maybe else {},
            lambda: gap_count(d, dates[0]) > 0 if dates and got["n"] else False)
        return got, sum(bool(x) for x in same.values()), dates, gaps

    def far(d: DataFrame) -> dict:
        fs = {n: f for n, f in fences(d, nums, fallback=False).items() if f.iqr > 0}
        return beyond_counts(d, nums, fs)

    (got, same, dates, gaps), beyond, dup, cats = shared(df, [
        counted, far, duplicate_count, lambda d: len(variant_columns(d, texts)) if texts else 0])
    rows = got["n"]
    if not rows:
        zero = {k: {"score": 0.0} for k, _ in WEIGHTS}
        return {**zero, "overall": {"score": 0.0, "grade": "F"}}

    cells = sum(got[("miss", n)] for n in cols)
    miss_pct = pct(cells, rows * len(cols))
    dup_pct = pct(dup, rows)
    out = sum(k for n, k in beyond.items() if got[("k", n)] > 4)
    out_pct = pct(out, len(nums) * rows) if nums else 0.0
    suspicious = sum(1 for k in got if k[0] in ("neg", "over") and got[k])
    bad_types = sum(1 for n in texts if got[("k", n)] and got[("num", n)] > 0.8 * got[("k", n)])
    spaces = sum(1 for n in texts if got[("ws", n)])
    mails = phones = 0
    for n in texts:
        if name_has(n, EMAIL_WORDS) or (got[("k", n)] and got[("at", n)] > 0.5 * got[("k", n)]):
            mails += got[("mail", n)]
        elif ("phone", n) in got:
            phones += got[("phone", n)]
    penalty = min(50.0, mails * 3.0) + min(30.0, phones * 3.0) + min(20.0, suspicious * 5.0)

    m = {
        "completeness": {"score": clamp(100.0 - miss_pct * 1.5), "rows": rows, "missing_cells": cells,
                         "missing_pct": miss_pct},
        "uniqueness": {"score": clamp(100.0 - dup_pct * 2.0 - same * 10.0), "duplicate_rows": dup,
                       "duplicate_pct": dup_pct, "duplicate_columns": same},
        "accuracy": {"score": clamp(100.0 - min(40.0, out_pct * 1.5) - min(40.0, suspicious * 8.0)),
                     "outliers": out, "outlier_pct": out_pct, "suspicious": suspicious},
        "consistency": {"score": clamp(100.0 - bad_types * 10.0 - cats * 10.0 - spaces * 5.0),
                        "type_mismatches": bad_types, "inconsistent_categories": cats, "format_issues": spaces},
        "validity": {"score": clamp(100.0 - penalty), "invalid_emails": mails, "invalid_phones": phones,
                     "rule_failures": suspicious},
        "timeliness": {"score": 85.0 if gaps else 100.0, "date_columns": len(dates),
                       "oldest": got[("lo", dates[0])] if dates else None,
                       "newest": got[("hi", dates[0])] if dates else None, "gaps": gaps},
    }
    overall = clamp(sum(m[k]["score"] * w for k, w in WEIGHTS), 1)
    m["overall"] = {"score": overall, "grade": grade(overall)}
    return m


DIMENSION_SCHEMAS = {
    "completeness": "score double, rows bigint, missing_cells bigint, missing_pct double",
    "uniqueness": "score double, duplicate_rows bigint, duplicate_pct double, duplicate_columns int",
    "accuracy": "score double, outliers bigint, outlier_pct double, suspicious int",
    "consistency": "score double, type_mismatches int, inconsistent_categories int, format_issues int",
    "validity": "score double, invalid_emails bigint, invalid_phones bigint, rule_failures int",
    "timeliness": "score double, date_columns int, oldest string, newest string, gaps boolean",
}


def dimension(df: DataFrame, name: str) -> DataFrame:
    """One quality dimension with the counts behind its score."""
    return rows_to_df(df.sparkSession, [tuple(quality_metrics(df)[name].values())], DIMENSION_SCHEMAS[name])


def quality_report(df: DataFrame) -> DataFrame:
    """One row: the six dimension scores, the weighted overall score and its grade."""
    m = quality_metrics(df)
    row = tuple(m[k]["score"] for k, _ in WEIGHTS) + (m["overall"]["score"], m["overall"]["grade"])
    return rows_to_df(df.sparkSession, [row], ", ".join(f"{k} double" for k, _ in WEIGHTS)
                      + ", overall double, grade string")


IMPROVEMENT_SCHEMA = "action string, amount bigint, impact int, difficulty string"


def improvements_from(m: dict) -> list[tuple]:
    c_, u, a = m["completeness"], m["uniqueness"], m["accuracy"]
    rows = []
    if c_["missing_cells"]:
        rows.append(("impute_missing", c_["missing_cells"], min(25, int(c_["missing_pct"] * 0.8) + 5), "easy"))
    if u["duplicate_rows"]:
        rows.append(("remove_duplicates", u["duplicate_rows"], min(20, int(u["duplicate_pct"] * 1.5) + 5), "easy"))
    if a["outliers"]:
        rows.append(("handle_outliers", a["outliers"], min(18, int(a["outlier_pct"] * 1.2) + 4), "medium"))
    if m["consistency"]["type_mismatches"]:
        rows.append(("fix_types", m["consistency"]["type_mismatches"], 12, "easy"))
    if m["consistency"]["inconsistent_categories"]:
        rows.append(("standardize_categories", m["consistency"]["inconsistent_categories"], 10, "easy"))
    if a["suspicious"]:
        rows.append(("resolve_domain_violations", a["suspicious"], 15, "medium"))
    if m["validity"]["invalid_emails"]:
        rows.append(("clean_emails", m["validity"]["invalid_emails"], 8, "easy"))
    return sorted(rows, key=lambda r: -r[2])


def improvements(df: DataFrame) -> DataFrame:
    """What to fix next, the largest expected gain first."""
    return rows_to_df(df.sparkSession, improvements_from(quality_metrics(df)), IMPROVEMENT_SCHEMA)


def quality_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Overall quality before and after a step."""
    a, b = quality_metrics(before)["overall"]["score"], quality_metrics(after)["overall"]["score"]
    return rows_to_df(before.sparkSession, [(a, b, round(b - a, 2))],
                      "quality_before double, quality_after double, quality_change double")


def high_correlations(df: DataFrame, over: float = 0.85) -> list[tuple[str, str, float]]:
    rs = correlations(df, numeric_cols(df))
    return [(a, b, r) for (a, b), r in rs.items() if r is not None and abs(r) > over]

