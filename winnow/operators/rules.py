"""Declarative validation rules, evaluated together in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import c, count_if, is_missing, num, strip
from ..functions.pii import EMAIL_RULE, PHONE_RULE
from ..functions.stats import rows_to_df, stats_row
from .clean import duplicate_members

RULE_SCHEMA = ("rule_name string, column string, rule_type string, passed boolean, "
               "failed_count bigint, pass_percentage double")

# Rule sets offered for common columns.
RULE_TEMPLATES = {
    "Age Column Standard": [
        {"column": "Age", "rule_type": "min_value", "value": 0, "name": "Min Age >= 0"},
        {"column": "Age", "rule_type": "max_value", "value": 120, "name": "Max Age <= 120"},
        {"column": "Age", "rule_type": "not_empty", "name": "Age Not Empty"},
    ],
    "Email Address Standard": [
        {"column": "Email", "rule_type": "email_format", "name": "Valid Email Format"},
        {"column": "Email", "rule_type": "not_empty", "name": "Email Not Empty"},
    ],
    "Phone Number Format": [{"column": "Phone", "rule_type": "phone_format", "name": "Valid Phone Format"}],
    "Unique Identifier": [
        {"column": "ID", "rule_type": "unique", "name": "Unique ID Values"},
        {"column": "ID", "rule_type": "not_empty", "name": "ID Not Empty"},
        {"column": "ID", "rule_type": "positive", "name": "Positive ID Number"},
    ],
    "Financial Price Check": [
        {"column": "Price", "rule_type": "positive", "name": "Price > 0"},
        {"column": "Price", "rule_type": "not_empty", "name": "Price Not Empty"},
    ],
    "Salary Range Check": [
        {"column": "Salary", "rule_type": "between", "value": [1000, 10000000], "name": "Salary Range $1k - $10M"},
    ],
}


def template(name: str, column: str) -> list[dict]:
    """A template's rules pointed at an actual column."""
    return [{**r, "column": column} for r in RULE_TEMPLATES[name]]


def _bounds(value) -> tuple[float, float]:
    if isinstance(value, dict):
        return float(value.get("min", 0)), float(value.get("max", 100))
    if isinstance(value, str) and "," in value:
        value = value.split(",")
    if isinstance(value, (list, tuple)) and len(value) == 2:
        return float(value[0]), float(value[1])
    return 0.0, 100.0


def failed(df: DataFrame, rule: dict) -> Column:
    """Row predicate that is true where the rule fails (every type but ``unique``)."""
    name, kind, value = rule["column"], rule["rule_type"], rule.get("value")
    if name not in df.columns:
        return F.lit(True)
    x, t = num(df, name), F.coalesce(c(name).cast("string"), F.lit("nan"))
    limit = float(value) if kind in ("min_value", "max_value") and value is not None else 0.0
    pattern = "" if value is None else str(value)
    if kind == "min_value":
        bad = x.isNull() | (x < limit)
    elif kind == "max_value":
        bad = x.isNull() | (x > limit)
    elif kind == "between":
        lo, hi = _bounds(value)
        bad = x.isNull() | ~x.between(lo, hi)
    elif kind == "positive":
        bad = x.isNull() | (x <= 0)
    elif kind == "negative":
        bad = x.isNull() | (x >= 0)
    elif kind == "not_empty":
        bad = is_missing(df, name)
    elif kind == "contains":
        bad = ~t.rlike("(?i)" + pattern)
    elif kind == "not_contains":
        bad = t.rlike("(?i)" + pattern)
    elif kind == "regex":
        bad = ~t.rlike(pattern or ".*")
    elif kind == "email_format":
        bad = ~strip(t).rlike(EMAIL_RULE)
    elif kind == "phone_format":
        bad = ~strip(t).rlike(PHONE_RULE)
    else:
        bad = F.lit(False)
    return F.coalesce(bad, F.lit(True))


def duplicate_member_count(df: DataFrame, name: str) -> int:
    """Rows whose value occurs more than once (NULLs equal each other).

    Counting per value first keeps a hot value from landing in one task."""
    g = df.groupBy(c(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum(F.when(F.col("n") > 1, F.col("n")))).first()[0] or 0


def validate(df: DataFrame, rules: list[dict]) -> DataFrame:
    """One row per rule with its failure count; all row-wise rules share one aggregate."""
    row_rules = {i: r for i, r in enumerate(rules) if r["rule_type"] != "unique" or r["column"] not in df.columns}
    got = stats_row(df, {"n": F.count(F.lit(1)), **{i: count_if(failed(df, r)) for i, r in row_rules.items()}})
    out = []
    for i, r in enumerate(rules):
        bad = got[i] if i in row_rules else duplicate_member_count(df, r["column"])
        pct = round((got["n"] - bad) / max(got["n"], 1) * 100, 2)
        label = r.get("name") or f"{r['column']} ({r['rule_type']})"
        out.append((label, r["column"], r["rule_type"], bad == 0, bad, pct))
    return rows_to_df(df.sparkSession, out, RULE_SCHEMA)


def quarantine(df: DataFrame, rules: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Split into rows that pass all rules and rows that fail any, with the rule names.

    A ``unique`` rule fails every row whose value occurs more than once, NULLs among them; it needs counts per value, so
    on a stream only row-wise rules can be used."""
    marked, tests = df, []
    for i, r in enumerate(rules):
        if r["rule_type"] == "unique" and r["column"] in df.columns:
            marked = duplicate_members(marked, [r["column"]], f"_many{i}")
            bad = F.col(f"_many{i}")
        else:
            bad = failed(df, r)
        tests.append(F.when(bad, F.lit(r.get("name") or f"{r['column']} ({r['rule_type']})")))
    names = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    tagged = marked.withColumn("failed_rules", names).select(*[c(n) for n in df.columns], "failed_rules")
    return (tagged.where(F.size("failed_rules") == 0).drop("failed_rules"),
            tagged.where(F.size("failed_rules") > 0))


def with_missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """One boolean per column: is the cell missing?"""
    return df.withColumns({f"{n}_missing": is_missing(df, n) for n in columns})
