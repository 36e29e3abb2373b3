"""Validation rules."""

from __future__ import annotations

from ..operators import rules as op
from .base import DC, DO, dirty_customer, dirty_orders, query, sq_missing, sql, table


def _rule_sql(rows, ctes, source) -> str:
    """rows: (label, column, rule_type, failing condition)."""
    parts = [f"""SELECT '{label}' AS rule_name, '{col}' AS "column", '{kind}' AS rule_type, k = 0 AS passed,
       k AS failed_count, round((n - k) * 100.0 / n, 2) AS pass_percentage
FROM (SELECT count(*) AS n, count(CASE WHEN {bad} THEN 1 END) AS k FROM {source})""" for label, col, kind, bad in rows]
    return sql("\nUNION ALL\n".join(parts), *ctes)


def _dc(spark, sf, *rules):
    return op.validate(dirty_customer(spark, sf), list(rules))


def _r(column, kind, value=None, name=None):
    return {"column": column, "rule_type": kind, "value": value, "name": name or f"{column} {kind}"}


@query("rule_min", _rule_sql([("balance min_value", "balance", "min_value", "balance IS NULL OR balance < 100"),
                              ("nope min_value", "nope", "min_value", "true")], [DC], "dc"))
def rule_min(spark, sf):
    return _dc(spark, sf, _r("balance", "min_value", 100), _r("nope", "min_value", 1))


@query("rule_max", _rule_sql([("balance max_value", "balance", "max_value", "balance IS NULL OR balance > 10000")], [DC], "dc"))
def rule_max(spark, sf):
    return _dc(spark, sf, _r("balance", "max_value", 10000))


@query("rule_between", _rule_sql([
    ("list", "age", "between", "age < 0 OR age > 60"), ("text", "age", "between", "age < 20 OR age > 30"),
    ("map", "balance", "between", "balance IS NULL OR balance < 0 OR balance > 5000")], [DC], "dc"))
def rule_between(spark, sf):
    return _dc(spark, sf, _r("age", "between", [0, 60], "list"), _r("age", "between", "20,30", "text"),
               _r("balance", "between", {"min": 0, "max": 5000}, "map"))


@query("rule_not_empty", _rule_sql([("segment not_empty", "segment", "not_empty", sq_missing("segment")),
                                    ("balance not_empty", "balance", "not_empty", "balance IS NULL")], [DC], "dc"))
def rule_not_empty(spark, sf):
    return _dc(spark, sf, _r("segment", "not_empty"), _r("balance", "not_empty"))


@query("rule_unique", _rule_sql([
    ("o_orderkey unique", "o_orderkey", "unique", "o_orderkey IN (SELECT o_orderkey FROM ord GROUP BY 1 HAVING count(*) > 1)")],
    [DO], "ord"))
def rule_unique(spark, sf):
    return op.validate(dirty_orders(spark, sf), [_r("o_orderkey", "unique")])


@query("rule_contains", _rule_sql([
    ("segment contains", "segment", "contains", "NOT regexp_matches(coalesce(segment, 'nan'), '(?i)build|house')"),
    ("segment not_contains", "segment", "not_contains", "regexp_matches(coalesce(segment, 'nan'), '(?i)auto')")], [DC], "dc"))
def rule_contains(spark, sf):
    return _dc(spark, sf, _r("segment", "contains", "build|house"), _r("segment", "not_contains", "auto"))


@query("rule_regex", _rule_sql([("name regex", "name", "regex", "NOT regexp_matches(name, '^Customer#[0-9]+$')")], [DC], "dc"))
def rule_regex(spark, sf):
    return _dc(spark, sf, _r("name", "regex", "^Customer#[0-9]+$"))


_EMAIL = "NOT regexp_matches(trim(email), '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')"
_PHONE = "NOT regexp_matches(trim({0}), '^\\+?[0-9\\s-]{{10,14}}$')"


@query("rule_email", _rule_sql([("email email_format", "email", "email_format", _EMAIL)], [DC], "dc"))
def rule_email(spark, sf):
    return _dc(spark, sf, _r("email", "email_format"))


@query("rule_phone", _rule_sql([("phone phone_format", "phone", "phone_format", _PHONE.format("phone")),
                                ("name phone_format", "name", "phone_format", _PHONE.format("name"))], [DC], "dc"))
def rule_phone(spark, sf):
    return _dc(spark, sf, _r("phone", "phone_format"), _r("name", "phone_format"))


@query("rule_sign", _rule_sql([("balance positive", "balance", "positive", "balance IS NULL OR balance <= 0"),
                               ("balance negative", "balance", "negative", "balance IS NULL OR balance >= 0")], [DC], "dc"))
def rule_sign(spark, sf):
    return _dc(spark, sf, _r("balance", "positive"), _r("balance", "negative"))


@query("rule_templates", _rule_sql([
    ("Min Age >= 0", "age", "min_value", "age < 0"), ("Max Age <= 120", "age", "max_value", "age > 120"),
    ("Age Not Empty", "age", "not_empty", "age IS NULL"), ("Valid Email Format", "email", "email_format", _EMAIL),
    ("Email Not Empty", "email", "not_empty", sq_missing("email")),
    ("Valid Phone Format", "phone", "phone_format", _PHONE.format("phone")),
    ("Unique ID Values", "c_custkey", "unique", "false"), ("ID Not Empty", "c_custkey", "not_empty", "c_custkey IS NULL"),
    ("Positive ID Number", "c_custkey", "positive", "c_custkey <= 0"),
    ("Price > 0", "balance", "positive", "balance IS NULL OR balance <= 0"),
    ("Price Not Empty", "balance", "not_empty", "balance IS NULL"),
    ("Salary Range $1k - $10M", "balance", "between", "balance IS NULL OR balance NOT BETWEEN 1000 AND 10000000")],
    [DC], "dc"))
def rule_templates(spark, sf):
    use = {"Age Column Standard": "age", "Email Address Standard": "email", "Phone Number Format": "phone",
           "Unique Identifier": "c_custkey", "Financial Price Check": "balance", "Salary Range Check": "balance"}
    return _dc(spark, sf, *[r for t, col in use.items() for r in op.template(t, col)])


@query("rule_quarantine", """
SELECT l_orderkey, l_linenumber,
  array_to_string(list_filter([CASE WHEN l_quantity > 40 THEN 'many' END, CASE WHEN l_tax <= 0 THEN 'untaxed' END],
                              lambda x: x IS NOT NULL), ',') AS failed
FROM lineitem WHERE l_quantity > 40 OR l_tax <= 0""")
def rule_quarantine(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    bad = op.quarantine(d, [_r("l_quantity", "max_value", 40, "many"), _r("l_tax", "positive", None, "untaxed")])[1]
    return bad.selectExpr("l_orderkey", "l_linenumber", "array_join(failed_rules, ',') AS failed")


@query("rule_quarantine_unique", """
SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'one order,large' ELSE 'one order' END AS failed
FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT o_orderkey, 'large' FROM orders
WHERE o_totalprice > 200000 AND o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1)""")
def rule_quarantine_unique(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    bad = op.quarantine(d, [_r("o_custkey", "unique", None, "one order"), _r("o_totalprice", "max_value", 200000, "large")])[1]
    return bad.selectExpr("o_orderkey", "array_join(failed_rules, ',') AS failed")


@query("missing_mask", sql(f"""
SELECT c_custkey, {sq_missing('segment')} AS segment_missing, balance IS NULL AS balance_missing,
       {sq_missing('name')} AS name_missing FROM dc""", DC))
def missing_mask(spark, sf):
    d = op.with_missing_flags(dirty_customer(spark, sf), ["segment", "balance", "name"])
    return d.select("c_custkey", "segment_missing", "balance_missing", "name_missing")
