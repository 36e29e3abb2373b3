"""Quality scores, issues, recommendations, personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pii import BASIC_PATTERNS, PATTERNS
from ..operators import privacy, quality
from ..operators import recommend as rec
from ..operators.clean import fill_all_missing
from .base import DC, DO, dirty_customer, dirty_orders, query, sq_missing, sql, table

_Q = "q AS (SELECT quantile_cont(balance, 0.25) AS a, quantile_cont(balance, 0.75) AS b FROM dc)"
_N = """k AS (SELECT count(*) AS n, count(*) - count(balance) AS mb, count(*) - count(segment) AS ms,
 count(CASE WHEN lower(trim(segment)) IN ('n/a') OR segment IS NULL THEN 1 END) AS mss,
 count(CASE WHEN name <> trim(name) THEN 1 END) AS ws, count(CASE WHEN email = 'invalid-email' THEN 1 END) AS bad,
 count(CASE WHEN balance < a - 1.5*(b-a) - 1e-9*(b-a) OR balance > b + 1.5*(b-a) + 1e-9*(b-a) THEN 1 END) AS o,
 count(CASE WHEN age < 0 THEN 1 END) AS neg, count(segment) AS seg FROM dc, q)"""


@query("issue_list", sql("""
SELECT 'missing_values' AS issue_type, CASE WHEN mss / n > 0.5 THEN 'critical' WHEN mss / n > 0.1 THEN 'warning' ELSE 'info' END AS severity,
 'segment' AS "column", mss AS affected, 'fill_missing' AS operation, 'mean' AS method FROM k
UNION ALL SELECT 'missing_values', CASE WHEN round(mb / n * 100, 2) > 50 THEN 'critical' WHEN round(mb / n * 100, 2) > 10 THEN 'warning' ELSE 'info' END,
 'balance', mb, 'fill_missing', 'mean' FROM k
UNION ALL SELECT 'outliers', 'warning', 'balance', o, 'fix_outliers', 'cap' FROM k
UNION ALL SELECT 'inconsistent_text', 'warning', 'segment', seg, 'standardize_case', 'lower' FROM k
UNION ALL SELECT 'whitespace', 'warning', 'name', ws, 'trim_whitespace', NULL FROM k""", DC, _Q, _N))
def issue_list(spark, sf):
    return quality.issue_list(dirty_customer(spark, sf))


_V1 = "round(100 - (mss + mb) / (n * 7) * 40 - o / n * 100 - 2, 2)"


@query("quality_score_v1", sql(f"SELECT {_V1} AS quality_score FROM k", DC, _Q, _N))
def quality_score_v1(spark, sf):
    return quality.quality_score_v1(dirty_customer(spark, sf))


@query("full_report", sql(f"""
SELECT {_V1} AS quality_score, 5 AS total_issues, 2 AS missing_columns, mss + mb AS missing_cells, CAST(0 AS BIGINT) AS duplicate_rows, 1 AS outlier_columns,
 o AS outlier_cells, 2 AS text_issues, 0 AS empty_columns, 0 AS constant_columns, n AS total_rows, 7 AS total_columns, n * 7 AS total_cells,
 'Fill or remove missing values to improve data completeness; Review and handle outlier values; Standardize text casing in affected columns; Trim whitespace from text columns'
 AS recommendations FROM k""", DC, _Q, _N))
def full_report(spark, sf):
    return quality.full_report(dirty_customer(spark, sf))


@query("quality_score_v3", sql("""
SELECT round(100 - (ms + mb) / (n * 7) * 40 - 8, 1) AS quality_score, 4 AS total_issues, ms + mb AS missing_total, CAST(0 AS BIGINT) AS duplicate_rows
FROM k""", DC, _Q, _N))
def quality_score_v3(spark, sf):
    return quality.quality_score_v3(dirty_customer(spark, sf))


# ---------------------------------------------------------------- six dimensions

def _dim(name):
    return lambda spark, sf: quality.dimension(dirty_customer(spark, sf), name)


_COMP = "round(100 - round((ms + mb) / (n * 7) * 100, 2) * 1.5, 2)"
_OPCT = "round(o / (3 * n) * 100, 2)"
_ACC = f"round(100 - least(40, {_OPCT} * 1.5) - 8, 2)"
_VAL = "round(100 - least(50, bad * 3.0) - 5, 2)"

query("q_completeness", sql(f"""SELECT {_COMP} AS score, n AS rows, ms + mb AS missing_cells, round((ms + mb) / (n * 7) * 100, 2) AS missing_pct
FROM k""", DC, _Q, _N))(_dim("completeness"))
query("q_accuracy", sql(f"SELECT {_ACC} AS score, o AS outliers, {_OPCT} AS outlier_pct, 1 AS suspicious FROM k", DC, _Q, _N))(_dim("accuracy"))
query("q_consistency", sql("SELECT CAST(85 AS DOUBLE) AS score, 0 AS type_mismatches, 1 AS inconsistent_categories, 1 AS format_issues", DC))(
    _dim("consistency"))
query("q_validity", sql(f"SELECT CAST({_VAL} AS DOUBLE) AS score, bad AS invalid_emails, CAST(0 AS BIGINT) AS invalid_phones, 1 AS rule_failures FROM k",
                        DC, _Q, _N))(_dim("validity"))


@query("q_uniqueness", sql("""
SELECT round(100 - round(d / n * 100, 2) * 2 - 10, 2) AS score, d AS duplicate_rows, round(d / n * 100, 2) AS duplicate_pct, 1 AS duplicate_columns
FROM (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ord)) AS d FROM ord)""", DO))
def q_uniqueness(spark, sf):
    return quality.dimension(dirty_orders(spark, sf).withColumn("status2", F.col("o_orderstatus")), "uniqueness")


_GAPPY = "CASE WHEN year(o_orderdate) % 3 = 1 THEN NULL ELSE o_orderdate END"


@query("q_timeliness", f"""
SELECT CAST(85 AS DOUBLE) AS score, 1 AS date_columns, strftime(min(t), '%Y-%m-%d') AS oldest, strftime(max(t), '%Y-%m-%d') AS newest, true AS gaps
FROM (SELECT {_GAPPY} AS t FROM orders)""")
def q_timeliness(spark, sf):
    return quality.dimension(table(spark, sf, "orders").select("o_orderkey", F.expr(_GAPPY).alias("day")), "timeliness")


_OVER = f"round({_COMP} * 0.30 + 85 * 0.20 + {_ACC} * 0.20 + 100 * 0.15 + {_VAL} * 0.10 + 100 * 0.05, 1)"
_REPORT = f"""SELECT {_COMP} AS completeness, CAST(85 AS DOUBLE) AS consistency, {_ACC} AS accuracy, CAST(100 AS DOUBLE) AS uniqueness, CAST({_VAL} AS DOUBLE) AS validity,
 CAST(100 AS DOUBLE) AS timeliness, {_OVER} AS overall, CASE WHEN {_OVER} >= 90 THEN 'A' WHEN {_OVER} >= 80 THEN 'B' WHEN {_OVER} >= 70 THEN 'C'
 WHEN {_OVER} >= 60 THEN 'D' ELSE 'F' END AS grade FROM k"""


@query("q_overall", sql(_REPORT, DC, _Q, _N))
def q_overall(spark, sf):
    return quality.quality_report(dirty_customer(spark, sf))


@query("q_improvements", sql(f"""
SELECT 'impute_missing' AS action, ms + mb AS amount, CAST(least(25, floor(round((ms + mb) / (n * 7) * 100, 2) * 0.8) + 5) AS INT) AS impact, 'easy' AS difficulty FROM k
UNION ALL SELECT 'handle_outliers', o, CAST(least(18, floor({_OPCT} * 1.2) + 4) AS INT), 'medium' FROM k
UNION ALL SELECT 'standardize_categories', 1, 10, 'easy' UNION ALL SELECT 'resolve_domain_violations', 1, 15, 'medium'
UNION ALL SELECT 'clean_emails', bad, 8, 'easy' FROM k""", DC, _Q, _N))
def q_improvements(spark, sf):
    return quality.improvements(dirty_customer(spark, sf))


@query("quality_delta", sql("""
SELECT a AS quality_before, b AS quality_after, round(b - a, 2) AS quality_change FROM (
 SELECT round(100 - round((ms + mb) / (n * 3) * 100, 2) * 1.5, 2) AS ca, round(ca * 0.30 + 90 * 0.20 + aa * 0.20 + 30, 1) AS a, round(30 + 90 * 0.20 + ab * 0.20 + 30, 1) AS b
 FROM (SELECT n, mb, ms, round(100 - least(40, round(o / n * 100, 2) * 1.5), 2) AS aa, round(100 - least(40, round(o2 / n * 100, 2) * 1.5), 2) AS ab
  FROM k, (SELECT count(CASE WHEN x < a2 - 1.5*(b2-a2) OR x > b2 + 1.5*(b2-a2) THEN 1 END) AS o2 FROM f,
   (SELECT quantile_cont(x, 0.25) AS a2, quantile_cont(x, 0.75) AS b2 FROM f))))""", DC, _Q, _N,
    "f AS (SELECT coalesce(balance, (SELECT avg(balance) FROM dc)) AS x FROM dc)"))
def quality_delta(spark, sf):
    # without a key some rows coincide; keep them apart so that only missing cells and outliers move the score
    d = dirty_customer(spark, sf).select("balance", "segment", F.col("phone").alias("ref"))
    return quality.quality_delta(d, fill_all_missing(d))


# ---------------------------------------------------------------- recommendations

_SCH = ("category", "kind", "\"column\"", "affected", "impact", "effort", "priority", "fix")


def _rec(*rows) -> str:
    """rows: SQL expressions for affected; the rest literal."""
    out = []
    for cat, kind, col, aff, imp, eff, pri, fix, cond in rows:
        out.append(f"""SELECT '{cat}' AS category, '{kind}' AS kind, '{col}' AS "column", {aff} AS affected, {imp} AS impact, {eff} AS effort,
 CAST({pri} AS DOUBLE) AS priority, '{fix}' AS fix FROM k WHERE {cond}""")
    return "\nUNION ALL\n".join(out)


def _messy(spark, sf):
    return dirty_customer(spark, sf).withColumns({
        "gone": F.lit(None).cast("string"), "unit": F.lit("EUR"),
        "rare": F.expr("CASE WHEN c_custkey % 3 = 0 THEN age END"),
        "amount": F.expr("concat('$', c_custkey)")})


_CRIT = [("Critical", "empty_column", "gone", "n", 10, 1, 10, "drop_column", "true"),
         ("Critical", "mostly_missing", "rare", "rare", 9, 2, 4.5, "drop_column", "true"),
         ("Critical", "constant_column", "unit", "n", 9, 1, 9, "drop_column", "true")]
_KM = "k AS (SELECT count(*) AS n, count(CASE WHEN c_custkey % 3 <> 0 THEN 1 END) AS rare FROM dc)"


@query("rec_critical", sql(_rec(*_CRIT), DC, _KM))
def rec_critical(spark, sf):
    d = _messy(spark, sf)
    return rec.table(d, rec.critical(d))


@query("rec_duplicates", sql("""
SELECT 'Critical' AS category, 'duplicate_rows' AS kind, 'ALL' AS "column", n - u AS affected, 10 AS impact, 1 AS effort, CAST(10 AS DOUBLE) AS priority,
 'drop_duplicates' AS fix FROM (SELECT count(*) AS n FROM lineitem), (SELECT count(*) AS u FROM (SELECT DISTINCT l_returnflag, l_quantity, l_tax FROM lineitem))"""))
def rec_duplicates(spark, sf):
    d = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_tax")
    return rec.table(d, rec.critical(d))


@query("rec_numeric_text", sql(_rec(("High", "numeric_as_text", "amount", "n", 8, 1, 8, "cast_type", "true")), DC, _KM))
def rec_numeric_text(spark, sf):
    d = _messy(spark, sf)
    return rec.table(d, rec.numeric_text(d))


@query("rec_date_text", sql(_rec(("High", "date_as_text", "order_date", "n", 8, 2, 4, "parse_dates", "true")),
                            "k AS (SELECT count(*) AS n FROM orders)"))
def rec_date_text(spark, sf):
    d = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy/MM/dd").alias("order_date"), "o_orderpriority")
    return rec.table(d, rec.date_text(d))


@query("rec_impute", sql(_rec(("High", "impute", "balance", "n - b", 8, 2, 4, "knn_impute", "(n - b) / n >= 0.1")),
                         DC, "k AS (SELECT count(*) AS n, count(balance) AS b FROM dc)"))
def rec_impute(spark, sf):
    d = dirty_customer(spark, sf)
    return rec.table(d, rec.impute(d))


@query("rec_high_card", sql(_rec(*[("High", "high_cardinality", x, "n", 7, 1, 7, "drop_column", f"{x} > 0.9 * n") for x in ("name", "email", "phone")]),
                            DC, "k AS (SELECT count(*) AS n, count(DISTINCT name) AS name, count(DISTINCT email) AS email, count(DISTINCT phone) AS phone FROM dc)"))
def rec_high_card(spark, sf):
    d = dirty_customer(spark, sf)
    return rec.table(d, rec.high_cardinality(d))


@query("rec_skew", sql(_rec(("High", "skewed", "x", "n", 7, 2, 3.5, "scale_log", "s > 2")),
                       "k AS (SELECT count(*) AS n, skewness(exp(l_quantity / 8)) AS s FROM lineitem)"))
def rec_skew(spark, sf):
    d = table(spark, sf, "lineitem").selectExpr("exp(l_quantity / 8) AS x", "l_quantity")
    return rec.table(d, rec.skewed(d))


@query("rec_outliers", sql(_rec(("High", "outliers", "x", "o", 7, 2, 3.5, "winsorize", "o / n >= 0.05")), """
k AS (SELECT count(*) AS n, count(CASE WHEN x < a - 1.5*(b-a) OR x > b + 1.5*(b-a) THEN 1 END) AS o FROM v, (SELECT quantile_cont(x, 0.25) AS a,
 quantile_cont(x, 0.75) AS b FROM v))""".replace("k AS", "v AS (SELECT exp(l_quantity / 8) AS x FROM lineitem), k AS", 1)))
def rec_outliers(spark, sf):
    d = table(spark, sf, "lineitem").selectExpr("exp(l_quantity / 8) AS x", "l_quantity")
    return rec.table(d, rec.outliers(d))


@query("rec_low", sql(_rec(("Low", "blank_in_names", "order status", "1", 3, 1, 3, "rename_columns", "true"),
                           ("Low", "boolean_as_number", "flag", "n", 3, 1, 3, "cast_bool", "true")), DO, "k AS (SELECT count(*) AS n FROM ord)"))
def rec_low(spark, sf):
    d = dirty_orders(spark, sf).withColumnRenamed("o_orderstatus", "order status")
    return rec.table(d, rec.low(d, d.count()))


_ALL = _CRIT + [("High", "numeric_as_text", "amount", "n", 8, 1, 8, "cast_type", "true"),
                ("High", "impute", "balance", "n - b", 8, 2, 4, "knn_impute", "(n - b) / n >= 0.1")] + \
    [("High", "high_cardinality", x, "n", 7, 1, 7, "drop_column", f"{x} > 0.9 * n") for x in ("name", "email", "phone", "amount")] + \
    [("Medium", "category_variants", "segment", "seg", 6, 1, 6, "standardize_categories", "true"),
     ("Medium", "whitespace", "name", "ws", 5, 1, 5, "clean_text", "true")]
_KA = """k AS (SELECT count(*) AS n, count(CASE WHEN c_custkey % 3 <> 0 THEN 1 END) AS rare, count(balance) AS b, count(segment) AS seg,
 count(CASE WHEN name <> trim(name) THEN 1 END) AS ws, count(DISTINCT name) AS name, count(DISTINCT email) AS email,
 count(DISTINCT phone) AS phone, count(DISTINCT c_custkey) AS amount FROM dc)"""


@query("rec_all", sql(_rec(*_ALL, ("Medium", "collinear", "rare", "n", 6, 2, 3, "drop_column",
                                   "(SELECT corr(age, CASE WHEN c_custkey % 3 = 0 THEN age END) FROM dc) > 0.85")), DC, _KA))
def rec_all(spark, sf):
    return rec.recommendations(_messy(spark, sf))


@query("rec_quick_wins", sql("SELECT * FROM (" + _rec(*_ALL) + ") WHERE effort <= 2 AND impact >= 7", DC, _KA))
def rec_quick_wins(spark, sf):
    return rec.quick_wins(_messy(spark, sf))


@query("apply_critical", sql("SELECT c_custkey, name, segment, round(balance, 4) AS balance, age, email, phone, concat('$', c_custkey) AS amount FROM dc", DC))
def apply_critical(spark, sf):
    return rec.apply_critical(_messy(spark, sf)).withColumn("balance", F.round("balance", 4))


# ---------------------------------------------------------------- personal data

def _mask_sql(kind, x):
    last = f"right({x}, 4)"
    return {
        "Email": f"CASE WHEN len(string_split({x}, '@')) = 2 THEN left({x}, 2) || '***@' || split_part({x}, '@', 2) ELSE left({x}, 2) || '***' END",
        "Phone Pakistan": f"CASE WHEN length({x}) >= 4 THEN '****-****-' || {last} ELSE '****' END",
        "Phone International": f"CASE WHEN length({x}) >= 4 THEN '****-****-' || {last} ELSE '****' END",
        "CNIC Pakistan": f"left({x}, 5) || '-***-*'",
        "Credit Card": f"CASE WHEN length(regexp_replace({x}, '[^0-9]', '', 'g')) >= 4 THEN '**** **** **** ' || right(regexp_replace({x}, '[^0-9]', '', 'g'), 4) ELSE '****' END",
        "IP Address": f"CASE WHEN len(string_split({x}, '.')) = 4 THEN split_part({x}, '.', 1) || '.' || split_part({x}, '.', 2) || '.***.***' ELSE {x} END",
    }.get(kind, f"left({x}, 2) || '***' || right({x}, 2)")


def _scan_sql(cols, source):
    parts = []
    for n in cols:
        for t, p, risk, advice in PATTERNS:
            hit = f"CASE WHEN regexp_matches(CAST({n} AS VARCHAR), '{p}') THEN CAST({n} AS VARCHAR) END"
            m = _mask_sql(t, "regexp_replace(s, '^\\s+|\\s+$', '', 'g')")
            parts.append(f"""SELECT '{t}' AS pii_type, '{n}' AS "column", k AS count, {m} AS sample, '{risk}' AS risk, '{advice}' AS recommendation
FROM (SELECT count({hit}) AS k, min({hit}) AS s FROM {source}) WHERE k > 0""")
    return "\nUNION ALL\n".join(parts)


@query("pii_scan", sql(_scan_sql(["c_custkey", "name", "segment", "email", "phone"], "dc"), DC))
def pii_scan(spark, sf):
    return privacy.scan_pii(dirty_customer(spark, sf).drop("balance", "age"))


@query("pii_scan_documents", _scan_sql(["text"], "documents"))
def pii_scan_documents(spark, sf):
    return privacy.scan_pii(table(spark, sf, "documents").select("text"))


@query("pii_scan_basic", "\nUNION ALL\n".join(f"""SELECT '{n}' AS "column", '{t}' AS pii_type, k AS count, '{risk}' AS risk
FROM (SELECT count(CASE WHEN regexp_matches({n}, '{p}') THEN 1 END) AS k FROM documents) WHERE k > 0"""
                                              for n in ("text", "lang", "source") for t, p, risk in BASIC_PATTERNS))
def pii_scan_basic(spark, sf):
    return privacy.scan_pii_basic(table(spark, sf, "documents").select("text", "lang", "source"))


def _mask(column, kind):
    def run(spark, sf):
        d = dirty_customer(spark, sf).withColumns({
            "card": F.expr("concat('4111 1111 ', lpad(CAST(c_custkey AS STRING), 4, '0'), ' 2222')"),
            "cnic": F.expr("concat('35202-', lpad(CAST(c_custkey AS STRING), 7, '0'), '-1')")})
        return privacy.mask_pii(d, column, kind).select("c_custkey", column)
    return run


_T = "c_custkey"
query("pii_mask_email", sql(f"SELECT c_custkey, {_mask_sql('Email', 'email')} AS email FROM dc", DC))(_mask("email", "Email"))
query("pii_mask_phone", sql(f"SELECT c_custkey, {_mask_sql('Phone Pakistan', 'phone')} AS phone FROM dc", DC))(_mask("phone", "Phone Pakistan"))
query("pii_mask_card", sql("SELECT c_custkey, '**** **** **** 2222' AS card FROM dc", DC))(_mask("card", "Credit Card"))
query("pii_mask_cnic", sql("SELECT c_custkey, '35202-***-*' AS cnic FROM dc", DC))(_mask("cnic", "CNIC"))
query("pii_mask_default", sql(f"SELECT c_custkey, CASE WHEN {sq_missing('segment')} THEN segment ELSE left(segment, 2) || '***' || right(segment, 2) END AS segment FROM dc",
                              DC))(_mask("segment", "name"))


@query("pii_mask_ip", "SELECT event_id, (user_id % 256) || '.' || (event_id % 256) || '.***.***' AS ip FROM events")
def pii_mask_ip(spark, sf):
    d = table(spark, sf, "events").select("event_id", F.expr("concat_ws('.', user_id % 256, event_id % 256, event_id % 7, 1)").alias("ip"))
    return privacy.mask_pii(d, "ip", "IP Address")
