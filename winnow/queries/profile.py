"""Profiles, correlations, missingness."""

from __future__ import annotations

from ..operators import profile as op
from ..operators import quality
from .base import DC, DO, DT, date_texts, dirty_customer, dirty_orders, query, sq_missing, sq_sentinel, sq_title, sql, table

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _li(spark, sf):
    return table(spark, sf, "lineitem").select(*_NUM)


def _parts(template: str, columns, source: str) -> str:
    return "\nUNION ALL\n".join(f"SELECT {template.format(x=x)} FROM {source}" for x in columns)


@query("describe_numeric", _parts("""'{x}' AS "column", count({x}) AS count, round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std,
 round(min({x}), 4) AS min, round(quantile_cont({x}, 0.25), 4) AS q25, round(median({x}), 4) AS q50, round(quantile_cont({x}, 0.75), 4) AS q75,
 round(max({x}), 4) AS max""", _NUM, "lineitem"))
def describe_numeric(spark, sf):
    return op.describe_numeric(_li(spark, sf))


_PROFILE = """'{x}' AS "column", count(*) AS total, count({x}) AS count, count(*) - count({x}) AS missing,
 round((count(*) - count({x})) / count(*) * 100, 2) AS missing_pct, count(DISTINCT {x}) AS "unique",
 round(count(DISTINCT {x}) / count(*) * 100, 2) AS unique_pct, round(avg({x}), 4) AS mean, round(median({x}), 4) AS median,
 round(mode({x} ORDER BY {x}), 4) AS mode, round(stddev_samp({x}), 4) AS std, round(var_samp({x}), 4) AS variance,
 round(min({x}), 4) AS min, round(max({x}), 4) AS max, round(max({x}) - min({x}), 4) AS range,
 round(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25), 4) AS iqr, round(skewness({x}), 4) AS skewness,
 round(kurtosis({x}), 4) AS kurtosis, round(quantile_cont({x}, 0.01), 4) AS p1, round(quantile_cont({x}, 0.05), 4) AS p5,
 round(quantile_cont({x}, 0.25), 4) AS p25, round(median({x}), 4) AS p50, round(quantile_cont({x}, 0.75), 4) AS p75,
 round(quantile_cont({x}, 0.95), 4) AS p95, round(quantile_cont({x}, 0.99), 4) AS p99,
 count(CASE WHEN {x} < any_a - 1.5*(any_b-any_a) OR {x} > any_b + 1.5*(any_b-any_a) THEN 1 END) AS outlier_count,
 round(count(CASE WHEN {x} < any_a - 1.5*(any_b-any_a) OR {x} > any_b + 1.5*(any_b-any_a) THEN 1 END) / count({x}) * 100, 2) AS outlier_pct,
 CASE WHEN abs(skewness({x})) < 0.5 AND abs(kurtosis({x})) < 1 THEN 'Normal / Bell-shaped' WHEN skewness({x}) > 1 THEN 'Right-Skewed (Positive)'
  WHEN skewness({x}) < -1 THEN 'Left-Skewed (Negative)'
  WHEN max({x}) > min({x}) AND abs(stddev_samp({x}) / (max({x}) - min({x}) + 1e-9) - 0.288) < 0.05 THEN 'Uniform' ELSE 'Multi-modal / Complex' END AS distribution,
 round(greatest(min({x}), any_value(any_a - 1.5*(any_b-any_a))), 4) AS lower_whisker,
 round(least(max({x}), any_value(any_b + 1.5*(any_b-any_a))), 4) AS upper_whisker"""


def _profile_sql(columns, source):
    return "\nUNION ALL\n".join(
        f"SELECT {_PROFILE.format(x=x)} FROM {source}, (SELECT quantile_cont({x}, 0.25) AS any_a, quantile_cont({x}, 0.75) AS any_b FROM {source})"
        for x in columns)


@query("profile_numeric", _profile_sql(_NUM, "lineitem"))
def profile_numeric(spark, sf):
    return op.profile_numeric(_li(spark, sf))


@query("profile_numeric_dirty", sql(_profile_sql(["balance"], "dc"), DC))
def profile_numeric_dirty(spark, sf):
    return op.profile_numeric(dirty_customer(spark, sf), ["balance"])


@query("profile_quick", sql("""
SELECT 'balance' AS "column", 'numeric' AS type, count(*) - count(balance) AS missing, round((count(*) - count(balance)) / count(*) * 100, 1) AS missing_pct,
 count(DISTINCT balance) AS "unique", round(count(DISTINCT balance) / count(*) * 100, 1) AS unique_pct, round(avg(balance), 4) AS mean,
 round(median(balance), 4) AS median, round(stddev_samp(balance), 4) AS std, round(min(balance), 4) AS min, round(max(balance), 4) AS max,
 round(skewness(balance), 4) AS skewness, round(kurtosis(balance), 4) AS kurtosis, NULL AS top_values, CAST(NULL AS DOUBLE) AS avg_length FROM dc
UNION ALL SELECT 'segment', 'categorical', count(*) - count(segment), round((count(*) - count(segment)) / count(*) * 100, 1),
 count(DISTINCT segment), round(count(DISTINCT segment) / count(*) * 100, 1), NULL, NULL, NULL, NULL, NULL, NULL, NULL,
 (SELECT string_agg(segment || '=' || n, '; ' ORDER BY n DESC, segment) FROM (SELECT segment, count(*) AS n FROM dc WHERE segment IS NOT NULL
   GROUP BY 1 ORDER BY n DESC, segment LIMIT 5)), round(avg(length(segment)), 1) FROM dc""", DC))
def profile_quick(spark, sf):
    return op.profile_quick(dirty_customer(spark, sf), ["balance", "segment"])


@query("profile_date", """
SELECT 'o_orderdate' AS "column", strftime(min(o_orderdate), '%Y-%m-%d') AS min_date, strftime(max(o_orderdate), '%Y-%m-%d') AS max_date,
 date_diff('day', min(o_orderdate), max(o_orderdate)) AS date_range_days, CAST(mode(year(o_orderdate) ORDER BY year(o_orderdate)) AS INT) AS most_common_year,
 CAST(mode(month(o_orderdate) ORDER BY month(o_orderdate)) AS INT) AS most_common_month, CAST(mode(day(o_orderdate) ORDER BY day(o_orderdate)) AS INT) AS most_common_day,
 false AS date_gaps_detected FROM orders""")
def profile_date(spark, sf):
    return op.profile_date(table(spark, sf, "orders"), "o_orderdate")


@query("profile_text", _parts("""'{x}' AS "column", round(avg(length({x})), 1) AS avg_length, CAST(min(length({x})) AS INT) AS min_length,
 CAST(max(length({x})) AS INT) AS max_length, bool_or(regexp_matches({x}, '[0-9]')) AS contains_numbers,
 bool_or(regexp_matches({x}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]')) AS contains_special_chars""", ["text", "lang", "source"], "documents"))
def profile_text(spark, sf):
    return op.profile_text(table(spark, sf, "documents"))


@query("column_statistics", sql(f"""
SELECT 'age' AS "column", 'number' AS data_type, count(*) AS total_count, CAST(0 AS BIGINT) AS missing_count, CAST(0 AS DOUBLE) AS missing_pct,
 count(DISTINCT age) AS unique_count, CAST(0 AS BIGINT) AS outlier_count, CAST(min(age) AS DOUBLE) AS min_value, CAST(max(age) AS DOUBLE) AS max_value,
 round(avg(age), 4) AS mean_value, round(median(age), 4) AS median_value, round(stddev_samp(age), 4) AS std_value,
 NULL AS most_common, NULL AS shortest_value, NULL AS longest_value FROM dc
UNION ALL SELECT 'balance', 'number', count(*), count(*) - count(balance), round((count(*) - count(balance)) / count(*) * 100, 2), count(DISTINCT balance),
 count(CASE WHEN balance < a - 1.5*(b-a) - 1e-9*(b-a) OR balance > b + 1.5*(b-a) + 1e-9*(b-a) THEN 1 END), min(balance), max(balance), round(avg(balance), 4),
 round(median(balance), 4), round(stddev_samp(balance), 4), NULL, NULL, NULL
 FROM dc, (SELECT quantile_cont(balance, 0.25) AS a, quantile_cont(balance, 0.75) AS b FROM dc)
UNION ALL SELECT 'segment', 'text', count(*), count(CASE WHEN {sq_missing('segment')} THEN 1 END),
 round(count(CASE WHEN {sq_missing('segment')} THEN 1 END) / count(*) * 100, 2), count(DISTINCT segment), 0, NULL, NULL, NULL, NULL, NULL,
 mode(CASE WHEN NOT {sq_sentinel('segment')} THEN segment END ORDER BY segment),
 (SELECT segment FROM dc WHERE NOT {sq_missing('segment')} ORDER BY length(segment), segment LIMIT 1),
 (SELECT segment FROM dc WHERE NOT {sq_missing('segment')} ORDER BY length(segment) DESC, segment LIMIT 1) FROM dc""", DC))
def column_statistics(spark, sf):
    return op.column_statistics(dirty_customer(spark, sf).select("age", "balance", "segment"))


_TYPED = """t AS (SELECT *, CASE WHEN flag = 1 THEN 'Yes' ELSE ' no' END AS yes_no, CASE WHEN flag = 1 THEN 'x' ELSE '7' END AS half,
 CASE WHEN o_orderkey % 8 = 0 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END AS mostly, CASE WHEN flag = 1 THEN 'n/a' END AS gone,
 CASE WHEN o_orderkey % 9 = 0 THEN 'soon' ELSE concat('2024-01-', 1 + o_orderkey % 28) END AS day FROM ord)"""
_WHOLE_TYPE = """'{x}' AS "column", CASE WHEN count({x}) = 0 THEN 'empty' WHEN count({x}) = count(*) FILTER ({x} IN (0, 1)) THEN 'boolean' ELSE 'number' END AS semantic_type"""
_TEXT_TYPE = """'{x}' AS "column", CASE WHEN count(*) = 0 THEN 'empty'
 WHEN count(*) = count(*) FILTER (lower(trim({x})) IN ('true', 'false', 'yes', 'no', '0', '1')) AND count(DISTINCT {x}) <= 10 THEN 'boolean'
 WHEN count(TRY_CAST(trim({x}) AS DOUBLE)) > 0.95 * count(*) THEN 'number' WHEN count(TRY_CAST(trim({x}) AS DOUBLE)) > 0.8 * count(*) THEN 'mixed'
 WHEN count(try_strptime({x}, '%Y-%m-%d')) > 0.7 * count(*) THEN 'date' ELSE 'text' END AS semantic_type"""


@query("detect_types", sql(_parts(_WHOLE_TYPE, ["o_orderkey", "o_custkey", "flag"], "t") + "\nUNION ALL\n" + "\nUNION ALL\n".join(
    f"SELECT {_TEXT_TYPE.format(x=x)} FROM t WHERE NOT {sq_missing(x)}" for x in ("o_orderstatus", "amount_text", "yes_no", "half", "mostly", "gone", "day")), DO, _TYPED))
def detect_types(spark, sf):
    from pyspark.sql import functions as F

    d = dirty_orders(spark, sf).withColumns({
        "yes_no": F.expr("CASE WHEN flag = 1 THEN 'Yes' ELSE ' no' END"),
        "half": F.expr("CASE WHEN flag = 1 THEN 'x' ELSE '7' END"),
        "mostly": F.expr("CASE WHEN o_orderkey % 8 = 0 THEN 'x' ELSE CAST(o_orderkey AS STRING) END"),
        "gone": F.expr("CASE WHEN flag = 1 THEN 'n/a' END"),
        "day": F.expr("CASE WHEN o_orderkey % 9 = 0 THEN 'soon' ELSE concat('2024-01-', 1 + o_orderkey % 28) END")})
    return op.type_report(d)


# ---------------------------------------------------------------- correlations

def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


_CORR = "\nUNION ALL\n".join(f"""SELECT '{a}' AS col1, '{b}' AS col2, round(corr({a}, {b}), 3) AS correlation,
 CASE WHEN abs(round(corr({a}, {b}), 3)) > 0.95 THEN 'Nearly identical' WHEN abs(round(corr({a}, {b}), 3)) > 0.85 THEN 'Highly correlated' END AS note
FROM v""" for a, b in _pairs(["l_quantity", "l_extendedprice", "gross", "l_tax"]))
_V = "v AS (SELECT l_quantity, l_extendedprice, l_extendedprice * (1 + l_tax) AS gross, l_tax FROM lineitem)"


def _v(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_quantity", "l_extendedprice", "l_extendedprice * (1 + l_tax) AS gross", "l_tax")


@query("corr_matrix", sql(_CORR, _V))
def corr_matrix(spark, sf):
    return op.corr_matrix(_v(spark, sf))


@query("corr_top_pairs", sql("SELECT col1, col2, round(r, 3) AS correlation, abs(r) > 0.85 AS collinear FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col1, '{b}' AS col2, corr({a}, {b}) AS r FROM w" for a, b in _pairs(["balance", "age", "c_custkey", "debt"]))
    + ") ORDER BY abs(r) DESC LIMIT 10", DC, "w AS (SELECT *, balance * -2 + age AS debt FROM dc WHERE balance IS NOT NULL)"))
def corr_top_pairs(spark, sf):
    d = dirty_customer(spark, sf).selectExpr("*", "balance * -2 + age AS debt")
    return op.corr_top_pairs(d, ["balance", "age", "c_custkey", "debt"])


@query("corr_strength", sql("SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{a}' AS col1, '{b}' AS col2, round(corr({a}, {b}), 3) AS correlation, CASE WHEN abs(round(corr({a}, {b}), 3)) > 0.9 THEN 'very_strong'
 WHEN abs(round(corr({a}, {b}), 3)) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength,
 CASE WHEN corr({a}, {b}) > 0 THEN 'positive' ELSE 'negative' END AS direction FROM v""" for a, b in _pairs(["l_quantity", "l_extendedprice", "gross", "l_tax"]))
    + ") WHERE abs(correlation) > 0.5", _V))
def corr_strength(spark, sf):
    return op.corr_strength(_v(spark, sf))


@query("vif", """
SELECT x AS "column", round(1 / (1 - (ra*ra + rb*rb - 2*ra*rb*rc) / (1 - rc*rc)), 2) AS vif FROM (
 SELECT 'l_quantity' AS x, corr(l_quantity, l_extendedprice) AS ra, corr(l_quantity, l_tax) AS rb, corr(l_extendedprice, l_tax) AS rc FROM lineitem
 UNION ALL SELECT 'l_extendedprice', corr(l_extendedprice, l_quantity), corr(l_extendedprice, l_tax), corr(l_quantity, l_tax) FROM lineitem
 UNION ALL SELECT 'l_tax', corr(l_tax, l_quantity), corr(l_tax, l_extendedprice), corr(l_quantity, l_extendedprice) FROM lineitem)""")
def vif(spark, sf):
    return op.vif(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


# ---------------------------------------------------------------- missing values

_MISS = {"name": sq_missing("name"), "segment": sq_missing("segment"), "balance": "balance IS NULL"}


@query("missing_values", sql("SELECT * FROM (" + "\nUNION ALL ".join(
    f"""SELECT '{n}' AS "column", count(CASE WHEN {m} THEN 1 END) AS missing_count, round(count(CASE WHEN {m} THEN 1 END) / count(*) * 100, 2) AS missing_pct
FROM dc""" for n, m in _MISS.items()) + ") WHERE missing_count > 0", DC))
def missing_values(spark, sf):
    return op.missing_values(dirty_customer(spark, sf))


@query("missing_by_column", sql("\nUNION ALL ".join(
    f"""SELECT '{n}' AS "column", count(*) - count({n}) AS missing_count, round((count(*) - count({n})) / count(*) * 100, 2) AS missing_pct,
 '{"KNN / Iterative" if n in ("c_custkey", "balance", "age") else "Mode / Constant"}' AS recommended_imputation FROM dc"""
    for n in ("c_custkey", "name", "segment", "balance", "age", "email", "phone")), DC))
def missing_by_column(spark, sf):
    return op.missing_by_column(dirty_customer(spark, sf))


@query("missing_pattern", sql("""
SELECT round(r, 4) AS max_abs_corr, CASE WHEN r > 0.5 THEN 'MAR' WHEN r > 0.2 THEN 'Possible MNAR' ELSE 'MCAR' END AS pattern
FROM (SELECT greatest(abs(corr(a, b)), abs(corr(a, d)), abs(corr(b, d))) AS r FROM (SELECT CAST(balance IS NULL AS INT) AS a,
 CAST(segment IS NULL AS INT) AS b, CAST(CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE age END IS NULL AS INT) AS d FROM dc))""", DC))
def missing_pattern(spark, sf):
    d = dirty_customer(spark, sf).selectExpr("balance", "segment", "CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE age END AS age")
    return op.missing_pattern(d)


# ---------------------------------------------------------------- whole table

@query("overview", sql("""
SELECT count(*) AS total_rows, 5 AS total_columns, count(*) * 5 AS total_cells, 3 AS numeric_columns, 2 AS text_columns, 0 AS date_columns,
 0 AS boolean_columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ord)) AS duplicate_rows,
 round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ord))) / count(*) * 100, 2) AS duplicate_pct,
 CAST(0 AS BIGINT) AS missing_cells, CAST(0 AS DOUBLE) AS missing_pct FROM ord""", DO))
def overview(spark, sf):
    return op.overview(dirty_orders(spark, sf))


@query("dataset_summary", sql("""
SELECT count(*) AS total_rows, 7 AS total_columns, 2 * count(*) - count(balance) - count(segment) AS missing_cells, CAST(0 AS BIGINT) AS duplicate_rows,
 count(CASE WHEN balance < a - 1.5*(b-a) OR balance > b + 1.5*(b-a) THEN 1 END) AS outlier_cells FROM dc,
 (SELECT quantile_cont(balance, 0.25) AS a, quantile_cont(balance, 0.75) AS b FROM dc)""", DC))
def dataset_summary(spark, sf):
    return op.dataset_summary(dirty_customer(spark, sf))


@query("full_profile")
def full_profile(spark, sf):
    return op.full_profile(dirty_customer(spark, sf))


# ---------------------------------------------------------------- text and column checks

_CU = "cu AS (SELECT *, 'EUR' AS unit, CASE WHEN c_custkey % 2 = 0 THEN 7 END AS half, c_name AS copy, CASE WHEN c_custkey = 7 THEN 'x' ELSE c_name END AS near, 1000 + c_custkey % 3 AS flat FROM customer)"
_CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("constant_columns", sql("\nUNION ALL\n".join(
    f"""SELECT '{x}' AS "column" FROM cu HAVING count({x}) > 0 AND min({x}) = max({x})""" for x in [*_CUSTOMER_COLUMNS, "unit", "half"]), _CU))
def constant_columns(spark, sf):
    from pyspark.sql import functions as F

    from ..operators.columns import constant_column_names

    d = table(spark, sf, "customer").withColumns({"unit": F.lit("EUR"), "half": F.expr("CASE WHEN c_custkey % 2 = 0 THEN 7 END")})
    return spark.createDataFrame([(n,) for n in constant_column_names(d)], "column string")


_SPARSE = """sp AS (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN name ELSE 'n/a' END AS mostly_na, CASE WHEN c_custkey % 10 = 0 THEN 1 END AS mostly_null FROM dc)"""


@query("empty_columns", sql("\nUNION ALL\n".join(
    f"""SELECT '{x}' AS "column" FROM sp HAVING count(*) FILTER ({cond}) >= 0.8 * count(*)"""
    for x, cond in [*((x, f"{x} IS NULL") for x in ("c_custkey", "balance", "age", "mostly_null")),
                    *((x, sq_missing(x)) for x in ("name", "segment", "email", "phone", "mostly_na"))]), DC, _SPARSE))
def empty_columns(spark, sf):
    from ..operators.columns import empty_column_names
    from .columns import _sparse

    return spark.createDataFrame([(n,) for n in empty_column_names(_sparse(spark, sf))], "column string")


@query("inconsistent_text", sql(f"""
SELECT * FROM (SELECT '{{x}}' AS "column", bool_or(v = upper(v) AND v <> lower(v)) AS has_upper, bool_or(v = lower(v) AND v <> upper(v)) AS has_lower,
 bool_or(v = {sq_title('v')} AND upper(v) <> lower(v)) AS has_title, count(s) AS cells
 FROM (SELECT segment AS s, CASE WHEN NOT {sq_sentinel('segment')} THEN segment END AS v FROM dc))
WHERE CAST(has_upper AS INT) + CAST(has_lower AS INT) + CAST(has_title AS INT) >= 2""".replace("{x}", "segment"), DC))
def inconsistent_text(spark, sf):
    return quality.inconsistent_text(dirty_customer(spark, sf))


@query("whitespace_issues", sql("""
SELECT 'name' AS "column", count(*) AS count, round(count(*) / (SELECT count(*) FROM dc) * 100, 2) AS percentage FROM dc WHERE name <> trim(name)""", DC))
def whitespace_issues(spark, sf):
    return quality.whitespace_issues(dirty_customer(spark, sf))


@query("duplicate_names", "SELECT 'c_name' AS \"column\"")
def duplicate_names(spark, sf):
    d = table(spark, sf, "customer")
    twice = d.select("c_custkey", "c_name", d["c_name"])
    return spark.createDataFrame([(n,) for n in quality.duplicate_names(twice.columns)], "column string")


@query("date_inconsistency", sql("""
SELECT 'date_text' AS "column", count(CASE WHEN contains(date_text, '/') THEN 1 END) AS slash, count(CASE WHEN contains(date_text, '-') THEN 1 END) AS dash,
 CAST(0 AS BIGINT) AS dot, count(*) AS cells FROM dt""", DT))
def date_inconsistency(spark, sf):
    return quality.date_inconsistency(date_texts(spark, sf))


@query("category_variants", sql(f"""
SELECT 'segment' AS "column", lower(trim(segment)) AS normal, count(DISTINCT segment) AS variants, count(*) AS rows,
 {sq_title('trim(min(segment))')} AS canonical FROM dc WHERE segment IS NOT NULL GROUP BY 2 HAVING count(DISTINCT segment) > 1""", DC))
def category_variants(spark, sf):
    return quality.category_variants(dirty_customer(spark, sf))


@query("dup_column_pairs", sql("\nUNION ALL\n".join(
    f"SELECT '{a}' AS col1, '{b}' AS col2 FROM cu HAVING bool_and({a} IS NOT DISTINCT FROM {b})"
    for same in (["c_custkey", "c_nationkey"], ["c_name", "c_mktsegment", "copy", "near"]) for i, a in enumerate(same) for b in same[i + 1:]), _CU))
def dup_column_pairs(spark, sf):
    from pyspark.sql import functions as F

    d = table(spark, sf, "customer").withColumns({
        "copy": F.col("c_name"), "near": F.expr("CASE WHEN c_custkey = 7 THEN 'x' ELSE c_name END")})
    return quality.dup_column_report(d)


@query("id_lowvar_columns", sql("\nUNION ALL\n".join(
    f"""SELECT '{x}' AS "column", CASE WHEN min({x}) = max({x}) THEN 'constant' WHEN {rule} END AS kind FROM cu HAVING min({x}) = max({x}) OR ({cond})"""
    for x, rule, cond in [*((x, f"count(DISTINCT {x}) = count(*) THEN 'id'", f"count(DISTINCT {x}) = count(*)") for x in ("c_name", "c_mktsegment", "unit")),
                          *((x, f"stddev_samp({x}) < 0.01 * abs(avg({x})) THEN 'low_variance'", f"avg({x}) <> 0 AND stddev_samp({x}) < 0.01 * abs(avg({x}))")
                            for x in ("c_custkey", "c_nationkey", "c_acctbal", "flat"))]), _CU))
def id_lowvar_columns(spark, sf):
    from pyspark.sql import functions as F

    d = table(spark, sf, "customer").withColumns({"unit": F.lit("EUR"), "flat": F.expr("1000 + c_custkey % 3")})
    return quality.id_lowvar_columns(d)


@query("similar_columns", sql("""
SELECT 'segment' AS col1, 'Segment_' AS col2, round(greatest(100, 100 * v), 1) AS similarity, CAST(100 AS DOUBLE) AS name_similarity,
 round(100 * v, 1) AS value_overlap FROM (SELECT avg(CAST(lower(trim(segment)) = lower(c_mktsegment) AS INT)) AS v
 FROM dc JOIN customer USING (c_custkey) WHERE segment IS NOT NULL)
UNION ALL SELECT 'name', 'label', 100, 44.4, 100""", DC))
def similar_columns(spark, sf):
    d = dirty_customer(spark, sf).join(table(spark, sf, "customer").selectExpr("c_custkey", "c_mktsegment AS Segment_", "c_name AS label"), "c_custkey")
    return quality.similar_columns(d.select("name", "segment", "Segment_", "label"))
