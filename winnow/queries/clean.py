"""Duplicates, missing values, outliers, text, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as op
from ..operators.profile import outlier_row_count, outliers_report, outliers_simple
from .base import (DC, DO, DT, date_texts, dirty_customer, dirty_orders, query, sq_date, sq_missing, sq_title, sql,
                   table)


# ---------------------------------------------------------------- duplicates

@query("remove_duplicates", sql("SELECT DISTINCT * FROM ord", DO))
def remove_duplicates(spark, sf):
    return op.remove_duplicates(dirty_orders(spark, sf))


@query("remove_duplicates_key", """
SELECT l_returnflag, l_linestatus, l_quantity, min(l_orderkey * 10 + l_linenumber) AS k FROM lineitem GROUP BY ALL""")
def remove_duplicates_key(spark, sf):
    d = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity",
                                            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return op.remove_duplicates(d, ["l_returnflag", "l_linestatus", "l_quantity"], key="k")


@query("duplicate_rows", sql("""SELECT 'ord' AS source, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ord)) AS duplicates
FROM ord""", DO))
def duplicate_rows(spark, sf):
    n = op.duplicate_count(dirty_orders(spark, sf))
    return spark.createDataFrame([("ord", n)], "source string, duplicates bigint")


_FLAGS = "SELECT event_id, user_id, event_type, {} FROM events"


@query("dup_flag", _FLAGS.format("row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS is_duplicate"))
def dup_flag(spark, sf):
    d = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return op.duplicate_flag(d, ["user_id", "event_type"], "event_id")


@query("dup_members", _FLAGS.format("count(*) OVER (PARTITION BY user_id, event_type) > 1 AS is_member"))
def dup_members(spark, sf):
    d = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return op.duplicate_members(d, ["user_id", "event_type"])


# ---------------------------------------------------------------- filling

def _fill(column, method, value=None):
    def run(spark, sf):
        d = op.fill_missing(dirty_customer(spark, sf), column, method, value).select("c_custkey", column)
        return d.withColumn(column, F.round(column, 4)) if column == "balance" else d
    return run


_BAL = "SELECT c_custkey, round(coalesce(balance, ({})), 4) AS balance FROM dc"
_SEG = f"""SELECT c_custkey, CASE WHEN {sq_missing('segment')} THEN ({{}}) ELSE segment END AS segment FROM dc"""
_MODE = f"SELECT mode(segment ORDER BY segment) FROM dc WHERE NOT {sq_missing('segment')}"

query("fill_mean", sql(_BAL.format("SELECT avg(balance) FROM dc"), DC))(_fill("balance", "mean"))
query("fill_median", sql(_BAL.format("SELECT median(balance) FROM dc"), DC))(_fill("balance", "median"))
query("fill_mode", sql(_SEG.format(_MODE), DC))(_fill("segment", "mode"))
query("fill_const", sql(_BAL.format("SELECT 12.5"), DC))(_fill("balance", "custom_value", "12.5"))
query("fill_const_text", sql(_SEG.format("SELECT 'UNKNOWN'"), DC))(_fill("segment", "custom_value", "UNKNOWN"))
query("fill_auto", sql(_SEG.format(_MODE), DC))(_fill("segment", "auto"))


@query("fill_all_missing", sql(f"""
SELECT c_custkey, name, CASE WHEN {sq_missing('segment')} THEN ({_MODE}) ELSE segment END AS segment,
       round(coalesce(balance, (SELECT avg(balance) FROM dc)), 4) AS balance, age, email, phone FROM dc""", DC))
def fill_all_missing(spark, sf):
    return op.fill_all_missing(dirty_customer(spark, sf)).withColumn("balance", F.round("balance", 4))


# ---------------------------------------------------------------- outliers

_Q = "q AS (SELECT quantile_cont(balance, 0.25) AS a, median(balance) AS m, quantile_cont(balance, 0.75) AS b FROM dc)"
_F = """f AS (SELECT a, b, m, b - a AS i, a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi, 1e-9 * (b - a) AS t FROM q)"""
_OUT = "(balance < lo - t OR balance > hi + t)"


@query("outliers_iqr", sql(f"""
SELECT 'balance' AS "column", (SELECT count(*) FROM dc, f WHERE {_OUT}) AS outlier_count, round(lo, 4) AS lower_bound,
       round(hi, 4) AS upper_bound, round(a, 4) AS q1, round(b, 4) AS q3, round(i, 4) AS iqr FROM f
UNION ALL SELECT 'mad', (SELECT count(*) FROM dc WHERE abs(CASE WHEN c_custkey % 6 = 0 THEN c_custkey ELSE 0 END) > 0
    AND c_custkey % 6 = 0), 0, 0, 0, 0, 0""", DC, _Q, _F))
def outliers_iqr(spark, sf):
    """The second column has a zero IQR and a zero MAD: everything off the median is an outlier."""
    d = dirty_customer(spark, sf).withColumn("mad", F.expr("CASE WHEN c_custkey % 6 = 0 THEN CAST(c_custkey AS DOUBLE) ELSE 0D END"))
    return outliers_report(d, ["balance", "mad"])


@query("outliers_mad", sql("""
SELECT 'x' AS "column", count(CASE WHEN x < m - 3.0*1.4826*mad - 1e-9*mad OR x > m + 3.0*1.4826*mad + 1e-9*mad THEN 1 END) AS outlier_count,
       round(any_value(m - 3.0*1.4826*mad), 4) AS lower_bound, round(any_value(m + 3.0*1.4826*mad), 4) AS upper_bound,
       round(any_value(m), 4) AS q1, round(any_value(m), 4) AS q3, CAST(0 AS DOUBLE) AS iqr
FROM v, (SELECT median(x) AS m FROM v) c, (SELECT median(abs(x - (SELECT median(x) FROM v))) AS mad FROM v) e""",
    "v AS (SELECT CASE WHEN l_linenumber = 1 THEN l_quantity WHEN l_linenumber = 2 THEN 24.0 ELSE 25.0 END AS x FROM lineitem)",
    ))
def outliers_mad(spark, sf):
    d = table(spark, sf, "lineitem").select(F.expr(
        "CASE WHEN l_linenumber = 1 THEN l_quantity WHEN l_linenumber = 2 THEN 24D ELSE 25D END").alias("x"))
    return outliers_report(d, ["x"])


@query("outliers_report", sql("""
SELECT 'balance' AS "column", count(CASE WHEN balance < lo OR balance > hi THEN 1 END) AS count,
  round(count(CASE WHEN balance < lo OR balance > hi THEN 1 END) * 100.0 / count(*), 2) AS percentage,
  round(any_value(lo), 3) AS lower_bound, round(any_value(hi), 3) AS upper_bound,
  round(min(CASE WHEN balance < lo OR balance > hi THEN balance END), 3) AS min_outlier,
  round(max(CASE WHEN balance < lo OR balance > hi THEN balance END), 3) AS max_outlier FROM dc, f""", DC, _Q, _F))
def outliers_simple_(spark, sf):
    return outliers_simple(dirty_customer(spark, sf), ["balance"])


@query("outlier_rows", """
SELECT 'lineitem' AS source, count(*) AS outlier_rows FROM lineitem, (SELECT
  quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3, quantile_cont(l_extendedprice, 0.25) AS e1,
  quantile_cont(l_extendedprice, 0.75) AS e3, quantile_cont(l_tax * l_tax, 0.25) AS t1, quantile_cont(l_tax * l_tax, 0.75) AS t3 FROM lineitem)
WHERE l_quantity < q1 - 1.5*(q3-q1) OR l_quantity > q3 + 1.5*(q3-q1) OR l_extendedprice < e1 - 1.5*(e3-e1)
   OR l_extendedprice > e3 + 1.5*(e3-e1) OR l_tax * l_tax < t1 - 1.5*(t3-t1) OR l_tax * l_tax > t3 + 1.5*(t3-t1)""")
def outlier_rows(spark, sf):
    d = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_tax") * F.col("l_tax")).alias("t2"))
    return spark.createDataFrame([("lineitem", outlier_row_count(d))], "source string, outlier_rows bigint")


def _fix(method, **kw):
    def run(spark, sf):
        d = op.fix_outliers(dirty_customer(spark, sf), "balance", method, **kw)
        return d.select("c_custkey", F.round("balance", 4).alias("balance"))
    return run


_FIX = "SELECT c_custkey, round({}, 4) AS balance FROM dc, f"
query("outliers_cap", sql(_FIX.format(
    "CASE WHEN balance < lo - t THEN lo + 1e-5*i WHEN balance > hi + t THEN hi - 1e-5*i ELSE balance END"), DC, _Q, _F))(_fix("cap"))
query("outliers_clip", sql(_FIX.format(
    "CASE WHEN balance IS NOT NULL THEN least(greatest(balance, lo), hi) END"), DC, _Q, _F))(_fix("cap", exact_clip=True))
query("outliers_impute", sql(_FIX.format(f"CASE WHEN {_OUT} THEN m ELSE balance END"), DC, _Q, _F))(_fix("impute"))
query("outliers_mean", sql(_FIX.format(f"CASE WHEN {_OUT} THEN (SELECT avg(balance) FROM dc) ELSE balance END"),
                           DC, _Q, _F))(_fix("mean"))
query("outliers_remove", sql(_FIX.format("balance") + f" WHERE balance IS NULL OR NOT {_OUT}", DC, _Q, _F))(_fix("remove"))


@query("winsorize", """
SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, lo), hi), 4) AS l_extendedprice FROM lineitem,
 (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem)""")
def winsorize(spark, sf):
    d = op.winsorize(table(spark, sf, "lineitem"), "l_extendedprice")
    return d.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 4).alias("l_extendedprice"))


@query("winsorize_ranks", sql("""
SELECT c_custkey, round(least(greatest(balance, lo), hi), 4) AS balance FROM dc,
 (SELECT min(CASE WHEN r = CAST(floor(n * 0.05) AS BIGINT) + 1 THEN balance END) AS lo,
         min(CASE WHEN r = n - CAST(floor(n * 0.05) AS BIGINT) THEN balance END) AS hi
  FROM (SELECT balance, row_number() OVER (ORDER BY balance) AS r, count(*) OVER () AS n FROM dc WHERE balance IS NOT NULL))
WHERE balance IS NOT NULL""", DC))
def winsorize_ranks(spark, sf):
    d = op.winsorize(dirty_customer(spark, sf), "balance", ranks=True)
    return d.select("c_custkey", F.round("balance", 4).alias("balance")).where("balance is not null")


# ---------------------------------------------------------------- text

@query("trim_whitespace", sql("SELECT c_custkey, trim(name) AS name, segment, trim(email) AS email, phone FROM dc", DC))
def trim_whitespace(spark, sf):
    return op.trim_whitespace(dirty_customer(spark, sf)).select("c_custkey", "name", "segment", "email", "phone")


@query("standardize_case", sql(f"""SELECT c_custkey, upper(name) AS upper_name, lower(name) AS lower_name,
       {sq_title('name')} AS title_name FROM dc""", DC))
def standardize_case(spark, sf):
    d = dirty_customer(spark, sf).select("c_custkey", *[F.col("name").alias(f"{k}_name") for k in ("upper", "lower", "title")])
    for k in ("upper", "lower", "title"):
        d = op.standardize_case(d, f"{k}_name", k)
    return d


@query("standardize_text", """
SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS text FROM documents""")
def standardize_text(spark, sf):
    return op.standardize_text(table(spark, sf, "documents").select("doc_id", "text"), "text")


@query("clean_text_case", sql("""
SELECT c_custkey, upper(regexp_replace(name, '^\\s+|\\s+$', '', 'g')) AS name FROM dc""", DC))
def clean_text_case(spark, sf):
    return op.clean_text(dirty_customer(spark, sf), "name", ["strip", "lower", "upper"]).select("c_custkey", "name")


@query("clean_text_strip", """
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}_\\s]', '', 'g'),
  '[0-9]+', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents""")
def clean_text_strip(spark, sf):
    return op.clean_text(table(spark, sf, "documents"), "text",
                         ["remove_special", "remove_numbers", "remove_extra_spaces"]).select("doc_id", "text")


@query("clean_text_unicode")
def clean_text_unicode(spark, sf):
    return op.clean_text(table(spark, sf, "documents"), "text", ["normalize_unicode"]).select("doc_id", "text")


@query("map_categories", sql("""
SELECT c_custkey, CASE segment WHEN 'BUILDING' THEN 'Construction' WHEN 'building' THEN 'Construction'
  WHEN 'MACHINERY' THEN 'Machines' ELSE segment END AS segment FROM dc""", DC))
def map_categories(spark, sf):
    m = {"BUILDING": "Construction", "building": "Construction", "MACHINERY": "Machines"}
    return op.map_categories(dirty_customer(spark, sf), "segment", m).select("c_custkey", "segment")


_TYPO = "CASE WHEN p_partkey % 7 = 0 THEN replace(p_name, 'i', 'ii') WHEN p_partkey % 11 = 0 THEN concat(upper(p_name), 's') ELSE p_name END"
_FZ = f"""nm AS (SELECT lower(trim({_TYPO})) AS t, min(trim({_TYPO})) AS raw FROM part GROUP BY 1),
pr AS (SELECT a.t, a.raw, b.t AS o, b.raw AS o_raw FROM nm a, nm b WHERE a.t <> b.t AND 1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)) >= 0.82 - 1e-9)"""


@query("fuzzy_categories", sql(f"""
SELECT min(raw) AS value, {sq_title("arg_min(x, [lpad(CAST(1000 - length(x) AS VARCHAR), 5, '0'), x])")} AS canonical, count(DISTINCT o) AS partners
FROM (SELECT t, raw, o, o_raw AS x FROM pr UNION ALL SELECT t, raw, o, raw FROM pr) GROUP BY t""", _FZ))
def fuzzy_categories(spark, sf):
    from ..operators.fuzzy import fuzzy_categories as fuzzy

    return fuzzy(table(spark, sf, "part").select(F.expr(_TYPO).alias("name")), "name")


@query("fuzzy_apply", sql(f"""
SELECT p_partkey, coalesce(k.canonical, {_TYPO}) AS name FROM part LEFT JOIN (
 SELECT t, {sq_title("arg_min(x, [lpad(CAST(1000 - length(x) AS VARCHAR), 5, '0'), x])")} AS canonical FROM
  (SELECT t, o_raw AS x FROM pr UNION ALL SELECT t, raw FROM pr) GROUP BY t) k ON k.t = lower(trim({_TYPO}))""", _FZ))
def fuzzy_apply(spark, sf):
    from ..operators import fuzzy

    d = table(spark, sf, "part").select("p_partkey", F.expr(_TYPO).alias("name"))
    return fuzzy.apply_categories(d, "name", fuzzy.fuzzy_categories(d, "name"))


# ---------------------------------------------------------------- dates

@query("convert_dates", sql(f"SELECT o_orderkey, coalesce(strftime({sq_date('date_text')}, '%Y-%m-%d'), date_text) AS date_text FROM dt", DT))
def convert_dates(spark, sf):
    return op.convert_dates(date_texts(spark, sf), "date_text")


@query("parse_dates_report", sql(f"""
SELECT count({sq_date('date_text')}) AS converted_count, count(*) - count({sq_date('date_text')}) AS failed_count,
       'soon' AS failed_samples FROM dt""", DT))
def parse_dates_report(spark, sf):
    return op.parse_dates_report(date_texts(spark, sf), "date_text")


@query("date_features", """
SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month, day(o_orderdate) AS o_orderdate_day,
  isodow(o_orderdate) - 1 AS o_orderdate_dayofweek, quarter(o_orderdate) AS o_orderdate_quarter,
  CAST(weekofyear(o_orderdate) AS DOUBLE) AS o_orderdate_week_of_year,
  CAST(isodow(o_orderdate) >= 6 AS INT) AS o_orderdate_is_weekend, CAST(day(o_orderdate) = 1 AS INT) AS o_orderdate_is_month_start,
  CAST(last_day(o_orderdate) = CAST(o_orderdate AS DATE) AS INT) AS o_orderdate_is_month_end FROM orders""")
def date_features(spark, sf):
    from ..functions.dates import as_date, date_parts

    d = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    d = d.withColumns(date_parts(as_date(d, "o_orderdate"), "o_orderdate")).drop("o_orderdate")
    big = ("year", "month", "day", "dayofweek", "quarter")
    return d.withColumns({f"o_orderdate_{k}": F.col(f"o_orderdate_{k}").cast("bigint") for k in big})
