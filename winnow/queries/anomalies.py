"""Anomaly detectors and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomalies as an
from .base import DC, DE, dirty_customer, dirty_events, query, sql, table

_DESC = """SELECT '{kind}' AS type, '{sev}' AS severity, '{col}' AS "column", count(*) AS count, {ex} AS example FROM {src} WHERE {cond}
HAVING count(*) > 0"""


def _find(kind, sev, col, src, cond, ex="NULL"):
    return _DESC.format(kind=kind, sev=sev, col=col, src=src, cond=cond, ex=ex)


def _num_example(d):
    """Numbers as text differ between engines in the last digits: compare them as numbers."""
    return d.withColumn("example", F.round(F.expr("try_cast(example AS DOUBLE)"), 4))


@query("an_zscore", sql(f"""SELECT type, CASE WHEN count / n > 0.05 THEN 'critical' ELSE 'warning' END AS severity, "column", count, example FROM (
{_find('statistical_zscore', 'warning', 'balance', 'dc, (SELECT avg(balance) AS m, stddev_samp(balance) AS s FROM dc)', 'abs(balance - m) / s > 3',
       'round(min(balance), 4)')}), (SELECT count(balance) AS n FROM dc)""", DC))
def an_zscore(spark, sf):
    return _num_example(an.zscore(dirty_customer(spark, sf).drop("c_custkey")))


_QB = "(SELECT quantile_cont(balance, 0.25) AS a, quantile_cont(balance, 0.75) AS b FROM dc)"


@query("an_iqr_extreme", sql(_find("statistical_iqr_extreme", "critical", "balance", f"dc, {_QB}",
                                   "balance < a - 3*(b-a) OR balance > b + 3*(b-a)", "round(min(balance), 4)"), DC))
def an_iqr_extreme(spark, sf):
    return _num_example(an.iqr_extreme(dirty_customer(spark, sf)))


_MAH = """m AS (SELECT avg(balance) AS mb, avg(age) AS ma, var_samp(balance) AS vb, var_samp(age) AS va, covar_samp(balance, age) AS cv
 FROM dc WHERE balance IS NOT NULL)"""
_D2 = "((balance-mb)*(balance-mb)*va - 2*(balance-mb)*(age-ma)*cv + (age-ma)*(age-ma)*vb) / (va*vb - cv*cv)"


@query("mahalanobis", sql(f"""SELECT c_custkey, round(sqrt({_D2}), 6) AS distance, sqrt({_D2}) > sqrt(13.815510557964274) AS is_outlier
FROM dc, m WHERE balance IS NOT NULL""", DC, _MAH))
def mahalanobis(spark, sf):
    from ..functions.stats import chi2_quantile

    d = an.mahalanobis_distance(dirty_customer(spark, sf), ["balance", "age"]).where("distance is not null")
    cut = chi2_quantile(0.999, 2) ** 0.5
    return d.select("c_custkey", F.round("distance", 6).alias("distance"), (F.col("distance") > cut).alias("is_outlier"))


@query("an_mahalanobis", sql(_find("multivariate_mahalanobis", "warning", "balance, age", "dc, m", f"{_D2} > 13.815510557964274", "CAST(NULL AS VARCHAR)"),
                             DC, _MAH))
def an_mahalanobis(spark, sf):
    return an.mahalanobis(dirty_customer(spark, sf), ["balance", "age"])


_SPIKE = "CASE WHEN event_id % 211 = 0 THEN 1000.0 ELSE value END"


def _spiky(spark, sf):
    return dirty_events(spark, sf).select("event_id", F.expr(_SPIKE).alias("value"))


_SP = f"sp AS (SELECT event_id, {_SPIKE} AS value FROM ev)"


@query("an_jump", sql("""SELECT 'pattern_sudden_jump' AS type, 'warning' AS severity, 'value' AS "column", count(*) AS count, round(min(value), 4) AS example
FROM (SELECT value, value - lag(value) OVER (ORDER BY event_id) AS d FROM sp WHERE value IS NOT NULL), (SELECT stddev_samp(value) AS s FROM sp)
WHERE abs(d) > 3 * s""", DE, _SP))
def an_jump(spark, sf):
    return _num_example(an.sudden_jump(_spiky(spark, sf), "event_id", ["value"]))


@query("an_streak", sql("""SELECT 'pattern_repeated_sequence' AS type, 'warning' AS severity, 'value' AS "column", count(*) AS count, round(min(value), 4) AS example
FROM (SELECT value, count(*) OVER (PARTITION BY run) AS k FROM (SELECT event_id, value, sum(CASE WHEN value IS DISTINCT FROM p THEN 1 ELSE 0 END)
 OVER (ORDER BY event_id) AS run FROM (SELECT event_id, value, lag(value) OVER (ORDER BY event_id) AS p FROM ev WHERE value IS NOT NULL))) WHERE k >= 10""", DE))
def an_streak(spark, sf):
    return _num_example(an.repeated_sequence(dirty_events(spark, sf), "event_id", ["value"]))


_RB = "rb AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN c_custkey ELSE (c_custkey + 1) * 10 END AS x FROM customer)"


@query("an_round_bias", sql("""SELECT 'pattern_round_number_bias' AS type, 'info' AS severity, 'x' AS "column", count(CASE WHEN x % 10 = 0 THEN 1 END) AS count,
 CAST(min(x) AS DOUBLE) AS example FROM rb WHERE x > 0""", _RB))
def an_round_bias(spark, sf):
    d = table(spark, sf, "customer").select(F.expr("CASE WHEN c_custkey % 9 = 0 THEN c_custkey ELSE (c_custkey + 1) * 10 END").alias("x"), "c_acctbal")
    return _num_example(an.round_bias(d))


_Z = "z AS (SELECT o_orderkey, CASE WHEN o_orderkey % 12 = 0 THEN 0 ELSE o_totalprice END AS total FROM orders)"


@query("an_zeros", sql("""SELECT 'pattern_suspicious_zeros' AS type, 'warning' AS severity, 'total' AS "column", count(*) AS count, CAST(0 AS DOUBLE) AS example
FROM z WHERE total = 0 AND (SELECT min(total) FROM z WHERE total > 0) > 50""", _Z))
def an_zeros(spark, sf):
    return _num_example(an.suspicious_zeros(_zeros(spark, sf)))


def _zeros(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 12 = 0 THEN 0D ELSE o_totalprice END").alias("total"))


# ---------------------------------------------------------------- text

@query("an_text_length", """SELECT 'text_extreme_length' AS type, 'warning' AS severity, 'text' AS "column", count(*) AS count, max(length(text)) || ' characters' AS example
FROM documents, (SELECT avg(length(text)) + 3 * stddev_samp(length(text)) AS cut FROM documents) WHERE length(text) > cut""")
def an_text_length(spark, sf):
    return an.extreme_length(table(spark, sf, "documents").select("text", "lang"))


@query("an_copy_paste", """SELECT 'text_copy_paste_anomaly' AS type, 'info' AS severity, 'label' AS "column", n AS count, left(label, 60) AS example
FROM (SELECT concat(p_brand, ' / ', p_type, ' / a label long enough to be copied') AS label, count(*) AS n FROM part GROUP BY 1)
WHERE n >= 5 ORDER BY n DESC, md5(label) DESC LIMIT 1""")
def an_copy_paste(spark, sf):
    d = table(spark, sf, "part").select(F.concat("p_brand", F.lit(" / "), "p_type", F.lit(" / a label long enough to be copied")).alias("label"))
    return an.copy_paste(d)


@query("an_mixed_scripts", """SELECT * FROM (SELECT 'text_mixed_scripts' AS type, 'info' AS severity, 'text' AS "column",
 count(CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 1 END) AS count, CAST(NULL AS VARCHAR) AS example FROM documents)
WHERE count / (SELECT count(*) FROM documents) > 0.05 AND count / (SELECT count(*) FROM documents) < 0.95""")
def an_mixed_scripts(spark, sf):
    return an.mixed_scripts(table(spark, sf, "documents").select("text"))


# ---------------------------------------------------------------- dates

@query("an_date_future", _find("date_future", "critical", "o_orderdate", "orders", "o_orderdate > TIMESTAMP '1998-01-01'",
                               "strftime(min(o_orderdate), '%Y-%m-%d')"))
def an_date_future(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderdate").alias("due_date"))
    return an.date_future(d, "1998-01-01")


_OLD = "CASE WHEN o_orderkey % 77 = 0 THEN TIMESTAMP '1899-12-31' ELSE o_orderdate END"


@query("an_date_old", f"""SELECT 'date_historic_old' AS type, 'warning' AS severity, 'day' AS "column", count(*) AS count, strftime(min(d), '%Y-%m-%d') AS example
FROM (SELECT {_OLD} AS d FROM orders) WHERE d < TIMESTAMP '1900-01-01'""")
def an_date_old(spark, sf):
    return an.date_old(table(spark, sf, "orders").select(F.expr(_OLD.replace("TIMESTAMP", "TIMESTAMP_NTZ")).alias("day")))


@query("an_date_gap", f"""SELECT 'date_gap_jump' AS type, 'warning' AS severity, 'day' AS "column", count(*) AS count, min(g) || ' days gap' AS example FROM (
 SELECT date_diff('day', lag(d) OVER (ORDER BY d), d) AS g FROM (SELECT {_OLD} AS d FROM orders)) WHERE g > 365""")
def an_date_gap(spark, sf):
    return an.date_gap_jump(table(spark, sf, "orders").select(F.expr(_OLD.replace("TIMESTAMP", "TIMESTAMP_NTZ")).alias("day")))


@query("an_weekend", _find("date_weekend_business", "info", "invoice_date", "orders", "isodow(o_orderdate) >= 6", "strftime(min(o_orderdate), '%Y-%m-%d')"))
def an_weekend(spark, sf):
    return an.date_weekend(table(spark, sf, "orders").select("o_orderdate", F.col("o_orderdate").alias("invoice_date")))


# ---------------------------------------------------------------- business rules

@query("an_negative", sql(_find("business_negative_value", "critical", "age", "dc", "age < 0", "CAST(min(age) AS VARCHAR)"), DC))
def an_negative(spark, sf):
    return an.negative_values(dirty_customer(spark, sf))


@query("an_pct_over_100", _find("business_percentage_over_100", "critical", "tax_rate", "lineitem", "l_quantity * 2.5 > 100", "min(l_quantity * 2.5)"))
def an_pct_over_100(spark, sf):
    return _num_example(an.percentage_over_100(table(spark, sf, "lineitem").selectExpr("l_quantity * 2.5D AS tax_rate", "l_extendedprice")))


@query("an_dup_id", """SELECT 'business_duplicate_identifier' AS type, 'critical' AS severity, 'user_id' AS "column", sum(n)::BIGINT AS count, min(CAST(user_id AS VARCHAR)) AS example
FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1)""")
def an_dup_id(spark, sf):
    return an.duplicate_identifier(table(spark, sf, "events").select("event_id", "user_id", "value"))


@query("an_invalid_email", sql(_find("business_invalid_email", "warning", "email", "dc", "NOT regexp_matches(email, '^[\\p{L}\\p{N}_.-]+@[\\p{L}\\p{N}_.-]+\\.[\\p{L}\\p{N}_]+$')",
                                     "min(email)"), DC))
def an_invalid_email(spark, sf):
    return an.invalid_email(dirty_customer(spark, sf))


@query("an_by_column", sql(_find("business_negative_value", "critical", "age", "dc", "age < 0", "CAST(min(age) AS VARCHAR)"), DC))
def an_by_column(spark, sf):
    d = dirty_customer(spark, sf).select("age", "email")
    return an.by_column(an.negative_values(d).unionByName(an.invalid_email(d)), "age")


@query("an_all")
def an_all(spark, sf):
    return an.detect_all(dirty_customer(spark, sf), order="c_custkey")


@query("an_flags", sql(f"""
SELECT c_custkey, 'business_negative_value' AS type, 'age' AS "column" FROM dc WHERE age < 0
UNION ALL SELECT c_custkey, 'business_invalid_email', 'email' FROM dc WHERE email = 'invalid-email'
UNION ALL SELECT c_custkey, 'statistical_iqr_extreme', 'balance' FROM dc, {_QB} WHERE balance < a - 3*(b-a) OR balance > b + 3*(b-a)
UNION ALL SELECT c_custkey, 'statistical_zscore', 'balance' FROM dc, (SELECT avg(balance) AS m, stddev_samp(balance) AS s FROM dc) WHERE abs(balance - m) / s > 3""", DC))
def an_flags(spark, sf):
    return an.flags(dirty_customer(spark, sf).select("c_custkey", "balance", "age", "email"), "c_custkey")


_SPJ = f"sj AS (SELECT event_id, user_id, {_SPIKE} AS value, ts FROM ev)"


def _trades(spark, sf):
    return dirty_events(spark, sf).select("event_id", F.col("user_id").cast("string").alias("user_id"), F.expr(_SPIKE).alias("value"),
                                          F.col("ts").alias("trade_date"))


_ST = """st AS (SELECT avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM sj)"""
_FLAGS = """
SELECT event_id, 'statistical_zscore' AS type, 'value' AS "column" FROM sj, st WHERE abs(value - m) / s > 3
UNION ALL SELECT event_id, 'statistical_iqr_extreme', 'value' FROM sj, st WHERE value < a - 3*(b-a) OR value > b + 3*(b-a)
UNION ALL SELECT event_id, 'business_duplicate_identifier', 'user_id' FROM sj WHERE user_id IN (SELECT user_id FROM sj GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT event_id, 'pattern_sudden_jump', 'value' FROM (SELECT event_id, value - lag(value) OVER (ORDER BY event_id) AS d FROM sj WHERE value IS NOT NULL), st WHERE abs(d) > 3 * s
UNION ALL SELECT event_id, 'pattern_repeated_sequence', 'value' FROM (SELECT event_id, count(*) OVER (PARTITION BY run) AS n FROM
  (SELECT event_id, sum(fresh) OVER (ORDER BY event_id) AS run FROM
   (SELECT event_id, CASE WHEN value IS DISTINCT FROM lag(value) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS fresh FROM sj WHERE value IS NOT NULL))) WHERE n >= 10
UNION ALL SELECT event_id, 'date_weekend_business', 'trade_date' FROM sj WHERE isodow(ts) >= 6"""


@query("an_flags_all", sql(_FLAGS, DE, _SPJ, _ST))
def an_flags_all(spark, sf):
    return an.all_flags(_trades(spark, sf), "event_id", order="event_id")


@query("an_all_dated", sql("""SELECT type, CASE WHEN type IN ('statistical_iqr_extreme', 'business_duplicate_identifier', 'date_future') THEN 'critical'
  WHEN type = 'date_weekend_business' THEN 'info' ELSE 'warning' END AS severity, "column", count(*) AS count FROM f GROUP BY ALL""", DE, _SPJ, _ST,
  f"f AS ({_FLAGS}\nUNION ALL SELECT event_id, 'date_future', 'trade_date' FROM sj WHERE ts > TIMESTAMP '2024-01-20 00:00:00')"))
def an_all_dated(spark, sf):
    """Every detector at once, order and clock given."""
    return an.detect_all(_trades(spark, sf), order="event_id", as_of="2024-01-20").drop("example")


@query("an_flags_copies", """SELECT doc_id, 'text_copy_paste_anomaly' AS type, 'body' AS "column" FROM documents
WHERE length(text) > 40 AND text IN (SELECT text FROM documents GROUP BY 1 HAVING count(*) >= 5)
UNION ALL SELECT doc_id, 'text_extreme_length', 'body' FROM documents, (SELECT avg(length(text)) AS m, stddev_samp(length(text)) AS s FROM documents) WHERE length(text) > m + 3 * s""")
def an_flags_copies(spark, sf):
    """Every copy of every long text found five times or more."""
    d = an.all_flags(table(spark, sf, "documents").select("doc_id", F.col("text").alias("body")), "doc_id")
    return d.where("type IN ('text_copy_paste_anomaly', 'text_extreme_length')")


# ---------------------------------------------------------------- repairs

@query("fx_negative", sql("SELECT c_custkey, abs(age) AS age FROM dc", DC))
def fx_negative(spark, sf):
    return an.fix_negative(dirty_customer(spark, sf).select("c_custkey", "age"), "age")


@query("fx_pct", "SELECT l_orderkey, l_linenumber, least(l_quantity * 2.5, 100) AS tax_rate FROM lineitem")
def fx_pct(spark, sf):
    return an.fix_percentage(table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity * 2.5D AS tax_rate"), "tax_rate")


@query("fx_extreme", sql(f"""SELECT c_custkey, round(CASE WHEN balance IS NOT NULL THEN least(greatest(balance, a - 2.5*(b-a)), b + 2.5*(b-a)) END, 6) AS balance
FROM dc, {_QB}""", DC))
def fx_extreme(spark, sf):
    d = an.fix_extreme(dirty_customer(spark, sf).select("c_custkey", "balance"), "balance")
    return d.withColumn("balance", F.round("balance", 6))


@query("fx_zeros", sql("SELECT o_orderkey, round(CASE WHEN total = 0 THEN (SELECT median(total) FROM z WHERE total > 0) ELSE total END, 4) AS total FROM z", _Z))
def fx_zeros(spark, sf):
    return an.fix_zeros(_zeros(spark, sf), "total").withColumn("total", F.round("total", 4))


@query("fx_email", sql("SELECT c_custkey, CASE WHEN email <> 'invalid-email' THEN email END AS email FROM dc", DC))
def fx_email(spark, sf):
    return an.fix_email(dirty_customer(spark, sf).select("c_custkey", "email"), "email")


@query("fx_text_length", """SELECT doc_id, left(text, cut) AS text FROM documents,
 (SELECT CAST(floor(avg(length(text)) + 3 * stddev_samp(length(text))) AS BIGINT) AS cut FROM documents)""")
def fx_text_length(spark, sf):
    return an.fix_text_length(table(spark, sf, "documents").select("doc_id", "text"), "text")


@query("fx_dup_id", """SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1
 THEN user_id || '_dup_' || event_id ELSE CAST(user_id AS VARCHAR) END AS user_id FROM events""")
def fx_dup_id(spark, sf):
    return an.fix_duplicate_id(table(spark, sf, "events").select("event_id", "user_id"), "user_id", "event_id")


@query("fx_jump", sql("""SELECT event_id, round(median(value) OVER (ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS value FROM sp""", DE, _SP))
def fx_jump(spark, sf):
    return an.fix_jump(_spiky(spark, sf), "value", "event_id").withColumn("value", F.round("value", 6))


@query("fx_all", sql(f"""SELECT c_custkey, round(CASE WHEN balance IS NOT NULL THEN least(greatest(balance, a - 2.5*(b-a)), b + 2.5*(b-a)) END, 6) AS balance,
 abs(age) AS age, CASE WHEN email <> 'invalid-email' THEN email END AS email FROM dc, {_QB}""", DC))
def fx_all(spark, sf):
    d = dirty_customer(spark, sf).select("c_custkey", "balance", "age", "email")
    return an.fix_all(d, "c_custkey").withColumn("balance", F.round("balance", 6))


# ---------------------------------------------------------------- keys beyond 2^53, integers, and tables without text

_BIG = 9007199254740993
_NUM = f"""nu AS (SELECT event_id + {_BIG} AS event_id, {_SPIKE} AS value, CASE WHEN event_id % 23 = 0 THEN -5 ELSE CAST(18 + event_id % 60 AS INT) END AS qty FROM ev)"""
_NS = """ns AS (SELECT avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM nu)"""


def _all_numeric(spark, sf):
    return dirty_events(spark, sf).selectExpr(f"event_id + {_BIG} AS event_id", f"{_SPIKE} AS value",
                                              "CASE WHEN event_id % 23 = 0 THEN -5 ELSE CAST(18 + event_id % 60 AS INT) END AS qty")


@query("an_all_numeric", sql("""SELECT type, severity, "column", count(*) AS count FROM (
SELECT 'statistical_zscore' AS type, 'warning' AS severity, 'value' AS "column" FROM nu, ns WHERE abs(value - m) / s > 3
UNION ALL SELECT 'statistical_iqr_extreme', 'critical', 'value' FROM nu, ns WHERE value < a - 3*(b-a) OR value > b + 3*(b-a)
UNION ALL SELECT 'multivariate_mahalanobis', 'warning', 'value, qty' FROM nu,
  (SELECT avg(value) AS mv, avg(qty) AS mq, var_samp(value) AS vv, var_samp(qty) AS vq, covar_samp(value, qty) AS cv FROM nu WHERE value IS NOT NULL)
  WHERE ((value-mv)*(value-mv)*vq - 2*(value-mv)*(qty-mq)*cv + (qty-mq)*(qty-mq)*vv) / (vv*vq - cv*cv) > 13.815510557964274
UNION ALL SELECT 'business_negative_value', 'critical', 'qty' FROM nu WHERE qty < 0) GROUP BY ALL""", DE, _NUM, _NS))
def an_all_numeric(spark, sf):
    """Every detector on a table without text or dates; the key is no measurement."""
    return an.detect_all(_all_numeric(spark, sf), key="event_id").drop("example")


@query("fx_all_numeric", sql("""SELECT event_id, round(CASE WHEN value IS NOT NULL THEN least(greatest(value, a - 2.5*(b-a)), b + 2.5*(b-a)) END, 6) AS value,
 abs(qty) AS qty FROM nu, ns""", DE, _NUM, _NS))
def fx_all_numeric(spark, sf):
    """Keys and integers stay exact."""
    return an.fix_all(_all_numeric(spark, sf), "event_id").withColumn("value", F.round("value", 6))


_INT = f"""it AS (SELECT event_id, {_BIG} + event_id AS big, CAST(event_id % 150 AS BIGINT) AS pct, CASE WHEN event_id % 20 = 0 THEN 0 ELSE 100 + event_id % 7 END AS paid,
 CASE WHEN event_id % 997 = 0 THEN {_BIG} ELSE event_id % 40 END AS level FROM events)"""


def _integers(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id", f"{_BIG} + event_id AS big", "event_id % 150 AS pct", "CASE WHEN event_id % 20 = 0 THEN 0 ELSE 100 + event_id % 7 END AS paid",
        f"CASE WHEN event_id % 997 = 0 THEN {_BIG} ELSE event_id % 40 END AS level")


@query("fx_pct_integer", sql("SELECT big, least(pct, 100) AS pct FROM it", _INT))
def fx_pct_integer(spark, sf):
    return an.fix_percentage(_integers(spark, sf).select("big", "pct"), "pct")


@query("fx_zeros_integer", sql("""SELECT big, CASE WHEN paid = 0 THEN CAST(round((SELECT median(paid) FROM it WHERE paid > 0)) AS BIGINT) ELSE paid END AS paid FROM it""", _INT))
def fx_zeros_integer(spark, sf):
    return an.fix_zeros(_integers(spark, sf).select("big", "paid"), "paid")


@query("fx_extreme_integer", sql("""SELECT big, CASE WHEN level > hi THEN CAST(floor(hi) AS BIGINT) WHEN level < lo THEN CAST(ceil(lo) AS BIGINT) ELSE level END AS level FROM it,
 (SELECT a - 2.5 * (b - a) AS lo, b + 2.5 * (b - a) AS hi FROM (SELECT quantile_cont(level, 0.25) AS a, quantile_cont(level, 0.75) AS b FROM it))""", _INT))
def fx_extreme_integer(spark, sf):
    return an.fix_extreme(_integers(spark, sf).select("big", "level"), "level")


@query("fx_jump_integer", sql("""SELECT event_id, CASE WHEN p IS NULL OR q IS NULL THEN CAST(round((level::HUGEINT + coalesce(p, q)) / 2.0) AS BIGINT)
 ELSE greatest(least(p, level), least(greatest(p, level), q)) END AS level
FROM (SELECT event_id, level, lag(level) OVER w AS p, lead(level) OVER w AS q FROM it WINDOW w AS (ORDER BY event_id))""", _INT))
def fx_jump_integer(spark, sf):
    return an.fix_jump(_integers(spark, sf).select("event_id", "level"), "level", "event_id")
