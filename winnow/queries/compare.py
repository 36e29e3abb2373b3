"""Comparing two tables, and look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as op
from .base import DC, dirty_customer, query, sql, table


def _old(spark, sf):
    """The customer table in the columns of the dirty one, plus one the dirty one lacks."""
    return table(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))


def _new(spark, sf):
    """The dirty table shifted by a few keys at the end: some keys are new, some are gone."""
    d = dirty_customer(spark, sf).select("c_custkey", "name", "segment", "balance", "email")
    return d.withColumn("c_custkey", F.expr("CASE WHEN c_custkey % 31 = 0 THEN -1 - c_custkey ELSE c_custkey END"))


_A = "a AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance, c_nationkey AS nation FROM customer)"
_B = """b AS (SELECT CASE WHEN c_custkey % 31 = 0 THEN -1 - c_custkey ELSE c_custkey END AS k, name, segment, balance, email FROM dc)"""
_J = """j AS (SELECT a.k AS k1, b.k AS k2, a.name AS n1, b.name AS n2, a.segment AS s1, b.segment AS s2, a.balance AS b1,
       b.balance AS b2 FROM a FULL OUTER JOIN b ON a.k = b.k)"""
_BOTH = "k1 IS NOT NULL AND k2 IS NOT NULL"


@query("diff_rows", sql(f"""
SELECT count(CASE WHEN k1 IS NULL THEN 1 END) AS added, count(CASE WHEN k2 IS NULL THEN 1 END) AS deleted,
       count(CASE WHEN {_BOTH} AND (n1 IS DISTINCT FROM n2 OR s1 IS DISTINCT FROM s2 OR b1 IS DISTINCT FROM b2)
             THEN 1 END) AS modified FROM j""", DC, _A, _B, _J))
def diff_rows(spark, sf):
    return op.diff_rows(_old(spark, sf), _new(spark, sf), "c_custkey")


_CHANGES = f"""
SELECT k1 AS c_custkey, 'name' AS "column", n1 AS old_value, n2 AS new_value FROM j WHERE {_BOTH} AND n1 IS DISTINCT FROM n2
UNION ALL SELECT k1, 'segment', s1, s2 FROM j WHERE {_BOTH} AND s1 IS DISTINCT FROM s2"""


@query("diff_changes", sql(_CHANGES, DC, _A, _B, _J))
def diff_changes(spark, sf):
    return op.diff_changes(_old(spark, sf).drop("balance"), _new(spark, sf).drop("balance"), "c_custkey")


@query("diff_sample", sql(f"""SELECT * FROM ({_CHANGES}) WHERE c_custkey IN
(SELECT DISTINCT c_custkey FROM ({_CHANGES}) ORDER BY 1 LIMIT 20)""", DC, _A, _B, _J))
def diff_sample(spark, sf):
    return op.diff_sample(_old(spark, sf).drop("balance"), _new(spark, sf).drop("balance"), "c_custkey")


@query("diff_cells", sql(f"""
SELECT k1 AS c_custkey, n1 IS DISTINCT FROM n2 AS name_changed, s1 IS DISTINCT FROM s2 AS segment_changed,
       b1 IS DISTINCT FROM b2 AS balance_changed FROM j WHERE {_BOTH}""", DC, _A, _B, _J))
def diff_cells(spark, sf):
    return op.diff_cells(_old(spark, sf), _new(spark, sf), "c_custkey")


@query("diff_schema", """
SELECT * FROM (VALUES ('c_custkey', 'same', 'number', 'number'), ('name', 'same', 'text', 'text'),
  ('segment', 'same', 'text', 'text'), ('balance', 'same', 'number', 'number'), ('nation', 'removed', 'number', NULL),
  ('email', 'added', NULL, 'text'), ('code', 'type_changed', 'number', 'text')) t("column", status, old_type, new_type)""")
def diff_schema(spark, sf):
    old = _old(spark, sf).withColumn("code", F.col("c_custkey"))
    new = _new(spark, sf).withColumn("code", F.concat(F.lit("C"), F.col("c_custkey")))
    return op.diff_schema(old, new)


@query("diff_stats", sql("""
SELECT 'c_custkey' AS "column", true AS in_old, true AS in_new, CAST(0 AS BIGINT) AS missing_old, CAST(0 AS BIGINT) AS missing_new,
  round((SELECT avg(k) FROM a), 4) AS mean_old, round((SELECT avg(k) FROM b), 4) AS mean_new,
  (SELECT count(DISTINCT k) FROM a) AS unique_old, (SELECT count(DISTINCT k) FROM b) AS unique_new
UNION ALL SELECT 'name', true, true, 0, 0, NULL, NULL, (SELECT count(DISTINCT name) FROM a), (SELECT count(DISTINCT name) FROM b)
UNION ALL SELECT 'segment', true, true, 0, (SELECT count(*) FROM b WHERE segment IS NULL OR lower(segment) = 'n/a'), NULL, NULL,
  (SELECT count(DISTINCT segment) FROM a), (SELECT count(DISTINCT segment) FROM b)
UNION ALL SELECT 'balance', true, true, 0, (SELECT count(*) FROM b WHERE balance IS NULL),
  round((SELECT avg(balance) FROM a), 4), round((SELECT avg(balance) FROM b), 4),
  (SELECT count(DISTINCT balance) FROM a), (SELECT count(DISTINCT balance) FROM b)
UNION ALL SELECT 'nation', true, false, 0, NULL, round((SELECT avg(nation) FROM a), 4), NULL, (SELECT count(DISTINCT nation) FROM a), NULL
UNION ALL SELECT 'email', false, true, NULL, 0, NULL, NULL, NULL, (SELECT count(DISTINCT email) FROM b)""", DC, _A, _B))
def diff_stats(spark, sf):
    return op.diff_stats(_old(spark, sf), _new(spark, sf))
