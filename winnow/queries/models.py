"""Neighbours, model-based imputation, multivariate outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forest, impute
from ..operators import neighbors as nb
from .base import DC, dirty_customer, query, sql, table


def _part(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 20).alias("b"))


_P = "p AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS a, p_retailprice / 20 AS b FROM part)"
_S = "s AS (SELECT s_suppkey AS k, CAST(s_nationkey AS DOUBLE) AS a, s_acctbal / 100 AS b FROM supplier)"
_D = "sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b))"


@query("knn_join", sql(f"""
SELECT s_suppkey, neighbour, round(d, 6) AS distance, CAST(r AS INT) AS rank FROM (SELECT x.k AS s_suppkey, y.k AS neighbour, {_D} AS d,
 row_number() OVER (PARTITION BY x.k ORDER BY {_D}, y.k) AS r FROM s x, p y) WHERE r <= 3""", _P, _S))
def knn_join(spark, sf):
    q = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("a"), (F.col("s_acctbal") / 100).alias("b"))
    return nb.knn(q, _part(spark, sf), "s_suppkey", "p_partkey", ["a", "b"], 3).withColumn("distance", F.round("distance", 6))


@query("knn_self", sql(f"""
SELECT p_partkey, neighbour, round(d, 6) AS distance, CAST(r AS INT) AS rank FROM (SELECT x.k AS p_partkey, y.k AS neighbour, {_D} AS d,
 row_number() OVER (PARTITION BY x.k ORDER BY {_D}, y.k) AS r FROM p x, p y WHERE x.k <> y.k) WHERE r <= 4""", _P))
def knn_self(spark, sf):
    d = _part(spark, sf)
    return nb.knn(d, d, "p_partkey", "p_partkey", ["a", "b"], 4, exclude_self=True).withColumn("distance", F.round("distance", 6))


@query("knn_predict", sql(f"""
SELECT k AS s_suppkey, round(avg(v), 4) AS prediction FROM (SELECT x.k, y.k AS n, row_number() OVER (PARTITION BY x.k ORDER BY {_D}, y.k) AS r FROM s x, p y) z
 JOIN (SELECT p_partkey, p_retailprice AS v FROM part) t ON t.p_partkey = z.n WHERE r <= 5 GROUP BY 1""", _P, _S))
def knn_predict(spark, sf):
    q = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("a"), (F.col("s_acctbal") / 100).alias("b"))
    t = _part(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_partkey")
    p = nb.knn_predict(t, q, "p_partkey", "s_suppkey", ["a", "b"], "p_retailprice")
    return p.withColumn("prediction", F.round("prediction", 4))


@query("knn_classify", sql(f"""
SELECT k AS s_suppkey, mode(v ORDER BY v) AS prediction FROM (SELECT x.k, y.k AS n, row_number() OVER (PARTITION BY x.k ORDER BY {_D}, y.k) AS r FROM s x, p y) z
 JOIN (SELECT p_partkey, p_brand AS v FROM part) t ON t.p_partkey = z.n WHERE r <= 5 GROUP BY 1""", _P, _S))
def knn_classify(spark, sf):
    q = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("a"), (F.col("s_acctbal") / 100).alias("b"))
    t = _part(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey")
    return nb.knn_predict(t, q, "p_partkey", "s_suppkey", ["a", "b"], "p_brand", classify=True)


@query("knn_impute", sql("""
SELECT c_custkey, round(coalesce(balance, v), 4) AS balance FROM dc LEFT JOIN (SELECT k, avg(y) AS v FROM (
 SELECT q.c_custkey AS k, d.balance AS y, row_number() OVER (PARTITION BY q.c_custkey ORDER BY
  sqrt((q.age - d.age) * (q.age - d.age) + (q.w - d.w) * (q.w - d.w)), d.c_custkey) AS r
 FROM w q, w d WHERE q.balance IS NULL AND d.balance IS NOT NULL) WHERE r <= 5 GROUP BY 1) ON k = c_custkey""", DC,
                         "w AS (SELECT c_custkey, balance, CAST(age AS DOUBLE) AS age, c_custkey / 100 AS w FROM dc)"))
def knn_impute(spark, sf):
    d = dirty_customer(spark, sf).select("c_custkey", "balance", "age", (F.col("c_custkey") / 100).alias("w"))
    return impute.knn_impute(d, "balance", "c_custkey", ["age", "w"]).select("c_custkey", F.round("balance", 4).alias("balance"))


@query("regression_impute", sql("""
SELECT c_custkey, round(coalesce(balance, i + s * age), 4) AS balance FROM dc,
 (SELECT regr_intercept(balance, age) AS i, regr_slope(balance, age) AS s FROM dc WHERE balance IS NOT NULL)""", DC))
def regression_impute(spark, sf):
    d = impute.regression_impute(dirty_customer(spark, sf).select("c_custkey", "balance", "age"), "balance", ["age"])
    return d.select("c_custkey", F.round("balance", 4).alias("balance"))


@query("iterative_impute")
def iterative_impute(spark, sf):
    d = dirty_customer(spark, sf).select("c_custkey", "balance", F.expr("CASE WHEN c_custkey % 7 = 3 THEN NULL ELSE age * 1.0 END").cast("double").alias("age"),
                                         (F.col("age") * 2 + F.col("c_custkey") % 5).cast("double").alias("other"))
    return impute.iterative_impute(d, ["balance", "age", "other"])


_BIG = 9007199254740993


@query("iterative_impute_ids", sql(f"""
SELECT {_BIG} + c_custkey AS id, CAST(age AS BIGINT) AS age, coalesce(cents, CAST(round(i + s * age) AS BIGINT)) AS cents
FROM (SELECT *, CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey % 60 * 100 + c_custkey % 7 AS BIGINT) END AS cents FROM dc),
 (SELECT regr_intercept(c_custkey % 60 * 100 + c_custkey % 7, age) AS i, regr_slope(c_custkey % 60 * 100 + c_custkey % 7, age) AS s FROM dc WHERE c_custkey % 10 <> 0)""", DC))
def iterative_impute_ids(spark, sf):
    """Keys beyond 2^53 stay as they are; integers take rounded values and stay integers."""
    d = dirty_customer(spark, sf).selectExpr(f"{_BIG} + c_custkey AS id", "CAST(age AS BIGINT) AS age",
                                             "CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 60 * 100 + c_custkey % 7 END AS cents")
    return impute.iterative_impute(d, key="id")


@query("isolation_forest")
def isolation_forest(spark, sf):
    return forest.isolation_forest(dirty_customer(spark, sf), "c_custkey", ["balance", "age"])


@query("isolation_forest_summary")
def isolation_forest_summary(spark, sf):
    return forest.outlier_summary(forest.isolation_forest(dirty_customer(spark, sf), "c_custkey", ["balance", "age"]), ["balance", "age"])


@query("lof", sql("""
SELECT x.k AS c_custkey, round(avg(o.lrd) / any_value(x.lrd), 4) AS lof FROM nn JOIN lrd o ON o.k = nn.n JOIN lrd x ON x.k = nn.k GROUP BY x.k""",
                  "p AS (SELECT c_custkey AS k, c_acctbal / 100 AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer)",
                  f"""nn AS (SELECT * FROM (SELECT x.k, y.k AS n, {_D} AS d, row_number() OVER (PARTITION BY x.k ORDER BY {_D}, y.k) AS r
 FROM p x, p y WHERE x.k <> y.k) WHERE r <= 20)""",
                  "kd AS (SELECT k, max(d) AS kd FROM nn GROUP BY 1)",
                  "lrd AS (SELECT nn.k, 1 / (avg(greatest(nn.d, kd.kd)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.k = nn.n GROUP BY nn.k)"))
def lof(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    return nb.local_outlier_factor(d, "c_custkey", ["a", "b"]).select("c_custkey", F.round("lof", 4).alias("lof"))


@query("smote", sql("""SELECT is_machine, synthetic, CASE WHEN synthetic THEN m - n ELSE n END AS n FROM
 (SELECT c_mktsegment = 'MACHINERY' AS is_machine, count(*) AS n, max(count(*)) OVER () AS m FROM customer GROUP BY 1), (VALUES (true), (false)) t(synthetic)
WHERE NOT synthetic OR n < m"""))
def smote(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("nation"), (F.col("c_mktsegment") == "MACHINERY").alias("is_machine"))
    return nb.smote(d, "c_custkey", "is_machine", ["c_acctbal", "nation"]).groupBy("is_machine", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("smote_rows")
def smote_rows(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("nation"), (F.col("c_mktsegment") == "MACHINERY").alias("is_machine"))
    return nb.smote(d, "c_custkey", "is_machine", ["c_acctbal", "nation"])
