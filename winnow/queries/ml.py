"""Feature engineering, model training, clustering, metrics."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.stats import rows_to_df
from ..ml import cluster as cl
from ..ml import explain as ex
from ..ml import features as ft
from ..ml import metrics as mt
from ..ml import models as md
from .base import dirty_customer, query, sql, table, work_dir


def _docs(spark, sf):
    """Labelled documents with plain features; the class is the quality label."""
    t = table(spark, sf, "documents")
    d = t.selectExpr("doc_id", "n_chars", "lang", "source", "size(split(text, ' ')) AS words",
                     "length(text) - length(regexp_replace(text, '[0-9]', '')) AS digits",
                     "length(text) - length(replace(text, '.', '')) AS stops")
    return d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label_quality")), "doc_id")


def _parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice",
                                           (F.col("p_partkey") % 1000).alias("serial"))


# ---------------------------------------------------------------- targets and suggestions

@query("detect_target", """SELECT 'o_custkey' AS target, 'regression' AS task, 65 AS confidence""")
def detect_target(spark, sf):
    return ft.detect_target(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"))


@query("suggest_targets", "SELECT * FROM (VALUES ('o_orderkey', 'regression', 'high'), ('o_custkey', 'regression', 'high'), "
                          "('o_orderstatus', 'classification', 'high'), ('o_totalprice', 'regression', 'high'), "
                          "('o_orderpriority', 'classification', 'high')) t(target, task, confidence)")
def suggest_targets(spark, sf):
    return ft.suggest_targets(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))


@query("task_type", "SELECT * FROM (VALUES ('o_orderstatus', 'classification'), ('o_totalprice', 'regression'), ('o_custkey', 'regression')) t(\"column\", task)")
def task_type(spark, sf):
    d = table(spark, sf, "orders")
    return rows_to_df(spark, [(n, ft.task_of(d, n)) for n in ("o_orderstatus", "o_totalprice", "o_custkey")], "column string, task string")


@query("suggest_features", "SELECT * FROM (VALUES ('date_decomposition', 'o_orderdate', 'extract_date_features', CAST(NULL AS VARCHAR)), "
                           "('text_features', 'label', 'create_text_metrics', CAST(NULL AS VARCHAR))) "
                           "t(type, \"column\", action, other)")
def suggest_features(spark, sf):
    return ft.suggest_features(table(spark, sf, "orders").selectExpr("o_orderstatus", "o_orderdate", "o_totalprice",
                                                                     "concat('Order number ', o_orderkey) AS label"))


@query("auto_engineer", """SELECT o_orderkey, length('Order of customer ' || o_custkey) AS label_char_length,
 4 AS label_word_count, round(count(*) OVER (PARTITION BY o_custkey) / count(*) OVER (), 8) AS label_freq, year(o_orderdate) AS o_orderdate_year,
 month(o_orderdate) AS o_orderdate_month, CAST(isodow(o_orderdate) >= 6 AS INT) AS o_orderdate_is_weekend FROM orders""")
def auto_engineer(spark, sf):
    d = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderdate", "concat('Order of customer ', o_custkey) AS label")
    d = ft.auto_engineer(d)
    return d.select("o_orderkey", F.col("label_char_length").cast("bigint").alias("label_char_length"), "label_word_count",
                    F.round("label_freq", 8).alias("label_freq"), F.col("o_orderdate_year").cast("bigint").alias("o_orderdate_year"),
                    F.col("o_orderdate_month").cast("bigint").alias("o_orderdate_month"), "o_orderdate_is_weekend")


@query("ml_preprocess")
def ml_preprocess(spark, sf):
    d = dirty_customer(spark, sf).select("c_custkey", "segment", "balance", "age")
    p = ft.prepare(d, "balance", "regression", skip=["c_custkey"])
    return ft.labelled(p, d).select("c_custkey", vector_to_array("features").alias("features"), "label")


@query("train_test_split", """SELECT o_orderstatus, greatest(1, CAST(round_even(count(*) * 0.2, 0) AS BIGINT)) AS test FROM orders GROUP BY 1""")
def train_test_split(spark, sf):
    _, b = ft.split(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 0.2, by="o_orderstatus")
    return b.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("test"))


_Z = "(l_{0} - avg(l_{0}) OVER ()) / stddev_samp(l_{0}) OVER () AS {1}"


@query("poly_features", sql("""SELECT l_orderkey, l_linenumber, round(x, 6) AS x, round(x * x, 6) AS xx, round(y, 6) AS y, round(x * y, 6) AS xy,
 round(y * y, 6) AS yy FROM z""", f"z AS (SELECT l_orderkey, l_linenumber, {_Z.format('quantity', 'x')}, {_Z.format('tax', 'y')} FROM lineitem)"))
def poly_features(spark, sf):
    d = ft.poly_features(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"], 2)
    terms = vector_to_array("poly")
    return d.select("l_orderkey", "l_linenumber", *[F.round(terms[i], 6).alias(n) for i, n in enumerate(("x", "xx", "y", "xy", "yy"))])


# ---------------------------------------------------------------- single algorithms

def _train(name, regression=False):
    def run(spark, sf):
        d, key, target = (_parts(spark, sf), "p_partkey", "p_retailprice") if regression else (_docs(spark, sf), "doc_id", "label_quality")
        _, p, scored = md.train(d, key, target, name, "regression" if regression else "classification")
        return mt.metrics_table(spark, md.test_metrics(scored, p))
    return run


for _q, _n in (("clf_logistic", "Logistic Regression"), ("clf_tree", "Decision Tree"), ("clf_rf", "Random Forest"),
               ("clf_gbt", "Gradient Boosting"), ("clf_svc", "Linear SVC"), ("clf_nb", "Gaussian Naive Bayes"),
               ("clf_nb_bernoulli", "Bernoulli Naive Bayes"), ("clf_mlp", "Neural Net")):
    query(_q)(_train(_n))
for _q, _n in (("reg_tree", "Decision Tree"), ("reg_rf", "Random Forest"), ("reg_gbt", "Gradient Boosting"),
               ("reg_ridge", "Ridge Regression"), ("reg_lasso", "Lasso Regression"), ("reg_elastic", "ElasticNet"),
               ("reg_huber", "Huber Regressor")):
    query(_q)(_train(_n, True))


@query("reg_linear", """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
 round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""")
def reg_linear(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    d = table(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    m = LinearRegression().fit(VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(d))
    return rows_to_df(spark, [(round(float(m.coefficients[0]), 4), round(m.intercept, 4), round(m.summary.r2, 6))],
                      "slope double, intercept double, r2 double")


# ---------------------------------------------------------------- comparing

@query("leaderboard_clf")
def leaderboard_clf(spark, sf):
    return md.leaderboard(_docs(spark, sf), "doc_id", "label_quality", "classification")


@query("leaderboard_reg")
def leaderboard_reg(spark, sf):
    return md.leaderboard(_parts(spark, sf), "p_partkey", "p_retailprice", "regression")


@query("compare_models")
def compare_models(spark, sf):
    return md.compare_models(_parts(spark, sf), "p_partkey", "p_retailprice", "regression")


@query("auto_train")
def auto_train(spark, sf):
    return md.auto_train(_parts(spark, sf), "p_partkey", "p_retailprice")


@query("cross_validate")
def cross_validate(spark, sf):
    return md.cross_validate(_docs(spark, sf), "doc_id", "label_quality", "Logistic Regression", "classification", folds=5)


@query("learning_curve")
def learning_curve(spark, sf):
    return md.learning_curve(_parts(spark, sf), "p_partkey", "p_retailprice", "Linear Regression", "regression")


@query("tune_model")
def tune_model(spark, sf):
    return md.tune(_docs(spark, sf), "doc_id", "label_quality", "Decision Tree", "classification")


@query("tune_logistic")
def tune_logistic(spark, sf):
    """The penalty of a logistic model, fifty trials."""
    return md.tune(_docs(spark, sf), "doc_id", "label_quality", "Logistic Regression", "classification")


@query("feature_importance")
def feature_importance(spark, sf):
    return md.feature_importance(_parts(spark, sf), "p_partkey", "p_retailprice", "Decision Tree", "regression")


@query("permutation_importance")
def permutation_importance(spark, sf):
    return md.permutation_importance(_parts(spark, sf), "p_partkey", "p_retailprice", "Decision Tree", "regression")


def _two_features(spark, sf):
    from pyspark.ml.feature import VectorAssembler

    d = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("cust"), F.dayofyear("o_orderdate").cast("double").alias("day"),
                                          F.col("o_totalprice").alias("label"))
    return VectorAssembler(inputCols=["cust", "day"], outputCol="features").transform(d)


@query("explain_linear", """SELECT o_orderkey, round(avg(label) OVER (), 4) AS base_value, feature, round(CASE feature WHEN 'cust' THEN b1 * (cust - m1) ELSE b2 * (day - m2) END, 4) AS attribution
FROM (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS cust, CAST(dayofyear(o_orderdate) AS DOUBLE) AS day, o_totalprice AS label FROM orders),
 (SELECT avg(x) AS m1, avg(z) AS m2, (covar_pop(x, y) * var_pop(z) - covar_pop(z, y) * covar_pop(x, z)) / (var_pop(x) * var_pop(z) - covar_pop(x, z) ** 2) AS b1,
   (covar_pop(z, y) * var_pop(x) - covar_pop(x, y) * covar_pop(x, z)) / (var_pop(x) * var_pop(z) - covar_pop(x, z) ** 2) AS b2
  FROM (SELECT CAST(o_custkey AS DOUBLE) AS x, CAST(dayofyear(o_orderdate) AS DOUBLE) AS z, o_totalprice AS y FROM orders)), (VALUES ('cust'), ('day')) f(feature)""")
def explain_linear(spark, sf):
    """What either feature adds to each prediction of a least-squares model."""
    from pyspark.ml.regression import LinearRegression

    d = _two_features(spark, sf)
    got = ex.attributions(LinearRegression(solver="normal").fit(d), d, "o_orderkey", ["cust", "day"])
    return got.select("o_orderkey", F.round("base_value", 4).alias("base_value"), "feature", F.round("attribution", 4).alias("attribution"))


@query("explain_boosted", "SELECT o_orderkey, CAST(0 AS DOUBLE) AS gap FROM orders")
def explain_boosted(spark, sf):
    """Attributions of boosted trees add up to the prediction in every row."""
    from pyspark.ml.regression import GBTRegressor

    d = _two_features(spark, sf)
    model = GBTRegressor(maxIter=5, maxDepth=4, seed=1).fit(d)
    got = ex.attributions(model, d, "o_orderkey", ["cust", "day"]).groupBy("o_orderkey").agg(F.max("base_value").alias("b"), F.sum("attribution").alias("a"))
    both = got.join(model.transform(d).select("o_orderkey", "prediction"), "o_orderkey")
    return both.select("o_orderkey", F.abs(F.round((F.col("b") + F.col("a") - F.col("prediction")) / F.col("prediction"), 6)).alias("gap"))


@query("explain_rows")
def explain_rows(spark, sf):
    return ex.explain_rows(_parts(spark, sf), "p_partkey", "p_retailprice", "Decision Tree", "regression")


@query("ml_predict")
def ml_predict(spark, sf):
    """Scores rows with a category the model has not seen and without one of its columns."""
    d = _docs(spark, sf)
    model, p, _ = md.train(d, "doc_id", "label_quality", "Logistic Regression", "classification")
    return md.predict(model, p, d.withColumn("lang", F.lit("xx")).drop("digits", "label_quality"))


@query("ml_predict_one")
def ml_predict_one(spark, sf):
    model, p, _ = md.train(_parts(spark, sf), "p_partkey", "p_retailprice", "Linear Regression", "regression")
    return md.predict_one(model, p, spark, {"p_size": 10, "serial": 500})


@query("ml_batch_score", """SELECT p_partkey, p_size, p_brand, p_type, p_retailprice, p_partkey % 1000 AS serial, true AS scored FROM part""")
def ml_batch_score(spark, sf):
    """Read, score, write, read back: every row once, as it was, with a finite prediction."""
    from ..sources.tables import batch_score

    d = _parts(spark, sf)
    model, p, _ = md.train(d, "p_partkey", "p_retailprice", "Linear Regression", "regression")
    path = work_dir(spark, "score")
    d.write.parquet(f"{path}/in")
    out = batch_score(spark, f"{path}/in", md.Scorer(model, p), f"{path}/out")
    return out.withColumn("scored", F.abs("predicted_target") < float("inf")).drop("predicted_target")


# ---------------------------------------------------------------- metrics given predictions

_PRED = """pr AS (SELECT o_orderkey, o_orderstatus AS label, CASE WHEN o_orderkey % 5 = 0 THEN 'O' WHEN o_orderkey % 7 = 0 THEN 'F' ELSE o_orderstatus END AS prediction
 FROM orders)"""


def _preds(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_orderstatus AS label",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'O' WHEN o_orderkey % 7 = 0 THEN 'F' ELSE o_orderstatus END AS prediction")


@query("confusion_matrix", sql("SELECT label, prediction, count(*) AS n FROM pr GROUP BY 1, 2", _PRED))
def confusion_matrix(spark, sf):
    return mt.confusion(_preds(spark, sf))


_CLS = """cls AS (SELECT c.cls, c.tp / nullif(c.said, 0) AS p, c.tp / c.support AS r, c.support FROM (SELECT l.label AS cls, count(*) AS support,
 count(CASE WHEN l.label = l.prediction THEN 1 END) AS tp, (SELECT count(*) FROM pr q WHERE q.prediction = l.label) AS said FROM pr l GROUP BY l.label) c)"""


@query("class_report", sql("SELECT cls, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, support FROM cls", _PRED, _CLS))
def class_report(spark, sf):
    r = mt.class_report(_preds(spark, sf))
    return r.select("cls", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")], "support")


@query("metrics_clf", sql("""SELECT 'accuracy' AS metric, round(avg(CAST(label = prediction AS INT)), 6) AS value FROM pr
 UNION ALL SELECT 'precision', round(sum(p * support) / sum(support), 6) FROM cls UNION ALL SELECT 'recall', round(sum(r * support) / sum(support), 6) FROM cls
 UNION ALL SELECT 'f1', round(sum(2 * p * r / (p + r) * support) / sum(support), 6) FROM cls""", _PRED, _CLS))
def metrics_clf(spark, sf):
    return mt.metrics_table(spark, mt.classification_metrics(_preds(spark, sf))).withColumn("value", F.round("value", 6))


@query("roc_auc", """SELECT 'auc' AS metric, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS value FROM (
 SELECT CAST(o_orderstatus = 'F' AS INT) AS y, rank() OVER (ORDER BY round(o_totalprice, -3)) + (count(*) OVER (PARTITION BY round(o_totalprice, -3)) - 1) / 2.0 AS r FROM orders)""")
def roc_auc(spark, sf):
    d = table(spark, sf, "orders").selectExpr("CAST(o_orderstatus = 'F' AS INT) AS y", "round(o_totalprice, -3) AS s")
    return rows_to_df(spark, [("auc", mt.roc_auc(d, "y", "s"))], "metric string, value double").withColumn("value", F.round("value", 6))


_RP = "rp AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_extendedprice AS label, l_quantity * 2000 AS prediction FROM lineitem)"


def _rpreds(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS k", "l_extendedprice AS label", "l_quantity * 2000 AS prediction")


@query("metrics_reg", sql("""SELECT u.metric, round(u.value, 4) AS value FROM (SELECT count(*) AS n, sum((label - prediction) * (label - prediction)) AS sse,
 var_pop(label) * count(*) AS sst, avg(abs(label - prediction)) AS mae, avg(abs(label - prediction) / abs(label)) AS mape FROM rp) s,
 LATERAL (VALUES ('r2', 1 - sse / sst), ('adjusted_r2', 1 - (sse / sst) * (n - 1) / (n - 3)), ('mae', mae), ('mse', sse / n), ('rmse', sqrt(sse / n)), ('mape', mape)) u(metric, value)""", _RP))
def metrics_reg(spark, sf):
    return mt.metrics_table(spark, mt.regression_metrics(_rpreds(spark, sf), 2)).withColumn("value", F.round("value", 4))


@query("residuals", """SELECT o_orderkey, round(o_totalprice, 4) AS actual, CAST(o_custkey * 100 AS DOUBLE) AS predicted,
 round(o_totalprice - o_custkey * 100, 4) AS residual FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)) LIMIT 200""")
def residuals(spark, sf):
    d = table(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice AS label", "o_custkey * 100D AS prediction")
    return mt.residuals(d, "o_orderkey")


@query("overfit_class", """SELECT l_orderkey, l_linenumber, CASE WHEN te < 0 THEN 'critical' WHEN tr > 0.95 AND te < 0.7 THEN 'overfitting' WHEN tr - te > 0.2 THEN 'possible_overfitting'
 WHEN tr < 0.5 AND te < 0.5 THEN 'underfitting' ELSE 'good_fit' END AS fit FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS tr, l_tax * 12 - 0.1 AS te FROM lineitem)""")
def overfit_class(spark, sf):
    d = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity / 50 AS tr", "l_tax * 12D - 0.1D AS te")
    return mt.fit_classes(d, "tr", "te", "regression").select("l_orderkey", "l_linenumber", "fit")


# ---------------------------------------------------------------- clustering

def _cust(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))


def _cluster(algorithm):
    def run(spark, sf):
        return cl.cluster(_cust(spark, sf), "c_custkey", ["c_acctbal", "nation"], algorithm, 3).select("c_custkey", "cluster")
    return run


query("cluster_kmeans")(_cluster("kmeans"))
query("cluster_gmm")(_cluster("gmm"))
query("cluster_bisecting")(_cluster("bisecting"))


@query("cluster_dbscan", sql("""SELECT p.k AS c_custkey, CAST(coalesce(n.cluster, -1) AS INT) AS cluster FROM p
 LEFT JOIN (SELECT k, min(name) AS name FROM (SELECT k, name FROM comp UNION ALL SELECT e.a, comp.name FROM e JOIN comp ON comp.k = e.b
  WHERE e.a NOT IN (SELECT k FROM core)) GROUP BY k) o ON o.k = p.k LEFT JOIN names n ON n.name = o.name""",
                            """RECURSIVE p AS (SELECT c_custkey AS k, c_acctbal / 100 AS x, CAST(c_nationkey * 4 AS DOUBLE) AS y FROM customer)""",
                            "e AS (SELECT p.k AS a, q.k AS b FROM p, p q WHERE p.y = q.y AND abs(p.x - q.x) <= 1.5)",
                            "core AS (SELECT a AS k FROM e GROUP BY a HAVING count(*) >= 5)",
                            "ce AS (SELECT a, b FROM e WHERE a IN (SELECT k FROM core) AND b IN (SELECT k FROM core))",
                            "reach AS (SELECT k AS root, k FROM core UNION SELECT r.root, ce.b FROM reach r JOIN ce ON ce.a = r.k)",
                            """cell AS (SELECT k, CAST(floor(x / (1.5 / sqrt(2.0))) AS BIGINT) || ',' || CAST(floor(y / (1.5 / sqrt(2.0))) AS BIGINT) AS cell FROM p)""",
                            "comp AS (SELECT r.k, min(c.cell) AS name FROM reach r JOIN cell c ON c.k = r.root GROUP BY r.k)",
                            "names AS (SELECT name, row_number() OVER (ORDER BY min(k)) - 1 AS cluster FROM comp GROUP BY name)"))
def cluster_dbscan(spark, sf):
    d = table(spark, sf, "customer").selectExpr("c_custkey", "c_acctbal / 100 AS a", "c_nationkey * 4D AS b")
    return cl.dbscan(d, "c_custkey", ["a", "b"], 1.5, 5)


_WIDE = ["c_acctbal / 400", "c_nationkey * 2.0", "c_custkey % 3 * 0.4", "c_custkey % 5 * 0.3", "c_nationkey % 4 * 0.5", "length(c_mktsegment) * 0.6", "c_custkey % 2 * 0.2", "c_acctbal / 2000"]


@query("cluster_dbscan_wide", sql("""SELECT p.k AS c_custkey, CAST(coalesce(least(n.cluster, min(m.cluster)), -1) AS INT) AS cluster FROM p
 LEFT JOIN comp ON comp.k = p.k LEFT JOIN names n ON n.name = comp.name
 LEFT JOIN e ON e.a = p.k AND p.k NOT IN (SELECT k FROM core) AND e.b IN (SELECT k FROM core) LEFT JOIN comp o ON o.k = e.b LEFT JOIN names m ON m.name = o.name
GROUP BY p.k, n.cluster""",
                                 "RECURSIVE p AS (SELECT c_custkey AS k, " + ", ".join(f"CAST({x} AS DOUBLE) AS x{i}" for i, x in enumerate(_WIDE)) + " FROM customer)",
                                 "e AS (SELECT p.k AS a, q.k AS b FROM p, p q WHERE " + " + ".join(f"(p.x{i} - q.x{i}) * (p.x{i} - q.x{i})" for i in range(8)) + " <= 2.25 * (1 + 1e-12))",
                                 "core AS (SELECT a AS k FROM e GROUP BY a HAVING count(*) >= 5)",
                                 "ce AS (SELECT a, b FROM e WHERE a IN (SELECT k FROM core) AND b IN (SELECT k FROM core))",
                                 "reach AS (SELECT k AS root, k FROM core UNION SELECT r.root, ce.b FROM reach r JOIN ce ON ce.a = r.k)",
                                 "comp AS (SELECT k, min(root) AS name FROM reach GROUP BY k)",
                                 "names AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS cluster FROM comp GROUP BY name)"))
def cluster_dbscan_wide(spark, sf):
    """Density clusters in eight columns."""
    d = table(spark, sf, "customer").selectExpr("c_custkey", *[f"CAST({x} AS DOUBLE) AS x{i}" for i, x in enumerate(_WIDE)])
    return cl.dbscan(d, "c_custkey", [f"x{i}" for i in range(8)], 1.5, 5)


@query("elbow_curve")
def elbow_curve(spark, sf):
    return cl.elbow_curve(_cust(spark, sf), "c_custkey", ["c_acctbal", "nation"])


@query("cluster_board")
def cluster_board(spark, sf):
    return cl.cluster_board(_cust(spark, sf), "c_custkey", ["c_acctbal", "nation"])


_CL = "g AS (SELECT p_size % 3 AS cluster, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part)"


def _given(spark, sf):
    return table(spark, sf, "part").selectExpr("p_size % 3 AS cluster", "CAST(p_size AS DOUBLE) AS a", "p_retailprice AS b")


@query("cluster_sizes", sql("""SELECT cluster, count(*) AS n, round(avg(a), 3) AS a_mean, round(avg(b), 3) AS b_mean, round(count(*) / (SELECT count(*) FROM g) * 100, 1) AS pct
FROM g GROUP BY cluster""", _CL))
def cluster_sizes(spark, sf):
    return cl.cluster_sizes(_given(spark, sf), ["a", "b"])


@query("cluster_metrics", sql("""SELECT CAST(count(*) AS INT) AS clusters, round((SELECT avg(m) FROM (SELECT max((x.s + y.s) / sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b))) AS m
 FROM z x, z y WHERE x.cluster <> y.cluster GROUP BY x.cluster)), 6) AS davies_bouldin,
 round((sum(n * ((a - ma) * (a - ma) + (b - mb) * (b - mb))) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) AS calinski_harabasz
FROM z, (SELECT avg(a) AS ma, avg(b) AS mb FROM g)""", _CL, "m AS (SELECT cluster, avg(a) AS a, avg(b) AS b, count(*) AS n FROM g GROUP BY 1)",
                              """z AS (SELECT m.cluster, any_value(m.a) AS a, any_value(m.b) AS b, any_value(m.n) AS n,
 avg(sqrt((g.a - m.a) * (g.a - m.a) + (g.b - m.b) * (g.b - m.b))) AS s, sum((g.a - m.a) * (g.a - m.a) + (g.b - m.b) * (g.b - m.b)) AS w
 FROM g JOIN m USING (cluster) GROUP BY m.cluster)"""))
def cluster_metrics(spark, sf):
    m = cl.cluster_metrics(_given(spark, sf), ["a", "b"])
    return m.select("clusters", F.round("davies_bouldin", 6).alias("davies_bouldin"), F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@query("pca_2d")
def pca_2d(spark, sf):
    return cl.pca_2d(_parts(spark, sf), "p_partkey", ["p_size", "p_retailprice", "serial"])


@query("pca_points")
def pca_points(spark, sf):
    return cl.pca_2d(_parts(spark, sf), "p_partkey", ["p_size", "p_retailprice", "serial"], points=100)


@query("anomaly_leaderboard")
def anomaly_leaderboard(spark, sf):
    return cl.anomaly_board(_cust(spark, sf), "c_custkey", ["c_acctbal", "nation"])


@query("append_labels")
def append_labels(spark, sf):
    d = _cust(spark, sf)
    return cl.append_labels(d, cl.cluster(d, "c_custkey", ["c_acctbal", "nation"]), "c_custkey", "cluster", "cluster_label")
