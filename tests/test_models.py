"""Learners of our own, leaderboards and the parts around them, on small tables."""

import math

import pytest

from winnow.ml import cluster, features, models

NAMES = ["KNN", "Ridge Classifier", "Decision"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(240).selectExpr("id AS k", "cast(id % 17 AS double) AS a", "cast(id * 7 % 23 AS double) AS b",
                                       "if(id % 17 > 8, 'high', 'low') AS y", "if(id % 17 < 5, 'x', if(id % 17 < 11, 'y', 'z')) AS y3",
                                       "(id % 17) * 2D + (id * 7 % 23) AS v")


def test_own_classifiers(rows):
    for target, classes in (("y", 2), ("y3", 3)):
        d = rows.select("k", "a", "b", target)
        got = {r["model"]: r for r in models.leaderboard(d, "k", target, "classification", NAMES, folds=3).collect()}
        assert set(got) == {"KNN", "Ridge Classifier", "Decision Tree"}
        assert all(got[n]["score"] > 0.9 and got[n]["cv_mean"] > 0.8 for n in ("KNN", "Decision Tree"))
        assert got["KNN"]["score"] > 0.9 and sorted(r["rank"] for r in got.values()) == [1, 2, 3]


def test_ridge_classifier_is_least_squares(rows):
    import numpy as np

    for target, classes in (("y", [1]), ("y3", [0, 1, 2])):
        p, data = models.whole_input(rows.select("k", "a", "b", target), "k", target, "classification")
        got = {r["key"]: r["prediction"] for r in models.build("Ridge Classifier", "classification", p).fit(data).transform(data).collect()}
        flat = data.select("key", "label", models.vector_to_array("features").alias("f")).toPandas()
        x = np.array(flat.f.tolist())
        x1, values = x - x.mean(axis=0), []
        for i in classes:
            y = np.where(flat.label == i, 1.0, -1.0)
            w = np.linalg.solve(x1.T @ x1 + np.eye(x.shape[1]), x1.T @ (y - y.mean()))
            values.append(x1 @ w + y.mean())
        want = np.argmax(values, axis=0) if len(classes) > 1 else (values[0] > 0).astype(int)
        assert [got[k] for k in flat.key] == want.tolist()


def test_learning_curve_has_spread(rows):
    got = models.learning_curve(rows.select("k", "a", "b", "v"), "k", "v", "Linear Regression", "regression", folds=3).collect()
    assert [r["share"] for r in got][-1] == 1.0 and got[-1]["rows"] == 240
    assert all(math.isfinite(r["test_score"]) and r["test_std"] >= 0 for r in got) and got[-1]["test_score"] > 0.999


def test_small_tables_hold_out_more():
    assert [features.test_share(n) for n in (5, 20, 100)] == [0.2, 0.25, 0.2]


def test_density_clusters_on_the_board(spark, big):
    d = spark.range(90).selectExpr("id AS k", "(id % 3) * 50D + id % 7 AS a", "(id % 3) * 40D + id % 5 AS b")
    got = {r["model"]: r for r in cluster.cluster_board(d, "k", ["a", "b"]).collect()}
    assert set(got) == {"kmeans", "gmm", "bisecting", "dbscan"} and got["dbscan"]["clusters"] == 3
    assert got["kmeans"]["davies_bouldin"] == pytest.approx(got["dbscan"]["davies_bouldin"])


def test_importances_of_auto_train(rows, monkeypatch):
    monkeypatch.setitem(models.AUTO, "regression", ["Linear", "Decision"])
    got = models.auto_train(rows.select("k", "a", "b", "v"), "k", "v", folds=2).collect()
    assert got[0]["section"] == "target" and got[0]["name"] == "v"
    assert {r["name"] for r in got if r["section"] == "importance"} == {"a", "b"}
    assert [r["rank"] for r in got if r["section"] == "model"] == [1, 2]
