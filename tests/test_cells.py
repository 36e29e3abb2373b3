"""Trees fitted on cells against MLlib's and plain sums; neighbour searches that share an index."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import regression as R
from pyspark.sql import functions as F

from winnow.ml import cells, extra, models
from winnow.operators import neighbors


def frame(n=1500, seed=4):
    rng = np.random.default_rng(seed)
    d = pd.DataFrame({"k": np.arange(n), "a": rng.integers(0, 30, n) * 1.0, "b": rng.integers(0, 12, n) * 1.0, "wide": rng.random(n)})
    return d.assign(v=d.a * 3 + d.b % 5 * 7 + rng.normal(size=n))


@pytest.fixture(scope="module")
def fed(spark):
    p, data = models.whole_input(spark.createDataFrame(frame().drop(columns="wide")), "k", "v", "regression")
    return p, data


def said(model, data):
    return model.transform(data).select("key", "prediction").toPandas().sort_values("key")["prediction"].to_numpy()


def test_trees_on_cells_are_those_of_the_rows(fed, monkeypatch):
    monkeypatch.setattr(cells, "TREES", 6)
    p, data = fed
    got = cells.fit_on_cells(data, 2, 0, ["Decision Tree", "Gradient Boosting"])
    for name, theirs in (("Decision Tree", R.DecisionTreeRegressor(maxDepth=10, seed=42)), ("Gradient Boosting", R.GBTRegressor(maxIter=6, seed=42))):
        model = theirs.fit(data)
        assert said(got[(name, 0)], data) == pytest.approx(said(model, data), abs=1e-9)
        assert got[(name, 0)].featureImportances.toArray() == pytest.approx(model.featureImportances.toArray(), abs=1e-3)


def test_a_fold_never_sees_its_own_labels(fed, monkeypatch):
    monkeypatch.setattr(cells, "TREES", 4)
    _, data = fed
    fold = models.fold_of("key", 3)
    other = data.withColumn("label", F.when(fold == 1, F.col("label") + 1000).otherwise(F.col("label")))
    was, now = (cells.fit_on_cells(d, 2, 3, cells.LEARNERS, fold) for d in (data, other))
    for name in cells.LEARNERS:
        assert said(was[(name, 2)], data) == pytest.approx(said(now[(name, 2)], data), abs=1e-9)
        assert abs(said(was[(name, 1)], data) - said(now[(name, 1)], data)).max() > 100
    mine = models.cross_scores(lambda: R.DecisionTreeRegressor(maxDepth=10, seed=42), data, "regression", 3)
    scores = [j()[1] for j in models.fold_jobs(None, data, "regression", 3, fitted=[was[("Decision Tree", i)] for i in (1, 2, 3)])]
    assert scores == pytest.approx(mine, abs=2e-3)


def test_forest_draws_bags_of_rows(fed):
    p, data = fed
    got, again = (cells.fit_on_cells(data, 2, 0, ["Random Forest"])[("Random Forest", 0)] for _ in range(2))
    assert len(got.trees) == cells.TREES and (said(got, data) == said(again, data)).all()
    roots = [t["value"][0] for t in got.trees]
    y = frame()["v"]
    assert np.std(roots) == pytest.approx(y.std() / len(y) ** 0.5, rel=0.35)  # means of Poisson bags, not of the rows
    ours = models.score_of("regression").evaluate(got.transform(data))
    theirs = models.score_of("regression").evaluate(models.build("Random Forest", "regression", p).fit(data).transform(data))
    assert ours == pytest.approx(theirs, abs=0.02)


def test_thresholds_come_from_all_rows(spark):
    d = frame()
    _, data = models.whole_input(spark.createDataFrame(d.drop(columns="a")), "k", "v", "regression")
    few, many = cells.cuts_of(data, 2)
    assert len(few) == 11 and len(many) == 31
    z = (d.wide - d.wide.mean()) / d.wide.std()
    assert many == pytest.approx(np.quantile(z, np.arange(1, 32) / 32), abs=1e-9)


def test_large_tables_are_fitted_on_cells(spark, monkeypatch):
    seen = []
    build = models.build
    monkeypatch.setattr(models, "build", lambda name, *more: seen.append(name) or build(name, *more))
    monkeypatch.setattr(models, "TASK_ROWS", 400)
    monkeypatch.setattr(cells, "TREES", 3)
    df = spark.createDataFrame(frame())
    names = ["Ridge Regression", *cells.LEARNERS]
    got = {r["model"]: r for r in models.leaderboard(df, "k", "v", "regression", names, folds=2).collect()}
    assert set(seen) == {"Ridge Regression"} and set(got) == set(names)
    assert all(r["cv_mean"] > 0.5 and r["train_score"] > 0.5 for r in got.values())
    p, a, _ = models.fit_input(df, "k", "v", "regression")
    monkeypatch.setattr(cells, "TASK_BYTES", 1)  # as if the cells were too many for a task: left to MLlib
    assert models.on_cells(p, a, names, 2) == {}


def test_one_index_for_all_tables_scored(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 60)
    made = []
    index = neighbors.knn_index
    monkeypatch.setattr(extra, "knn_index", lambda *a: made.append(1) or index(*a))
    d = frame(700)
    _, data = models.whole_input(spark.createDataFrame(d), "k", "v", "regression")
    model = extra.NearestNeighbours(3, False).fit(data.where("key >= 200"))
    flat = data.select("key", "label", models.vector_to_array("features").alias("x")).toPandas().sort_values("key")
    x, y = np.array(flat.x.tolist()), flat.label.to_numpy()
    near = np.sqrt(((x[:, None] - x[None, 200:]) ** 2).sum(axis=2)).argsort(axis=1, kind="stable")[:, :5]
    want = y[200:][near].mean(axis=1)
    assert said(model, data.where("key < 200")) == pytest.approx(want[:200], abs=1e-9)
    assert said(model, data.where("key >= 200")) == pytest.approx(want[200:], abs=1e-9)
    assert made == [1]


def test_search_of_many_queries_equals_all_pairs():
    rng = np.random.default_rng(9)
    b = np.unique(rng.integers(0, 9, (900, 3)), axis=0).astype(float) + 1e6
    ids = rng.permutation(len(b) * 2)
    keys = [sorted(ids[2 * i:2 * i + 1 + i % 2].tolist()) for i in range(len(b))]
    q = rng.integers(-1, 11, (500, 3)).astype(float) + 1e6
    ds, ks = neighbors._search(6)(pd.DataFrame({"loc": list(q), "far": np.inf}),
                                  pd.DataFrame({"loc": list(b), "keys": keys, "first": [x[0] for x in keys]}))
    for i in range(len(q)):
        d = np.sqrt(((q[i] - b) ** 2).sum(axis=1))
        order = sorted(range(len(b)), key=lambda j: (d[j], keys[j][0]))[:6]  # the nearest locations, then their keys
        assert list(zip(ds[i], ks[i], strict=True)) == sorted((d[j], k) for j in order for k in keys[j])[:6]


def test_both_zeros_are_one_location(spark):
    base = spark.createDataFrame([(1, 0.0, 1.0), (2, -0.0, 1.0), (3, 5.0, 5.0)], "k int, a double, b double")
    got = neighbors.knn(base, base, "k", "k", ["a", "b"], 1, exclude_self=True).collect()
    assert {r["k"]: (r["neighbour"], r["distance"]) for r in got}[1] == (2, 0.0)
    assert {r["k"]: r["neighbour"] for r in got} == {1: 2, 2: 1, 3: 1}
