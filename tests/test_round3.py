"""Fits over enough tasks, lean neighbour searches, density links by first touches, rules fitted on all labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from winnow import session
from winnow.ml import cluster, models
from winnow.operators import clean, forest, neighbors


def wide(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 97).cast("double").alias("a"), (F.col("id") * 7 % 1009).cast("double").alias("y")).coalesce(1)


def test_many_rows_of_a_small_file_are_fitted_by_several_tasks(spark):
    p, a, b = models.fit_input(wide(spark, 100_000), "k", "y", "regression")
    assert a.rdd.getNumPartitions() == 3 and a.count() + b.count() == 100_000
    _, rows = models.whole_input(wide(spark, 100_000), "k", "y", "regression")
    assert rows.rdd.getNumPartitions() == 3


def test_few_rows_stay_where_they_are(spark):
    df = wide(spark, 1000)
    assert session.spread(df, "k", 1000) is df


def test_folds_score_their_training_rows_only_when_asked(spark, monkeypatch):
    seen = []

    class Model:
        def transform(self, d):
            seen.append(d.count())
            return d.withColumn("prediction", F.col("label"))

    class Maker:
        def fit(self, d):
            return Model()

    data = spark.range(100).select(F.col("id").alias("key"), F.col("id").cast("double").alias("label"))
    got = [j() for j in models.fold_jobs(Maker, data, "regression", 5)]
    assert sum(seen) == 100 and all(a is None and b == 1.0 for a, b in got)
    assert [j()[0] for j in models.fold_jobs(Maker, data, "regression", 5, training=True)] == [1.0] * 5


def test_search_stops_at_the_distance_found(spark):
    rng = np.random.default_rng(3)
    b = rng.integers(0, 20, (500, 2)).astype(float)
    base = pd.DataFrame({"loc": list(b), "keys": [[i] for i in range(500)], "first": range(500)})
    q = rng.integers(0, 20, (300, 2)).astype(float)
    far = np.where(np.arange(300) % 3 == 0, 1.0, np.inf)
    for most in (far, np.full(300, 1.0)):
        ds, ks = neighbors._search(4)(pd.DataFrame({"loc": list(q), "far": most}), base)
        for i in range(300):
            d = np.sqrt(((q[i] - b) ** 2).sum(axis=1))
            want = sorted((x, k) for k, x in enumerate(d.tolist()) if x <= most[i])[:4]
            assert list(zip(ds[i], ks[i], strict=True)) == want


def test_pairs_of_groups_are_settled_by_first_touches(monkeypatch):
    formed = []
    near = cluster._near
    monkeypatch.setattr(cluster, "_near", lambda q, b, e: formed.append(len(q) * len(b)) or near(q, b, e))
    rng = np.random.default_rng(5)
    qs = pd.DataFrame({"loc": list(rng.random((2000, 5))), "who": np.arange(2000) % 3})
    bs = pd.DataFrame({"loc": list(rng.random((1500, 5)) + np.repeat([[0.0], [9.0]], 750, axis=0)), "local": np.repeat([50, 60], 750)})
    got = cluster._linker(1.0)(qs, bs)
    linked = sum(formed)
    want = cluster._toucher(1.0)(qs, bs)
    assert sorted(map(tuple, got.to_numpy())) == sorted(map(tuple, want.to_numpy())) == [(0, 50), (1, 50), (2, 50)]
    assert linked < sum(formed) - linked


def test_leaves_give_the_clusters_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 40)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.5, (90, 5)) for c in (0, 2, 9)] + [rng.uniform(-5, 15, (60, 5))]).round(2)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcde")).assign(k=range(len(x))))
    got = dict(map(tuple, cluster.dbscan(df, "k", list("abcde"), 1.0, 5).collect()))
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 1.0 * (1 + 1e-12)
    core = near.sum(axis=1) >= 5
    comp = np.where(core, np.arange(len(x)), -1)
    while True:
        new = np.array([min(comp[near[i] & core]) if core[i] else -1 for i in range(len(x))])
        if (new == comp).all():
            break
        comp = new
    names = {c: n for n, c in enumerate(sorted(set(comp[core])))}
    for i in range(len(x)):
        mine = [names[comp[j]] for j in np.nonzero(near[i] & core)[0]]
        assert got[i] == (names[comp[i]] if core[i] else min(mine, default=-1))


def test_texts_reach_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    df = spark.createDataFrame([(1, "Ünï ﬁ"), (2, None)], "k int, t string")
    assert [r["t"] for r in clean.clean_text(df, "t", ["normalize_unicode"]).orderBy("k").collect()] == ["Uni fi", None]
    assert spark.conf.get(key) == "1000"


def test_rows_are_scored_once(spark):
    df = wide(spark, 400)
    got = forest.isolation_forest(df, "k", ["a", "y"])
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 400
