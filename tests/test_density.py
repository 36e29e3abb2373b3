"""Density clusters in many columns, and the first row of each key, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.ml import cluster as cl
from winnow.operators import neighbors
from winnow.streaming import monitor

from .test_cluster import brute_dbscan

RNG = np.random.default_rng(12)


@pytest.mark.parametrize(("dims", "leaf", "visitors"), [(5, 4000, 20_000), (8, 40, 15), (12, 25, 20_000)])
def test_many_columns(spark, monkeypatch, dims, leaf, visitors):
    """Clusters across leaves, a location with many rows, border rows, noise."""
    monkeypatch.setattr(neighbors, "LEAF_ROWS", leaf)
    monkeypatch.setattr(neighbors, "VISITORS", visitors)
    wide = 0.25 * (5 / dims) ** 0.5
    line = np.column_stack([np.linspace(8, 16, 70)] + [np.zeros(70)] * (dims - 1))
    pts = np.vstack([RNG.normal(0, wide, (60, dims)), RNG.normal(3, wide, (60, dims)), line, np.full((90, dims), 20.0),
                     RNG.uniform(-30, 60, (30, dims)), np.full((4, dims), 40.0)])
    cols = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)] + [(1000, *[None] * dims)], "k long, " + ", ".join(f"{x} double" for x in cols))
    rows = cl.dbscan(df.repartition(6), "k", cols, 1.0, 5).collect()
    got = {r["k"]: r["cluster"] for r in rows}
    assert len(rows) == len(got) == len(pts)
    core, comp, allowed = brute_dbscan(pts.tolist(), 1.0, 5)
    name = {}
    for i in range(len(pts)):
        if core[i]:
            assert name.setdefault(comp[i], got[i]) == got[i] >= 0
    assert sorted(name.values()) == list(range(len(name)))
    for i in range(len(pts)):
        if not core[i]:
            assert got[i] == min((name[a] for a in allowed[i] if a in name), default=-1)
    firsts = [min(i for i in got if core[i] and got[i] == n) for n in range(len(name))]
    assert firsts == sorted(firsts)


def test_same_as_the_grid(spark):
    pts = np.vstack([RNG.normal(c, 0.3, (80, 3)) for c in (0.0, 2.0, 6.0)] + [RNG.uniform(-5, 9, (40, 3))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "k long, x double, y double, z double")
    a, b = cl.dbscan(df, "k", ["x", "y", "z"], 0.7, 5), cl.leaf_dbscan(df, "k", ["x", "y", "z"], 0.7, 5).withColumnRenamed("cluster", "other")
    core = brute_dbscan(pts.tolist(), 0.7, 5)[0]
    assert all(r["cluster"] == r["other"] for r in a.join(b, "k").collect() if core[r["k"]] or r["cluster"] == -1)


def test_nothing_to_cluster(spark):
    df = spark.createDataFrame([], "k long, " + ", ".join(f"c{i} double" for i in range(6)))
    assert cl.dbscan(df, "k", df.columns[1:], 1.0, 5).count() == 0
    with pytest.raises(ValueError):
        cl.dbscan(df, "k", [], 1.0, 5)


def test_first_row_of_each_key_on_a_batch(spark):
    d = spark.createDataFrame([(1, "2024-01-02", 5, {"a": 1}), (1, "2024-01-01", 9, {"a": 2}), (1, None, 0, {}), (2, None, 3, {}), (2, None, 4, {}), (None, "2024-01-01", 1, {})],
                              "k int, day string, v int, m map<string,int>").withColumn("day", F.to_date("day"))
    got = {r["k"]: r["v"] for r in monitor.stream_dedup(d, ["k"], "day").collect()}
    assert got == {1: 9, 2: 3, None: 1}
    assert monitor.stream_dedup(d.select("k", "day"), ["k", "day"], "day").count() == 5
