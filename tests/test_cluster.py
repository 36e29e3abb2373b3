"""Density clustering, components, imputation, forests and fuzzy matching against brute force."""

import math

import numpy as np
import pandas as pd
import pytest

from winnow.ml import cluster as cl
from winnow.operators import forest, fuzzy, impute

RNG = np.random.default_rng(11)


def brute_dbscan(pts, eps, least):
    n = len(pts)
    near = [[j for j in range(n) if math.dist(pts[i], pts[j]) <= eps] for i in range(n)]
    core = [len(x) >= least for x in near]
    comp = [-1] * n
    c = 0
    for i in range(n):
        if not core[i] or comp[i] >= 0:
            continue
        todo = [i]
        comp[i] = c
        while todo:
            a = todo.pop()
            for b in near[a]:
                if core[b] and comp[b] < 0:
                    comp[b] = c
                    todo.append(b)
        c += 1
    allowed = [{comp[i]} if core[i] else ({comp[j] for j in near[i] if core[j]} or {-1}) for i in range(n)]
    return core, comp, allowed


@pytest.mark.parametrize("dims,eps", [(1, 0.3), (2, 0.5), (3, 0.9)])
def test_dbscan(spark, dims, eps):
    blobs = [RNG.normal(c, 0.25, (60, dims)) for c in (0.0, 1.6, 5.0)]
    line = np.column_stack([np.linspace(8, 12, 60)] + [np.zeros(60)] * (dims - 1))
    hot = np.full((120, dims), 20.0) + RNG.normal(0, 0.01, (120, dims))
    pts = np.vstack([*blobs, line, hot, RNG.uniform(-30, 60, (30, dims))])
    cols = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "k long, " + ", ".join(f"{x} double" for x in cols))
    got = {r["k"]: r["cluster"] for r in cl.dbscan(df, "k", cols, eps, 5).collect()}
    core, comp, allowed = brute_dbscan(pts.tolist(), eps, 5)
    assert len(got) == len(pts)
    name = {}
    for i in range(len(pts)):
        if core[i]:
            assert name.setdefault(comp[i], got[i]) == got[i] >= 0
    assert len(set(name.values())) == len(name)
    for i in range(len(pts)):
        assert got[i] in {name.get(a, -1) for a in allowed[i]}


def test_two_dense_cells_that_just_touch(spark):
    a = [(0.0 + i * 1e-4, 0.0) for i in range(40)]
    for gap, want in ((0.9999, 1), (1.0101, 2)):
        b = [(a[-1][0] + gap + i * 1e-4, 0.0) for i in range(40)]
        df = spark.createDataFrame([(i, *p) for i, p in enumerate(a + b)], "k long, x double, y double")
        assert cl.dbscan(df, "k", ["x", "y"], 1.0, 5).select("cluster").distinct().count() == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 140)] + [(200, 200), (301, 300), (300, 302)]
    got = {r["node"]: r["component"] for r in cl.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1}
    assert {got[i] for i in range(100, 140)} == {100}
    assert got[200] == 200 and {got[i] for i in (300, 301, 302)} == {300}


def nan_distance(a, b):
    both = [(x, y) for x, y in zip(a, b) if not (np.isnan(x) or np.isnan(y))]
    if not both:
        return np.inf
    return math.sqrt(len(a) / len(both) * sum((x - y) ** 2 for x, y in both))


def test_knn_impute_with_gaps_in_the_predictors(spark):
    n = 120
    x = np.column_stack([RNG.normal(0, 2, n), RNG.normal(0, 2, n), RNG.normal(0, 2, n)])
    x[RNG.random(n) < 0.2, 0] = np.nan
    x[RNG.random(n) < 0.15, 1] = np.nan
    x[RNG.random(n) < 0.25, 2] = np.nan
    pdf = pd.DataFrame(x, columns=["a", "b", "y"])
    pdf.insert(0, "k", range(n))
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    got = impute.knn_impute(df, "y", "k", ["a", "b"]).orderBy("k").toPandas()["y"]
    mean = np.nanmean(x[:, 2])
    for i in range(n):
        if not np.isnan(x[i, 2]):
            assert got[i] == x[i, 2]
            continue
        d = sorted((nan_distance([*x[i, :2], np.nan], [*x[j, :2], x[j, 2]]), j) for j in range(n) if not np.isnan(x[j, 2]))
        best = [j for dist, j in d[:5] if np.isfinite(dist)]
        assert got[i] == pytest.approx(np.mean(x[best, 2]) if best else mean)


def test_iterative_impute_recovers_a_linear_relation(spark):
    n = 300
    a, b = RNG.normal(0, 1, n), RNG.normal(0, 1, n)
    y = 3 * a - 2 * b + 1
    pdf = pd.DataFrame({"k": range(n), "a": a, "b": b, "y": y})
    pdf.loc[pdf.k % 7 == 0, "y"] = None
    pdf.loc[pdf.k % 11 == 3, "a"] = None
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    got = impute.iterative_impute(df, ["a", "b", "y"], rounds=10, tol=1e-9).orderBy("k").toPandas()
    assert not got.isna().any().any()
    only_y = [i for i in range(n) if i % 7 == 0 and i % 11 != 3]
    np.testing.assert_allclose(got["y"][only_y], y[only_y], atol=0.05)


def test_forest_finds_planted_rows_whatever_the_partitioning(spark):
    pts = RNG.normal(0, 1, (500, 2))
    pts[:5] = 12.0 + RNG.normal(0, 0.1, (5, 2))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "k long, x double, y double")
    a = forest.isolation_forest(df.repartition(1), "k", ["x", "y"], 0.01)
    b = forest.isolation_forest(df.repartition(9), "k", ["x", "y"], 0.01)
    sa = {r["k"]: r["score"] for r in a.collect()}
    sb = {r["k"]: r["score"] for r in b.collect()}
    assert sa == sb
    assert {k for k, _ in sorted(sa.items(), key=lambda t: -t[1])[:5]} == set(range(5))


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def test_fuzzy_matches_all_pairs(spark):
    base = ["".join(RNG.choice(list("abcde "), RNG.integers(4, 30))).strip() for _ in range(40)]
    words = set(base)
    for w in base:
        for _ in range(3):
            s = list(w)
            for _ in range(RNG.integers(1, 5)):
                at = RNG.integers(0, len(s) + 1)
                op = RNG.integers(0, 3)
                if op == 0:
                    s.insert(at, "x")
                elif s and at < len(s):
                    if op == 1:
                        s[at] = "y"
                    else:
                        s.pop(at)
            words.add("".join(s).strip())
    words = sorted(w for w in words if w)
    want = {}
    for a in words:
        n = sum(1 for b in words if a != b and 1 - edit(a, b) / max(len(a), len(b)) >= 0.82 - 1e-9)
        if n:
            want[a] = n
    df = spark.createDataFrame([(w,) for w in words], "v string")
    got = {r["value"]: r["partners"] for r in fuzzy.fuzzy_categories(df, "v").collect()}
    assert got == want
