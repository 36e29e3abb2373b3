"""The paths for tables of any size give the same results as brute force, hot keys included."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from winnow.functions import keys, stats
from winnow.operators import encode, neighbors, ordered, sample

RNG = np.random.default_rng(7)


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


@pytest.mark.parametrize("values", [
    RNG.uniform(-5, 5, 3000), np.exp(RNG.normal(0, 20, 3000)), RNG.integers(0, 4, 3000).astype(float),
    np.concatenate([RNG.normal(0, 1, 2000), [1e300, -1e300]]), np.full(50, 3.25), np.array([1.0]), np.array([1.0, 2.0]),
    -np.exp(RNG.normal(0, 10, 500)), np.concatenate([np.full(2000, 7.0), RNG.normal(7, 1e-9, 1000)]),
])
def test_refined_quantiles(spark, big, values):
    ps = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]
    df = frame(spark, x=np.concatenate([values, [np.nan]])).repartition(5)
    got = stats.exact_quantiles(df, ["x"], ps)["x"]
    np.testing.assert_allclose(got, np.quantile(values, ps), rtol=1e-12)


def test_refined_quantiles_many_columns_and_empty(spark, big):
    pdf = pd.DataFrame({"a": RNG.normal(size=500), "b": RNG.integers(0, 9, 500).astype(float), "e": [None] * 500})
    df = spark.createDataFrame(pdf.astype({"e": float}))
    got = stats.exact_quantiles(df, ["a", "b", "e"], [0.3, 0.7])
    for n in "ab":
        np.testing.assert_allclose(got[n], pdf[n].quantile([0.3, 0.7]), rtol=1e-12)
    assert got["e"] == [None, None]


def test_grouped_quantiles_with_a_hot_group(spark, big):
    n = 3000
    pdf = pd.DataFrame({"g": np.where(np.arange(n) % 3 == 0, "hot", [f"g{i % 40}" for i in range(n)]),
                        "x": np.exp(RNG.normal(0, 3, n))})
    got = stats.grouped_quantiles(spark.createDataFrame(pdf), ["g"], F.col("x"), [0.25, 0.5]).toPandas().set_index("g")
    want = pdf.groupby("g")["x"].quantile([0.25, 0.5]).unstack()
    assert set(got.index) == set(want.index)
    for g in want.index:
        np.testing.assert_allclose(got.loc[g, "q"], want.loc[g].to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("null_safe", [False, True])
def test_attach_splits_hot_keys(spark, big, null_safe):
    n = 4000
    k = [None if i % 17 == 0 else ("hot" if i % 3 == 0 else f"k{i % 900}") for i in range(n)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(k)], "i long, k string")
    lookup = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("s"))
    if not null_safe:
        lookup = lookup.where("k is not null")
    got = keys.attach(df, lookup, ["k"], "n", null_safe=null_safe).toPandas()
    pdf = pd.DataFrame({"i": range(n), "k": k})
    sums = pdf.groupby("k", dropna=not null_safe)["i"].sum().to_dict()
    if null_safe:
        sums[None] = pdf[pdf.k.isna()]["i"].sum()
    want = pdf["k"].map(lambda v: sums.get(v) if isinstance(v, str) or null_safe else None)
    got = got.sort_values("i").reset_index(drop=True)
    assert len(got) == n
    if null_safe:
        want[pdf.k.isna()] = sums[None]
    pd.testing.assert_series_equal(got["s"].astype(float), want.astype(float), check_names=False)


def test_hot_rows_are_spread_in_the_shuffled_join(spark, big):
    df = spark.range(3000).select("id", F.expr("case when id % 3 = 0 then 'hot' else concat('k', id % 700) end").alias("k"))
    lookup = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = keys.attach(df, lookup, ["k"], "n")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [x for x in plan.splitlines() if "hashpartitioning" in x]
    assert any("_salt" in x for x in joins) and any("_ks" in x for x in joins)


def test_rows_without_an_order_value_stay(spark):
    df = spark.createDataFrame([(i if i % 10 else None, float(i)) for i in range(300)], "k long, x double")
    assert ordered.with_row_index(df, "k", block_rows=40).count() == 300
    assert ordered.fill_forward(df, "x", "k", block_rows=40).count() == 300


def test_sorted_index_over_many_values(spark, big):
    vals = sorted({f"v{i:05d}" for i in RNG.integers(0, 50000, 3000)})
    df = spark.createDataFrame([(v,) for v in vals], "v string").repartition(7)
    got = {r["v"]: r["code"] for r in encode.sorted_index(df, "v").collect()}
    assert got == {v: i for i, v in enumerate(vals)}


@pytest.mark.parametrize("block_rows", [10, 97, 100000])
def test_row_order_does_not_depend_on_blocks(spark, block_rows):
    n = 1000
    x = [None if i % 6 == 0 else float(i // 13 % 5) for i in range(n)]
    pdf = pd.DataFrame({"k": np.sort(RNG.choice(10 ** 6, n, replace=False)) ** 2, "x": x})
    df = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(6)

    def by_k(d, col):
        return d.orderBy("k").toPandas()[col].reset_index(drop=True)

    kw = {"block_rows": block_rows}
    assert list(by_k(ordered.with_row_index(df, "k", **kw), "row_index")) == list(range(n))
    pd.testing.assert_series_equal(by_k(ordered.fill_forward(df, "x", "k", **kw), "x"), pdf["x"].ffill().bfill(), check_names=False)
    want = pdf["x"].rolling(3, min_periods=1, center=True).median()
    pd.testing.assert_series_equal(by_k(ordered.rolling_median(df, "x", "k", **kw), "x"), want, check_names=False)
    s = pdf["x"].dropna().reset_index(drop=True)
    streak = s.groupby((s != s.shift()).cumsum()).transform("count")
    assert list(by_k(ordered.with_streaks(df, "x", "k", **kw), "streak")) == list(streak)
    d = by_k(ordered.diff_previous(df, "x", "k", **kw), "diff")
    pd.testing.assert_series_equal(d, s.diff(), check_names=False)


def test_blocks_cut_twice(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FIRST_BLOCKS", 7)
    df = spark.range(20000).select(F.expr("cast(exp(id / 1000.0) * 1000 as bigint) + id").alias("k"))
    b = ordered.blocked(df, "k", 200)
    sizes = [r["count"] for r in b.groupBy("_block").count().collect()]
    assert len(sizes) > 90 and max(sizes) < 600
    got = [r["row_index"] for r in ordered.with_row_index(df, "k", block_rows=200).orderBy("k").collect()]
    assert got == list(range(20000))


def test_blocks_are_even_on_a_skewed_order_column(spark):
    n = 20000
    df = spark.range(n).select(F.expr("cast(exp(id / 1000.0) * 1000 as bigint) + id").alias("k"))
    sizes = [r["count"] for r in ordered.blocked(df, "k", 500).groupBy("_block").count().collect()]
    assert sum(sizes) == n and max(sizes) < 1500


def test_random_sample_paths_agree(spark, big):
    df = spark.range(5000).withColumnRenamed("id", "k")
    many = {r["k"] for r in sample.random_sample(df, "k", 700).collect()}
    few = {r["k"] for r in df.orderBy(sample.hash_order("k"), "k").limit(700).collect()}
    assert many == few


def test_head_tail_page_paths(spark, big):
    df = spark.range(1000).withColumnRenamed("id", "k").repartition(5)
    assert sorted(r["k"] for r in sample.head(df, "k", 20).collect()) == list(range(20))
    assert sorted(r["k"] for r in sample.tail(df, "k", 20).collect()) == list(range(980, 1000))
    assert sorted(r["k"] for r in sample.page(df, "k", 3, 50).collect()) == list(range(100, 150))
    assert sorted(r["k"] for r in sample.page(df, "k", 999, 300).collect()) == list(range(900, 1000))


def test_stratified_counts_with_a_hot_stratum(spark, big):
    n = 6000
    df = spark.range(n).select(F.col("id").alias("k"), F.expr("case when id % 3 = 0 then 'hot' else concat('s', id % 7) end").alias("s"))
    got = {r["s"]: r["count"] for r in sample.stratified(df, "k", "s", 300).groupBy("s").count().collect()}
    sizes = {r["s"]: r["count"] for r in df.groupBy("s").count().collect()}
    assert got == {s: max(1, round(c * 300 / n)) for s, c in sizes.items()}


def plain_distance(a, b):
    """Plain left-to-right sum (the built-in sum compensates), so that equal distances tie exactly."""
    total = 0.0
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def brute_knn(q, b, k, skip_self):
    out = {}
    for qk, qx in q:
        d = sorted((plain_distance(qx, bx), bk) for bk, bx in b if not (skip_self and bk == qk))
        out[qk] = d[:k]
    return out


@pytest.mark.parametrize("leaf_rows", [40, 10 ** 6])
@pytest.mark.parametrize("dims", [1, 2, 4])
def test_knn_is_exact(spark, monkeypatch, leaf_rows, dims):
    monkeypatch.setattr(neighbors, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(neighbors, "VISITORS", 50)
    n = 400
    pts = np.round(RNG.normal(0, 3, (n, dims)), 1)
    pts[: n // 3] = pts[0]  # a third of the rows share one place
    cols = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "k long, " + ", ".join(f"{x} double" for x in cols))
    want = brute_knn(list(enumerate(pts.tolist())), list(enumerate(pts.tolist())), 5, True)
    got: dict = {}
    for r in neighbors.knn(df, df, "k", "k", cols, 5, exclude_self=True).collect():
        got.setdefault(r["k"], []).append((r["rank"], r["distance"], r["neighbour"]))
    assert set(got) == set(want)
    for k, rows in got.items():
        rows.sort()
        assert [x[2] for x in rows] == [x[1] for x in want[k]]
        np.testing.assert_allclose([x[1] for x in rows], [x[0] for x in want[k]], rtol=1e-12, atol=1e-12)


def test_knn_of_other_rows_far_from_the_base(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 30)
    b = RNG.normal(0, 1, (200, 2))
    q = RNG.normal(5, 4, (60, 2))
    base = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "b long, x double, y double")
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(q)], "q long, x double, y double")
    want = brute_knn(list(enumerate(q.tolist())), list(enumerate(b.tolist())), 3, False)
    got: dict = {}
    for r in neighbors.knn(rows, base, "q", "b", ["x", "y"], 3).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["neighbour"])
    assert got == {k: [x[1] for x in v] for k, v in want.items()}
