"""Reports over shared scans, pairwise moments by matrix products, and repairs that keep keys and types."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.functions import gather, gram, stats
from winnow.operators import anomalies, impute, profile, quality, reshape
from winnow.queries.base import dirty_customer
from winnow.sources import tables

SF = "/root/testdata/sf0.001"
BIG = 2 ** 53 + 1


def jobs_of(spark, name, run):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    out = run()
    n = len(sc.statusTracker().getJobIdsForGroup(name))
    sc.setLocalProperty("spark.jobGroup.id", None)
    return n, out


@pytest.fixture(scope="module")
def mixed(spark):
    return dirty_customer(spark, SF)


# Shared scans

def test_reports_in_few_jobs(spark, mixed, big):
    """On the paths for tables of any size; building the report itself takes no job."""
    assert jobs_of(spark, "issues", lambda: quality.issue_list(mixed))[0] <= 8
    assert jobs_of(spark, "scores", lambda: quality.quality_report(mixed))[0] <= 8
    assert jobs_of(spark, "whole", lambda: profile.full_profile(mixed))[0] <= 10
    assert jobs_of(spark, "described", lambda: profile.describe_numeric(mixed))[0] <= 6


def test_answers_do_not_depend_on_company(spark, mixed):
    asks = [lambda d: stats.stats_row(d, {"n": F.count(F.lit(1)), "m": F.avg("age")}), lambda d: stats.distinct_counts(d, ["segment", "age"]),
            lambda d: stats.exact_quantiles(d, ["balance", "age"], [0.1, 0.5]), lambda d: stats.modes_and_distinct(d, ["age", "segment", "balance"]),
            lambda d: profile.detect_types(d), lambda d: sorted(map(tuple, gather.bounded_rows(d.groupBy("age").count())))]
    alone = [f(mixed) for f in asks]
    assert gather.together(*[lambda f=f: f(mixed) for f in asks]) == alone
    assert gather.shared(mixed, asks) == alone
    nested = gather.together(lambda: gather.together(*[lambda f=f: f(mixed) for f in asks[:3]]), lambda: [f(mixed) for f in asks[3:]])
    assert nested[0] + nested[1] == alone


def test_a_failing_report_fails_the_call(spark, mixed):
    def wrong():
        raise KeyError("own")

    with pytest.raises(KeyError):
        gather.together(lambda: stats.stats_row(mixed, {"n": F.count(F.lit(1))}), wrong)
    with pytest.raises(Exception, match="nowhere"):
        gather.together(lambda: stats.stats_row(mixed, {"n": F.max("nowhere")}), lambda: stats.distinct_counts(mixed, ["age"]))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert stats.stats_row(mixed, {"n": F.count(F.lit(1))})["n"] == mixed.count()


# Pairs of columns

def test_pair_moments_against_expressions(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n, p = 400, 20
    x = rng.normal(1e6, 1.0, (n, p)) + rng.normal(0, 1, (n, 1)) * np.linspace(0, 2, p)
    rows = [[None if rng.random() < 0.2 else float(v) for v in r] for r in x]
    for i, r in enumerate(rows):
        r[3] = 7.0                                   # constant
        r[4] = None                                  # empty
        r[5] = float(i) if i < 5 else None           # few rows
        r[6] = float("nan") if i % 3 == 0 else r[0]  # NaN is missing; else equal to another column
        r[7] = float("inf") if i == 9 else r[7]
    d = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(p))).repartition(7)
    cols = [f"c{i}" for i in range(p) if i not in (4, 5)]
    for complete, names in ((False, d.columns), (True, [n for n in cols if n != "c7"])):
        monkeypatch.setattr(stats, "GRAM_COLUMNS", 1000)
        want = stats.correlations(d, names, complete)
        monkeypatch.setattr(stats, "GRAM_COLUMNS", 1)
        got = stats.correlations(d, names, complete)
        for pair, r in want.items():
            g = got[pair]
            assert (g is None) == (r is None) and (r is None or math.isnan(r) == math.isnan(g) and (math.isnan(r) or g == pytest.approx(r, abs=1e-9))), pair
    xs = [stats.num(d, n) for n in cols[:3]]
    monkeypatch.setattr(stats, "GRAM_COLUMNS", 1000)
    n1, m1, c1 = stats.covariances(d, xs)
    monkeypatch.setattr(stats, "GRAM_COLUMNS", 1)
    n2, m2, c2 = stats.covariances(d, xs)
    assert n1 == n2 and np.allclose(m1, m2) and np.allclose(c1, c2)
    assert stats.correlations(d.limit(0), ["c0", "c1"]) == {("c0", "c1"): None}


def test_three_hundred_columns_in_few_scans(spark):
    p = 300
    d = spark.range(2000).select(*[F.when(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(11)) > 0, F.rand(i) + F.rand(1) * (i % 3)).alias(f"c{i}") for i in range(p)])
    d = d.persist()
    d.count()
    jobs, got = jobs_of(spark, "pairs", lambda: stats.correlations(d, d.columns))
    assert jobs <= 3 and len(got) == p * (p - 1) // 2
    frame = d.toPandas().corr()
    assert all(got[a, b] == pytest.approx(frame.loc[a, b], abs=1e-9) for a, b in list(got)[::997])
    d.unpersist()


def test_similar_columns_by_arrays(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"v{i % 4}", f" V{i % 4}" if i % 5 else "x", None if i % 2 else f"v{i % 4}", float(i)) for i in range(60)],
                              "k int, a string, b string, half string, key double")
    want = sorted(map(tuple, quality.similar_columns(d).collect()))
    monkeypatch.setattr(quality, "GRAM_COLUMNS", 1)
    assert sorted(map(tuple, quality.similar_columns(d).collect())) == want
    assert gram.pair_matches(d.limit(0), [F.col("a"), F.col("b")])[0].sum() == 0


# Keys and types

def test_repairs_keep_keys_and_integers(spark):
    rows = [(BIG + 2 * i, i % 40 if i != 50 else 10 ** 6, -3 if i == 7 else i % 9, 250 if i == 9 else i % 90) for i in range(200)]
    d = spark.createDataFrame([*rows, (BIG + 1, 1, 1, 1), (BIG + 3, 2, 2, 2)], "id bigint, level bigint, age int, tax_rate smallint")
    got = anomalies.fix_all(d, "id")
    assert got.dtypes == d.dtypes
    assert {r["id"] for r in got.collect()} == {r[0] for r in rows} | {BIG + 1, BIG + 3}
    assert got.where("age < 0 or tax_rate > 100 or level = 1000000").count() == 0
    assert not {r["column"] for r in anomalies.detect_all(d, key="id").collect()} & {"id"}


@pytest.mark.parametrize("drop", ["numbers", "text", "dates"])
def test_detectors_without_a_kind_of_column(spark, drop):
    kinds = {"numbers": ["v", "w"], "text": ["t"], "dates": ["day"]}
    d = spark.createDataFrame([(float(i), i % 7, "some text " * 6, None) for i in range(50)], "v double, w int, t string, day date").drop(*kinds[drop])
    assert anomalies.detect_all(d).columns == ["type", "severity", "column", "count", "example"]
    anomalies.detect_all(d).count()
    with_key = d.withColumn("k", F.monotonically_increasing_id())
    assert anomalies.fix_all(with_key, "k").count() == 50
    assert anomalies.detect_all(d.limit(0)).count() == 0


def test_imputation_keeps_keys_and_types(spark):
    rows = [(BIG + 2 * i, None if i % 5 == 0 else 3 * (i % 30), i % 30, None if i % 7 == 0 else float(i % 11)) for i in range(120)]
    d = spark.createDataFrame(rows, "id bigint, a bigint, b int, x double")
    for got in (impute.iterative_impute(d, key="id"), impute.regression_impute(d, "a", ["b"]), impute.knn_impute(d, "a", "id", ["b"], 3)):
        assert got.dtypes == d.dtypes
        by = {r["id"]: r for r in got.collect()}
        assert set(by) == {r[0] for r in rows}
        assert all(by[i]["a"] == a for i, a, *_ in rows if a is not None) and all(by[i]["a"] is not None for i, *_ in rows)
    everything = impute.iterative_impute(d)  # without a key every complete column is a predictor, and stays as it is
    assert {r["id"] for r in everything.collect()} == {r[0] for r in rows}
    assert {r["a"] for r in impute.regression_impute(d, "a", ["b"]).where("b = 10").collect()} == {30}


def test_two_exact_values_have_an_exact_middle(spark):
    d = spark.createDataFrame([(0, BIG), (1, BIG + 2), (2, 5), (3, 6), (4, 9)] + [(i, 5) for i in range(5, 30)], "k int, v bigint")
    got = {r["k"]: r["v"] for r in anomalies.fix_jump(d, "v", "k").collect()}
    assert got[0] == BIG + 1 and got[1] == BIG and got[29] == 5


# Tables put together, inputs

def test_concat_tables(spark):
    a = spark.createDataFrame([(1, 2.0, "x")], "k int, v double, only_a string")
    b = spark.createDataFrame([(10 ** 12, "t", 3)], "k bigint, v string, only_b int")
    got = reshape.concat_tables(a, b, "part")
    assert dict(got.dtypes) == {"k": "bigint", "v": "string", "only_a": "string", "only_b": "int", "part": "int"}
    assert {(r["k"], r["v"], r["only_a"], r["only_b"], r["part"]) for r in got.collect()} == {(1, "2.0", "x", None, 0), (10 ** 12, "t", None, 3, 1)}
    assert reshape.concat_tables(a.limit(0), b).count() == 1


def test_check_inputs_never_raises(spark, tmp_path):
    (tmp_path / "bad.parquet").write_text("no parquet")
    (tmp_path / "head.csv").write_text("a,b\n")
    got = tables.check_inputs(spark, [(f"{tmp_path}/bad.parquet", "parquet"), (f"{tmp_path}/head.csv", "CSV"), ("x", "feather"), (f"{tmp_path}/none", "json")])
    assert [r["status"].split(":")[0] for r in got.collect()] == ["unreadable", "empty", "unsupported", "unreadable"]
