"""Faults that small tables showed: lost values, corrupted ids, crashes on odd columns."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from winnow.functions import keys, stats
from winnow.functions.stats import modes_and_distinct
from winnow.ml import features
from winnow.operators import clean, fuzzy, neighbors, reshape, rules, scale
from winnow.plans.steps import run_preset

BIG = 9007199254740993


def test_null_keys_keep_their_values(spark):
    d = spark.createDataFrame([("a", None, 1.5), ("a", None, 2.5), ("b", None, 1.0), ("b", 2, 3.0)], "g string, k int, v double")
    got = {r["g"]: (r["k"], r["v"]) for r in clean.remove_duplicates(d, ["g"], "k").collect()}
    assert got["b"] == (2, 3.0) and got["a"][1] in (1.5, 2.5)
    flags = sorted((r["g"], r["k"] or 0, r["is_duplicate"]) for r in clean.duplicate_flag(d, ["g"], "k").collect())
    assert flags == [("a", 0, False), ("a", 0, False), ("b", 0, True), ("b", 2, False)]


def test_large_integers_survive(spark):
    d = spark.createDataFrame([(BIG + i, None if i == 3 else i, Decimal("1.25") if i else None) for i in range(20)], "order_id bigint, n int, d decimal(20,2)")
    for out in (clean.fill_all_missing(d), run_preset(d, "Sales Data"), clean.fix_outliers(d, "order_id"), clean.winsorize(d, "n", 0.1, 0.1)):
        assert sorted(r["order_id"] for r in out.collect()) == [BIG + i for i in range(20)]
        assert dict(out.dtypes) == dict(d.dtypes)
    assert clean.fill_missing(d, "n", "median").where("n is null").count() == 0


def test_caps_are_rounded_inward(spark):
    d = spark.createDataFrame([(x,) for x in [1, 2, 3, 4, 5, 1000, -1000]], "n int")
    f = clean.fences(d, ["n"])["n"]
    got = [r["n"] for r in clean.fix_outliers(d, "n", fence=f).collect()]
    assert all(f.lower <= x <= f.upper for x in got) and got[:5] == [1, 2, 3, 4, 5]


def test_bad_targets_are_dropped(spark):
    d = spark.createDataFrame([(float(i), float(i % 7), float("nan") if i == 4 else 2.0 * i) for i in range(40)], "a double, b double, y double")
    p = features.prepare(d, "y", "regression")
    assert features.labelled(p, d).where("label is null or isnan(label)").count() == 0
    t = d.selectExpr("a", "b", "CASE WHEN a = 5 THEN 'bad' ELSE cast(b AS string) END AS y")
    assert features.labelled(features.prepare(t, "y", "regression"), t).count() == 39


def test_empty_numeric_column(spark):
    d = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    for how in ("minmax", "standard", "robust"):
        out = scale.scale(d, scale.fit_scaler(d, ["a", "b"], how))
        assert {r["b"] for r in out.collect()} == {None}


def test_nan_is_missing_in_float_columns(spark):
    d = spark.sql("SELECT cast(x AS float) AS x FROM VALUES (1.0), (2.0), (2.0), (double('NaN')), (double('NaN')), (double('NaN')) AS t(x)")
    assert modes_and_distinct(d, ["x"])["x"] == (2.0, 2)


def test_histogram_with_infinities(spark):
    d = spark.createDataFrame([(float(i),) for i in range(10)] + [(float("inf"),), (float("-inf"),)], "x double")
    h = reshape.histogram(d, "x", 5).collect()
    assert sum(r["n"] for r in h) == 10 and all(abs(r["bin_start"]) < 100 for r in h)
    assert tuple(reshape.infinite_values(d, "x").first()) == (1, 1)


def test_quarantine_unique(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    good, bad = rules.quarantine(d, [{"column": "k", "rule_type": "unique", "name": "once"}])
    assert [r["v"] for r in good.collect()] == ["c"] and good.columns == d.columns
    assert {(r["v"], tuple(r["failed_rules"])) for r in bad.collect()} == {("a", ("once",)), ("b", ("once",))}


def test_polynomials_of_all_columns(spark):
    d = spark.createDataFrame([tuple(float(i * j % 7) for j in range(1, 13)) for i in range(20)], ", ".join(f"c{j} double" for j in range(12)))
    assert len(features.poly_features(d, d.columns, 1).first()["poly"]) == 12


def test_quantiles_with_infinities_alike_at_every_size(spark):
    inf, ps = float("inf"), [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    rows = [(inf if i % 10 < 6 else float(i), -inf if i % 4 == 0 else i / 7, None if i % 3 else float("nan")) for i in range(200)]
    d = spark.createDataFrame(rows, "a double, b double, c double").selectExpr("a", "b", "c", "if(a < 100, 5D, NULL) AS d", "double('-Infinity') AS e")
    got = {}
    for limit in ("-1", str(1 << 40)):
        spark.conf.set(stats.SMALL_BYTES_CONF, limit)
        got[limit] = stats.exact_quantiles(d, d.columns, ps)
    spark.conf.unset(stats.SMALL_BYTES_CONF)
    small, refined = got[str(1 << 40)], got["-1"]
    assert small["a"] == refined["a"] and small["c"] == refined["c"] and small["d"] == refined["d"] and small["e"] == refined["e"]
    assert small["b"] == pytest.approx(refined["b"], rel=1e-12) and refined["b"][0] == -inf and refined["a"][-1] == inf


def test_neighbours_with_text_keys(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 20)
    d = spark.range(600).selectExpr("lpad(cast(id AS string), 5, '0') AS k", "cast(id AS int) AS n", "cast(id * 37 % 101 AS double) AS a",
                                    "if(id < 500, 0D, cast(id * 53 % 89 AS double)) AS b")
    by_text = neighbors.knn(d, d, "k", "k", ["a", "b"], 4, exclude_self=True).selectExpr("int(k)", "int(neighbour)", "distance", "rank")
    by_number = neighbors.knn(d, d, "n", "n", ["a", "b"], 4, exclude_self=True)
    assert sorted(by_text.collect()) == sorted(tuple(r) for r in by_number.collect())
    p = d.toPandas()
    for r in by_number.where("rank = 4 AND n % 50 = 0").collect():
        far = sorted(((x - p.a[r["n"]]) ** 2 + (y - p.b[r["n"]]) ** 2) ** 0.5 for i, x, y in zip(p.n, p.a, p.b) if i != r["n"])
        assert far[3] == pytest.approx(r["distance"])
    assert neighbors.local_outlier_factor(d, "k", ["a", "b"], 5).count() == 600
    rare = d.withColumn("y", (d["n"] % 20 == 0).cast("int"))
    assert neighbors.smote(rare, "k", "y", ["a", "b"]).where("synthetic").count() == 540


def test_neighbours_fewer_at_home_than_wanted(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 2)
    d = spark.range(40).selectExpr("id AS k", "cast(id * id AS double) AS a")
    got = neighbors.knn(d, d, "k", "k", ["a"], 7)
    for r in got.groupBy("k").agg(F.max("distance").alias("far"), F.count("*").alias("n")).collect():
        assert (r["n"], r["far"]) == (7, sorted(abs(i * i - r["k"] ** 2) for i in range(40))[6])


def test_similar_spellings_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    names = {"Customer#%06d" % rng.randrange(4000) for _ in range(120)} | {"".join(rng.choice("ab") for _ in range(rng.randint(4, 12))) for _ in range(120)}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    low = sorted({n.lower() for n in names})
    want = {a: sum(a != b and 1 - edits(a, b) / max(len(a), len(b)) >= 0.82 - 1e-9 for b in low) for a in low}
    got = {r["value"].lower(): r["partners"] for r in fuzzy.fuzzy_categories(spark.createDataFrame([(n,) for n in names], "x string"), "x").collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_wide_look_ups_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(keys, "BROADCAST_BYTES", 1000)
    spark.conf.set("spark.winnow.plainJoinBytes", "-1")
    d = spark.range(300).selectExpr("concat(repeat('x', 50), id % 30) AS t")
    got = keys.attach(d, d.groupBy("t").agg(F.count("*").alias("n"), F.lit(1).alias("one")), ["t"], "n")
    assert got.where("one = 1").count() == 300
    spark.conf.unset("spark.winnow.plainJoinBytes")


def test_rows_behind_every_finding(spark, big):
    """Copies, repeated ids (null ones are none), date gaps, and jumps, on the paths for tables of any size."""
    from winnow.operators import anomalies as an

    note = "the same words pasted over and over again, more than forty characters"
    rows = [(i, "u1" if i in (3, 7) else None if i in (4, 5) else f"u{i + 100}", note if i % 4 == 0 else f"n{i}",
             500.0 if i == 30 else float(i % 3) + 1, f"{2000 if i < 20 else 2010}-01-{i % 19 + 1:02d}") for i in range(40)]
    d = spark.createDataFrame(rows, "k int, user_id string, note string, v double, day string") \
        .selectExpr("k", "user_id", "note", "v", "CAST(day AS date) AS day")
    got = {}
    for r in an.all_flags(d, "k", order="k").collect():
        got.setdefault(r["type"], set()).add(r["k"])
    assert got["business_duplicate_identifier"] == {3, 7}
    assert got["text_copy_paste_anomaly"] == set(range(0, 40, 4))
    assert got["pattern_sudden_jump"] == {30, 31}
    first = min(r[4] for r in rows if r[4] > "2009")
    assert got["date_gap_jump"] == {r[0] for r in rows if r[4] == first}
    assert got["statistical_zscore"] == {30}
    empty = an.all_flags(d.where("k < 0"), "k", order="k")
    assert empty.count() == 0
