"""Attributions against the sum over all subsets of features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from winnow.ml import explain

NAMES = ["a", "b", "g", "d"]


@pytest.fixture(scope="module")
def data(spark):
    d = spark.range(400).selectExpr("id", "cast(id * 37 % 101 as double) / 10 as a", "cast(id * 13 % 17 as double) as b", "cast(id % 4 as double) as g",
                                    "cast(id * 7 % 29 as double) as d")
    d = d.withColumn("label", F.col("a") * F.col("b") + F.when(F.col("g") == 2, 30).otherwise(0) - F.col("d")).withColumn("cls", (F.col("label") > 20).cast("double"))
    d = VectorAssembler(inputCols=NAMES, outputCol="raw").transform(d)
    return VectorIndexer(inputCol="raw", outputCol="features", maxCategories=4).fit(d).transform(d).select("id", "features", "label", "cls").persist()


def given(leaves, x, known):
    """The mean of the leaves, rows following the splits of the known features only."""
    total = 0.0
    for leaf in leaves:
        w = leaf.value
        for f, share, tests in zip(leaf.features, leaf.shares, leaf.tests, strict=True):
            hold = all(((x[f] <= t) if cats is None else (x[f] in cats)) == left for t, cats, left in tests)
            w *= hold if f in known else share
        total += w
    return total


def by_subsets(leaves, x):
    p = len(x)
    out = []
    for i in range(p):
        rest = [j for j in range(p) if j != i]
        out.append(sum(math.factorial(len(s)) * math.factorial(p - 1 - len(s)) / math.factorial(p) * (given(leaves, x, {*s, i}) - given(leaves, x, set(s)))
                       for k in range(p) for s in itertools.combinations(rest, k)))
    return out


TREES = [(DecisionTreeRegressor, {"maxDepth": 4}), (RandomForestRegressor, {"numTrees": 5, "maxDepth": 4, "seed": 1}),
         (GBTRegressor, {"maxIter": 4, "maxDepth": 3, "seed": 1}), (DecisionTreeClassifier, {"maxDepth": 4, "labelCol": "cls"}),
         (RandomForestClassifier, {"numTrees": 5, "maxDepth": 3, "labelCol": "cls", "seed": 1}),
         (GBTClassifier, {"maxIter": 3, "maxDepth": 3, "labelCol": "cls", "seed": 1})]


@pytest.mark.parametrize(("learner", "options"), TREES, ids=[x.__name__ for x, _ in TREES])
def test_trees(spark, data, learner, options):
    model = learner(**options).fit(data)
    leaves = explain.stored_leaves(spark, model)
    got = explain.attributions(model, data, "id", NAMES)
    by = {}
    for r in got.collect():
        by.setdefault(r["id"], {"base": r["base_value"], "explained": r["explained"]})[r["feature"]] = r["attribution"]
    assert len(by) == 400
    scored = model.transform(data).collect()
    for r in scored[::23]:
        x, mine = r["features"].toArray(), by[r["id"]]
        assert [mine[n] for n in NAMES] == pytest.approx(by_subsets(leaves, x), abs=1e-9)
        assert mine["base"] == pytest.approx(given(leaves, x, set()))
    for r in scored:  # they add up to what the model says
        if "GBTClassification" in type(model).__name__:
            want = r["rawPrediction"][1]
        else:
            want = r["probability"][1] if "Classification" in type(model).__name__ else r["prediction"]
        assert by[r["id"]]["explained"] == pytest.approx(want, abs=1e-8)


def test_a_categorical_split_is_covered(spark, data):
    model = DecisionTreeRegressor(maxDepth=6).fit(data)
    assert any(t[1] is not None for leaf in explain.stored_leaves(spark, model) for tests in leaf.tests for t in tests)


def test_linear(data):
    model = LinearRegression().fit(data)
    x = np.array([r["features"].toArray() for r in data.orderBy("id").collect()])
    want = (x - x.mean(axis=0)) * model.coefficients.toArray()
    rows = explain.attributions(model, data, "id", NAMES).collect()
    got = {(r["id"], r["feature"]): r["attribution"] for r in rows}
    assert all(got[i, n] == pytest.approx(want[i, j]) for i in range(400) for j, n in enumerate(NAMES))
    assert {round(r["explained"], 6) for r in rows if r["id"] == 5} == {round(model.predict(data.where("id = 5").first()["features"]), 6)}
    margin = LogisticRegression(labelCol="cls", maxIter=5).fit(data)
    r = margin.transform(data.where("id = 5")).first()
    assert explain.attributions(margin, data, "id", NAMES).where("id = 5").first()["explained"] == pytest.approx(r["rawPrediction"][1])


def test_nothing_to_explain(data):
    model = DecisionTreeRegressor(maxDepth=2).fit(data)
    assert explain.attributions(model, data.limit(0), "id", NAMES).count() == 0
    holes = data.limit(3).withColumn("features", F.when(F.col("id") > 0, F.col("features")))
    assert explain.attributions(model, holes, "id", NAMES).select("id").distinct().count() == 2
    with pytest.raises(ValueError, match="no closed form"):
        explain.attributions(NaiveBayes(labelCol="cls").fit(data), data, "id", NAMES)
    one = DecisionTreeRegressor(maxDepth=0).fit(data)  # a single leaf: nothing to attribute
    assert {r["attribution"] for r in explain.attributions(one, data, "id", NAMES).collect()} == {0.0}
