"""The parameter search: where it draws, how it halves, and that it repeats itself."""

import math

import pytest

from winnow.ml import models


def test_parzen_finds_a_narrow_optimum():
    """After 60 trials most draws lie near the optimum; even draws would rarely do."""
    search = models.Parzen({"maxIter": ("int", 50, 150), "stepSize": ("log", 0.01, 0.2)}, seed=3)
    for _ in range(60):
        p = search.propose()
        v = search.values(p)
        assert 50 <= v["maxIter"] <= 150 and isinstance(v["maxIter"], int) and 0.01 <= v["stepSize"] <= 0.2
        search.seen.append((p, -(p["maxIter"] - 0.7) ** 2 - (p["stepSize"] - 0.2) ** 2))
    late = [p for p, _ in search.seen[40:]]
    assert sum(abs(p["maxIter"] - 0.7) < 0.2 and abs(p["stepSize"] - 0.2) < 0.2 for p in late) >= 12
    ends = [search.values({"maxIter": x, "stepSize": x}) for x in (0.0, 1.0)]
    assert [e["maxIter"] for e in ends] == [50, 150] and [e["stepSize"] for e in ends] == pytest.approx([0.01, 0.2])


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(300).selectExpr("id as k", "cast(id * 37 % 101 as double) as a", "cast(id * 13 % 17 as double) as b",
                                       "case when id * 37 % 101 + id % 5 * 8 > 60 then 'yes' else 'no' end as v").persist()


def test_halving_and_repetition(rows):
    def run():
        return [tuple(r) for r in models.tune(rows, "k", "v", "Decision Tree", "classification", trials=9, folds=3, parallelism=4).collect()]

    got = run()
    assert [r[0] for r in got] == list(range(10)) and got[0][1] == "{}"
    assert [r[5] for r in got][0] == 3 and sorted(r[5] for r in got[1:5]) == [1, 1, 2, 3] and sorted(r[5] for r in got[5:9]) == [1, 1, 2, 3] and got[9][5] == 3
    best = [r for r in got if r[3]]
    assert len(best) == 1 and best[0][5] == 3 and best[0][2] == max(r[2] for r in got if r[5] == 3)
    assert all(math.isfinite(r[2]) and r[4] >= 0 for r in got)
    assert run() == got


def test_ranges_of_the_learners(spark):
    names = {n: set(models.search_space(models.CLASSIFIERS[n](3, 2))) for n in ("Random Forest", "Gradient Boosting", "Logistic Regression", "Decision Tree")}
    assert names == {"Random Forest": {"numTrees", "maxDepth", "minInstancesPerNode"}, "Gradient Boosting": {"maxIter", "maxDepth", "stepSize"},
                     "Logistic Regression": {"regParam"}, "Decision Tree": {"maxDepth"}}
    with pytest.raises(ValueError, match="nothing to tune"):
        models.tune(spark.range(60).selectExpr("id as k", "id * 2.0 as a", "id * 3.0 as v"), "k", "v", "KNN", "regression", trials=1)


def test_learning_curve_says_why_a_share_has_no_score(rows):
    got = models.learning_curve(rows, "k", "v", "Decision Tree", "classification", shares=(0.01, 1.0), folds=3).collect()
    assert [r["share"] for r in got] == [0.01, 1.0]
    assert got[0]["test_score"] is None and got[0]["note"] and got[1]["test_score"] > 0.5 and got[1]["note"] is None
