"""Training, comparing, tuning and explaining MLlib models."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import c
from ..functions.stats import plan_bytes, rows_to_df
from ..session import TASK_ROWS, cut_lineage, spread
from . import metrics as M
from .cells import LEARNERS, fit_on_cells
from .extra import NearestNeighbours, RidgeClassifier
from .features import Prepared, detect_target, labelled, prepare, split, task_of, test_share

SEED = 42
PARALLEL = 8  # fits under way at a time


def _either(binary, classes: int):
    """Binary learners handle more classes one against the rest."""
    return binary if classes == 2 else C.OneVsRest(classifier=binary, parallelism=4)


# name -> builder(number of features, number of classes)
CLASSIFIERS: dict[str, Callable] = {
    "Logistic Regression": lambda f, k: C.LogisticRegression(maxIter=100),
    "Decision Tree": lambda f, k: C.DecisionTreeClassifier(maxDepth=10, seed=SEED),
    "Random Forest": lambda f, k: C.RandomForestClassifier(numTrees=100, maxDepth=10, seed=SEED),
    "Gradient Boosting": lambda f, k: _either(C.GBTClassifier(maxIter=100, seed=SEED), k),
    "Linear SVC": lambda f, k: _either(C.LinearSVC(maxIter=100), k),
    "Gaussian Naive Bayes": lambda f, k: C.NaiveBayes(modelType="gaussian"),
    "Bernoulli Naive Bayes": lambda f, k: C.NaiveBayes(modelType="bernoulli", featuresCol="signs"),
    "Neural Net": lambda f, k: C.MultilayerPerceptronClassifier(layers=[f, 64, 32, k], maxIter=100, seed=SEED),
    "Ridge Classifier": lambda f, k: RidgeClassifier(k),
    "KNN": lambda f, k: NearestNeighbours(f, True),
}

REGRESSORS: dict[str, Callable] = {
    "Linear Regression": lambda f, k: R.LinearRegression(),
    "Ridge Regression": lambda f, k: R.LinearRegression(regParam=1.0, elasticNetParam=0.0),
    "Lasso Regression": lambda f, k: R.LinearRegression(regParam=1.0, elasticNetParam=1.0),
    "ElasticNet": lambda f, k: R.LinearRegression(regParam=1.0, elasticNetParam=0.5),
    "Huber Regressor": lambda f, k: R.LinearRegression(loss="huber", maxIter=100),
    "Decision Tree": lambda f, k: R.DecisionTreeRegressor(maxDepth=10, seed=SEED),
    "Random Forest": lambda f, k: R.RandomForestRegressor(numTrees=100, maxDepth=10, seed=SEED),
    "Gradient Boosting": lambda f, k: R.GBTRegressor(maxIter=100, seed=SEED),
    "KNN": lambda f, k: NearestNeighbours(f, False),
}


def catalogue(task: str) -> dict[str, Callable]:
    return CLASSIFIERS if task == "classification" else REGRESSORS


def choose(task: str, algorithms: Sequence[str] | None = None) -> list[str]:
    """Names that contain one of the given words; all of them without a filter or a match."""
    names = list(catalogue(task))
    if not algorithms:
        return names
    return [n for n in names if any(a.lower() in n.lower() for a in algorithms)] or names


def with_signs(df: DataFrame) -> DataFrame:
    """0/1 vector of which (centred) features are positive, for the Bernoulli model."""
    return df.withColumn("signs", array_to_vector(F.transform(vector_to_array("features"), lambda v: (v > 0).cast("double"))))


def build(name: str, task: str, p: Prepared):
    return catalogue(task)[name](len(p.features), max(len(p.labels), 2))


def score_of(task: str):
    if task == "classification":
        return MulticlassClassificationEvaluator(metricName="f1")
    return RegressionEvaluator(metricName="r2")


def _feed(p: Prepared, df: DataFrame, key: str) -> DataFrame:
    d = labelled(p, df).select(c(key).alias("key"), "features", "label")
    return with_signs(d) if p.task == "classification" else d


@contextmanager
def held(df: DataFrame, most_bytes: int = 1 << 30):
    """Keep a small input in memory for the passes of the preparation; a large one is read again."""
    size = plan_bytes(df)
    if size is None or size > most_bytes:
        yield df
        return
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def fit_input(df: DataFrame, key: str, target: str, task: str | None = None, frac: float | None = None):
    """(preparation, train, test): prepared once and materialised, so that iterative fits read
    features and not the source.  The split is by key hash, stratified for classes; without ``frac``
    the test share follows from the number of rows."""
    with held(df) as src:
        p = prepare(src, target, task, skip=[key])
        feed = cut_lineage(_feed(p, src, key))
    n = feed.count()
    frac = test_share(n) if frac is None else frac
    _, test = split(feed.select("key", "label"), "key", frac, by="label" if p.task == "classification" else None)
    keys = test.select("key").withColumn("_test", F.lit(True))
    feed = cut_lineage(spread(feed.join(keys, "key", "left"), "key", n))
    return p, feed.where("_test is null").drop("_test"), feed.where("_test").drop("_test")


def whole_input(df: DataFrame, key: str, target: str, task: str | None = None):
    """(preparation, all rows): prepared and materialised without a split."""
    with held(df) as src:
        p = prepare(src, target, task, skip=[key])
        feed = cut_lineage(_feed(p, src, key))
    n = feed.count()
    return p, cut_lineage(spread(feed, "key", n)) if n > TASK_ROWS else feed


def train(df: DataFrame, key: str, target: str, name: str, task: str | None = None, frac: float | None = None):
    """(model, preparation, scored test rows) of one algorithm."""
    p, a, b = fit_input(df, key, target, task, frac)
    model = build(name, p.task, p).fit(a)
    return model, p, cut_lineage(model.transform(b))


def test_metrics(scored: DataFrame, p: Prepared) -> dict:
    if p.task == "regression":
        return M.regression_metrics(scored, len(p.features))
    m = M.classification_metrics(scored)
    m["roc_auc"] = None
    if "probability" in scored.columns:
        prob = vector_to_array("probability")
        sizes = scored.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per class
        aucs = []
        for r in sizes:
            one = scored.select((F.col("label") == r["label"]).cast("int").alias("y"), prob[int(r["label"])].alias("s"))
            aucs.append((M.roc_auc(one, "y", "s"), r["n"]))
        aucs = [(a, n) for a, n in aucs if a is not None]
        if aucs:
            m["roc_auc"] = sum(a * n for a, n in aucs) / sum(n for _, n in aucs)
    return m


def fold_of(key: str, folds: int, seed: int = SEED):
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int")


def at_once(jobs: Sequence[Callable]) -> list:
    """Results of independent fits, several under way at a time: small stages of one fill the gaps of another."""
    with ThreadPool(max(1, min(PARALLEL, len(jobs)))) as pool:
        return pool.map(lambda job: job(), jobs, chunksize=1)


def fold_jobs(make: Callable, data: DataFrame, task: str, folds: int = 5, training: bool = False,
              fitted: Sequence | None = None) -> list[Callable]:
    """A job for every fold that gives its (training, test) score; folds follow from the key's hash.  The training score, most of
    the work of nearest neighbours, is None unless asked for.  ``fitted`` has the models of the folds, where they are known."""
    d = data.withColumn("_fold", fold_of("key", folds))

    def job(i: int):
        def run() -> tuple[float | None, float]:
            a, b, ev = d.where(F.col("_fold") != i).drop("_fold"), d.where(F.col("_fold") == i).drop("_fold"), score_of(task)
            model = make().fit(a) if fitted is None else fitted[i]
            return ev.evaluate(model.transform(a)) if training else None, ev.evaluate(model.transform(b))
        return run

    return [job(i) for i in range(folds)]


def cross_scores(make: Callable, data: DataFrame, task: str, folds: int = 5) -> list[float]:
    """Test score of every fold."""
    return [test for _, test in at_once(fold_jobs(make, data, task, folds))]


def mean_std(xs: Sequence[float]) -> tuple[float, float]:
    m = sum(xs) / len(xs)
    return m, (sum((x - m) ** 2 for x in xs) / len(xs)) ** 0.5


def cross_validate(df: DataFrame, key: str, target: str, name: str, task: str | None = None, folds: int = 5) -> DataFrame:
    """(fold, score) with the mean and spread in every row."""
    p, data = whole_input(df, key, target, task)
    xs = cross_scores(lambda: build(name, p.task, p), data, p.task, folds)
    m, s = mean_std(xs)
    return rows_to_df(df.sparkSession, [(i, x, m, s, s < 0.1) for i, x in enumerate(xs)],
                      "fold int, score double, mean double, std double, stable boolean")


def on_cells(p: Prepared, data: DataFrame, names: Sequence[str], folds: int) -> dict[str, list]:
    """{name: [model of all rows, of all but each fold]} of the regression trees among ``names``, fitted together on cells; empty
    for tables of one task's rows, or with too many cells, whose trees MLlib grows from the rows."""
    names = [n for n in names if n in LEARNERS]
    if p.task != "regression" or not names or data.count() <= TASK_ROWS:
        return {}
    got = fit_on_cells(data, len(p.features), folds, names, fold_of("key", folds) if folds else None, SEED)
    fits = range(folds + 1)
    return {n: [got[(n, i)] for i in fits] for n in names if all((n, i) in got for i in fits)}


LEADER_SCHEMA = ("rank int, model string, score double, cv_mean double, cv_std double, train_score double, "
                 "fit string, level string, metrics string")


def leaderboard(df: DataFrame, key: str, target: str, task: str | None = None, algorithms: Sequence[str] | None = None,
                folds: int = 5) -> DataFrame:
    """Every algorithm with cross-validated, test and training score, best test score first.

    The prepared features are materialised once and shared by all fits."""
    rows, _, _ = ranked(df, key, target, task, algorithms, folds)
    return rows_to_df(df.sparkSession, [(i, *r) for i, r in enumerate(rows, 1)], LEADER_SCHEMA)


def ranked(df: DataFrame, key: str, target: str, task: str | None, algorithms: Sequence[str] | None, folds: int):
    """(rows of the leaderboard without their rank, fitted models by name, preparation)."""
    p, a, b = fit_input(df, key, target, task)
    names = choose(p.task, algorithms)
    folds = folds if folds >= 2 else 0
    ready = on_cells(p, a, names, folds)

    def whole(name: str):
        def run():
            model = ready[name][0] if name in ready else build(name, p.task, p).fit(a)
            return model, test_metrics(cut_lineage(model.transform(b)), p), score_of(p.task).evaluate(model.transform(a))
        return run

    def maker(name: str):
        return lambda: build(name, p.task, p)

    jobs = [j for n in names for j in [whole(n), *(fold_jobs(maker(n), a, p.task, folds, fitted=ready[n][1:] if n in ready else None) if folds else [])]]
    got, rows, models = at_once(jobs), [], {}
    for i, name in enumerate(names):
        (model, m, tr), *scores = got[i * (folds + 1):(i + 1) * (folds + 1)]
        cv, sd = mean_std([test for _, test in scores]) if scores else (None, None)
        test = m["f1"] if p.task == "classification" else m["r2"]
        models[name] = model
        rows.append((name, test, cv, sd, tr, M.fit_class(tr, test, p.task), M.gap_level(tr, test),
                     json.dumps({k: None if v is None else round(v, 4) for k, v in m.items()})))
    rows.sort(key=lambda r: -r[1])
    return rows, models, p


AUTO = {"classification": ["Logistic", "Decision", "Random Forest", "Gradient", "Gaussian", "KNN"],
        "regression": ["Linear", "Ridge", "Decision", "Random Forest", "Gradient", "KNN"]}


def auto_train(df: DataFrame, key: str, target: str | None = None, folds: int = 5, top: int = 10) -> DataFrame:
    """(section, rank, name, score, detail): the target (found if not given), the leaderboard of six models, and the
    ``top`` importances of the best model that has some."""
    if target is None:
        found = detect_target(df.drop(key)).first()
        if found is None:
            raise ValueError("no column looks like a target")
        target, task = found["target"], found["task"]
    else:
        task = None
    p_task = task or task_of(df, target)
    rows, models, p = ranked(df, key, target, p_task, AUTO[p_task], folds)
    out = [("target", 1, target, None, p_task)]
    out += [("model", i, r[0], r[1], r[5]) for i, r in enumerate(rows, 1)]
    for name, *_ in rows:
        try:
            tops = importances(models[name], p.features)[:top]
        except ValueError:
            continue
        out += [("importance", i, n, x, name) for i, (n, x) in enumerate(tops, 1)]
        break
    return rows_to_df(df.sparkSession, out, "section string, rank int, name string, score double, detail string")


def compare_models(df: DataFrame, key: str, target: str, task: str | None = None,
                   algorithms: Sequence[str] | None = None) -> DataFrame:
    """Training against test score per algorithm, with the level of the gap."""
    t = leaderboard(df, key, target, task, algorithms, folds=1)
    return t.select("model", "train_score", F.col("score").alias("test_score"),
                    F.round(F.col("train_score") - F.col("score"), 4).alias("gap"), "level",
                    (F.col("rank") == 1).alias("is_best"))


def learning_curve(df: DataFrame, key: str, target: str, name: str, task: str | None = None,
                   shares: Sequence[float] = (0.1, 0.2, 0.4, 0.6, 0.8, 1.0), folds: int = 5) -> DataFrame:
    """Cross-validated training and test score, with their spread, for growing hash shares of all rows.

    A share with too few rows for the folds or without one of the classes has no scores; ``note`` says why, and how many folds had
    no finite score (one with a single value has no r2) and are not in the means."""
    p, data = whole_input(df, key, target, task)
    u = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1000))
    rows = []
    for s in shares:
        part = data.where(u < int(s * 1000))
        n = part.count()
        if n < 2 * folds:
            rows.append((s, n, *[None] * 4, f"fewer than {2 * folds} rows"))
            continue
        if p.task == "classification" and part.select("label").distinct().count() < len(p.labels):
            rows.append((s, n, *[None] * 4, "a class is missing"))
            continue
        scores = at_once(fold_jobs(lambda: build(name, p.task, p), part, p.task, folds, training=True))
        got = [x for x in scores if all(map(math.isfinite, x))]
        lost = f"{len(scores) - len(got)} of {len(scores)} folds without a score" if len(got) < len(scores) else None
        if not got:
            rows.append((s, n, *[None] * 4, lost))
            continue
        (tr, trs), (te, tes) = mean_std([x for x, _ in got]), mean_std([y for _, y in got])
        rows.append((s, n, tr, trs, te, tes, lost))
    return rows_to_df(df.sparkSession, rows, "share double, rows bigint, train_score double, train_std double, "
                                             "test_score double, test_std double, note string")


def search_space(est) -> dict[str, tuple[str, float, float]]:
    """(scale, lowest, highest) of what is tuned: whole numbers, or numbers on a logarithmic scale."""
    if est.hasParam("numTrees"):
        return {"numTrees": ("int", 50, 200), "maxDepth": ("int", 3, 10), "minInstancesPerNode": ("int", 1, 4)}
    if est.hasParam("stepSize") and est.hasParam("maxDepth"):
        return {"maxIter": ("int", 50, 150), "maxDepth": ("int", 3, 6), "stepSize": ("log", 0.01, 0.2)}
    if est.hasParam("maxDepth"):
        return {"maxDepth": ("int", 3, 15)}
    return {"regParam": ("log", 1e-4, 1.0)}


class Parzen:
    """Tree-structured Parzen estimator: draws where good trials are dense and the others are not.

    Each parameter is a number from 0 to 1 on its scale.  The best quarter of the trials and the rest each give a density, a
    mixture of normals around the trials and the uniform; of ``draws`` draws from the first the one with the largest ratio is tried."""

    def __init__(self, space: dict[str, tuple[str, float, float]], seed: int, start: int = 10, draws: int = 24) -> None:
        import random

        self.space, self.start, self.draws, self.rng = space, start, draws, random.Random(seed)
        self.seen: list[tuple[dict[str, float], float]] = []

    def _density(self, x: float, at: list[float], width: float) -> float:
        near = sum(math.exp(-0.5 * ((x - a) / width) ** 2) / (width * 2.5066282746310002) for a in at)
        return (near + 1.0) / (len(at) + 1)

    def propose(self) -> dict[str, float]:
        if len(self.seen) < self.start:
            return {n: self.rng.random() for n in self.space}
        order = sorted(self.seen, key=lambda t: -t[1])
        cut = max(2, len(order) // 4)
        out = {}
        for n in self.space:
            good, bad = [p[n] for p, _ in order[:cut]], [p[n] for p, _ in order[cut:]]
            wide_good, wide_bad = (max(0.05, 0.5 * len(g) ** -0.5) for g in (good, bad))
            tries = [min(1.0, max(0.0, self.rng.gauss(self.rng.choice(good), wide_good))) if self.rng.random() > 1 / (len(good) + 1) else self.rng.random()
                     for _ in range(self.draws)]
            out[n] = max(tries, key=lambda x: self._density(x, good, wide_good) / self._density(x, bad, wide_bad))
        return out

    def values(self, point: dict[str, float]) -> dict[str, float]:
        got = {}
        for n, (scale, low, high) in self.space.items():
            x = point[n]
            got[n] = min(int(high), int(low + x * (high - low + 1))) if scale == "int" else low * (high / low) ** x
        return got


def tune(df: DataFrame, key: str, target: str, name: str, task: str | None = None, trials: int = 50, folds: int = 3,
         parallelism: int = PARALLEL) -> DataFrame:
    """Search of the parameters of a forest, boosted trees, a tree or a penalised linear model; trial 0 has the defaults.

    Trials are drawn ``parallelism`` at a time, the first ten evenly, then by a Parzen estimator over all before.  Of each lot
    all trials take one fold, the better half a second, and so on (successive halving): ``score`` is the mean over the ``folds`` a
    trial took, and the best trial is the best of those that took all.  The same table, seed and lot size give the same trials."""
    p, data = whole_input(df, key, target, task)
    est = build(name, p.task, p)
    base = est.getClassifier() if isinstance(est, C.OneVsRest) else est
    if not hasattr(base, "hasParam"):
        raise ValueError(f"{name} has nothing to tune")
    search, ev = Parzen(search_space(base), SEED), score_of(p.task)
    data = cut_lineage(data.withColumn("_fold", fold_of("key", folds)))

    def score(point: dict | None, fold: int) -> float:
        grid = {} if point is None else {base.getParam(k): v for k, v in search.values(point).items()}
        model = est.copy(grid).fit(data.where(F.col("_fold") != fold))
        return float(ev.evaluate(model.transform(data.where(F.col("_fold") == fold))))

    done: list[tuple[dict | None, list[float]]] = [(None, at_once([lambda f=f: score(None, f) for f in range(folds)]))]
    while len(done) <= trials:
        lot = [(search.propose(), []) for _ in range(min(parallelism, trials + 1 - len(done)))]
        left = list(range(len(lot)))
        for fold in range(folds):
            for i, x in zip(left, at_once([lambda i=i, f=fold: score(lot[i][0], f) for i in left]), strict=True):
                lot[i][1].append(x)
            left = sorted(sorted(left, key=lambda i: (-mean_std(lot[i][1])[0], i))[:max(1, -(-len(left) // 2))])
        search.seen += [(point, mean_std(xs)[0]) for point, xs in lot]
        done += lot
    means = [mean_std(xs)[0] for _, xs in done]
    best = max((m, -i) for i, (m, (_, xs)) in enumerate(zip(means, done, strict=True)) if len(xs) == folds)
    rows = [(i, "{}" if point is None else str(search.values(point)), m, i == -best[1], round(max(0.0, (m - means[0]) * 100), 2), len(xs))
            for i, (m, (point, xs)) in enumerate(zip(means, done, strict=True))]
    return rows_to_df(df.sparkSession, rows, "trial int, params string, score double, is_best boolean, gain double, folds int")


# ---------------------------------------------------------------- explaining

def importances(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """Tree importances or absolute coefficients, the largest set to 100."""
    if hasattr(model, "featureImportances"):
        v = model.featureImportances.toArray()
    elif getattr(model, "numClasses", 2) > 2 and hasattr(model, "coefficientMatrix"):
        v = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        v = abs(model.coefficients.toArray())
    else:
        raise ValueError(f"{type(model).__name__} has no importances; use permutation importance")
    top = float(max(v)) or 1.0
    return sorted(((n, round(float(x) / top * 100, 2)) for n, x in zip(features, v)), key=lambda t: -t[1])


def feature_importance(df: DataFrame, key: str, target: str, name: str, task: str | None = None) -> DataFrame:
    model, p, _ = train(df, key, target, name, task)
    rows = [(i, n, x) for i, (n, x) in enumerate(importances(model, p.features), 1)]
    return rows_to_df(df.sparkSession, rows, "rank int, feature string, importance double")


def permutation_importance(df: DataFrame, key: str, target: str, name: str, task: str | None = None) -> DataFrame:
    """Loss of score when one feature is exchanged between rows, normalised to sum 1.

    Rows are paired by adjacent hash ranks within hash buckets, so no task orders the table."""
    model, p, scored = train(df, key, target, name, task)
    ev = score_of(p.task)
    rows = scored.select("key", "features", "label")
    n = rows.count()
    buckets = max(1, n // 10_000)
    h = F.xxhash64("key", F.lit(13))
    w = Window.partitionBy("_b").orderBy("_h")
    r = rows.withColumns({"_b": F.pmod(h, F.lit(buckets)), "_h": h, "_x": vector_to_array("features")})
    first = F.first("_x").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    r = r.withColumn("_o", F.coalesce(F.lead("_x").over(w), first)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        base = ev.evaluate(model.transform(_again(rows, p)))
        loss = []
        for i, f in enumerate(p.features):
            mixed = F.transform("_x", _exchange(i))
            d = r.select("label", array_to_vector(mixed).alias("features"))
            loss.append((f, max(0.0, base - ev.evaluate(model.transform(_again(d, p))))))
    finally:
        r.unpersist()
    total = sum(x for _, x in loss) or 1.0
    loss.sort(key=lambda t: -t[1])
    return rows_to_df(df.sparkSession, [(i, f, round(x / total, 4)) for i, (f, x) in enumerate(loss, 1)],
                      "rank int, feature string, importance double")


def _exchange(i: int):
    return lambda v, j: F.when(j == i, F.get("_o", F.lit(i))).otherwise(v)


def _again(df: DataFrame, p: Prepared) -> DataFrame:
    d = df.select("features", "label")
    return with_signs(d) if p.task == "classification" else d


# ---------------------------------------------------------------- predicting

def predict(model, p: Prepared, df: DataFrame) -> DataFrame:
    """Input rows with ``predicted_target`` and, where the model knows it, ``prediction_confidence``.

    Unseen categories take the code kept for them, missing numbers the training median."""
    d = p.transform(df)
    d = model.transform(with_signs(d) if p.task == "classification" else d)
    out = [c(n) for n in df.columns]
    if p.task == "classification":
        names = F.array(*[F.lit(x) for x in p.labels])
        out.append(F.get(names, F.col("prediction").cast("int")).alias("predicted_target"))
        if "probability" in d.columns:
            out.append(F.round(F.array_max(vector_to_array("probability")), 4).alias("prediction_confidence"))
    else:
        out.append(F.col("prediction").alias("predicted_target"))
    return d.select(*out)


@dataclass
class Scorer:
    """A fitted model with its preparation, for ``sources.tables.batch_score``."""

    model: object
    prepared: Prepared

    def transform(self, df: DataFrame) -> DataFrame:
        return predict(self.model, self.prepared, df)


def predict_one(model, p: Prepared, spark, values: dict) -> DataFrame:
    """A single row given as a dict."""
    names = [n for n in p.features if n in values]
    types = ", ".join(f"`{n}` {'double' if n in p.medians else 'string'}" for n in names)
    row = [tuple(float(values[n]) if n in p.medians else str(values[n]) for n in names)]
    return predict(model, p, rows_to_df(spark, row, types))

