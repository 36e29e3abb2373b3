"""What each feature adds to a single prediction.

Attributions are Shapley values: they add up to the prediction minus the mean.  For linear models they are coefficient times distance
from the mean.  For trees a feature that is left out is averaged over the training rows that reached either side of its splits, and
the sum over all subsets of features is that over the leaves: of a leaf only the features on its path matter, and the
subsets of one size are the coefficients of a product of one binomial per feature."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import c
from ..functions.stats import stats_row
from ..session import shared_dir


@dataclass(frozen=True)
class Leaf:
    """A leaf's weighted value and, for each feature on its path, the share of training rows that its splits let through and the
    splits themselves: (threshold, None, left) or (None, categories, left)."""
    value: float
    features: tuple[int, ...]
    shares: tuple[float, ...]
    tests: tuple[tuple[tuple, ...], ...]


def _leaves(nodes: dict[int, tuple], value, weight: float) -> list[Leaf]:
    out = []
    todo: list[tuple[int, dict]] = [(0, {})]
    while todo:
        at, path = todo.pop()
        node = nodes[at]
        if node["leftChild"] < 0:
            out.append(Leaf(weight * value(node), tuple(path), tuple(s for s, _ in path.values()), tuple(t for _, t in path.values())))
            continue
        f, split = node["split"]["featureIndex"], node["split"]
        values = tuple(split["leftCategoriesOrThreshold"])
        for side, child in ((True, node["leftChild"]), (False, node["rightChild"])):
            share, tests = path.get(f, (1.0, ()))
            test = (values[0], None, side) if split["numCategories"] < 0 else (None, values, side)
            todo.append((child, {**path, f: (share * nodes[child]["rawCount"] / max(node["rawCount"], 1), (*tests, test))}))
    return out


def stored_leaves(spark, model, of_class: int = 1) -> list[Leaf]:
    """The leaves of a fitted tree, forest or boosted model, read from the files that the model writes (as large as the model).

    Regression and boosted models are explained in their output or margin, trees and forests for classes in the probability of
    ``of_class``."""
    path = f"{shared_dir(spark)}/winnow-model-{uuid.uuid4().hex[:8]}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    boosted, forest = "GBT" in type(model).__name__, "treeID" in data.columns
    rows = data.select("treeID", "nodeData.*").collect() if forest else data.select(F.lit(0).alias("treeID"), "*").collect()
    trees: dict[int, dict[int, tuple]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    weights = [float(w) for w in model.treeWeights] if boosted else [1 / len(trees)] * len(trees)
    classes = "Classification" in type(model).__name__ and not boosted

    def value(node) -> float:
        if not classes:
            return node["prediction"]
        stats = node["impurityStats"]
        return stats[of_class] / (sum(stats) or 1.0)

    return [leaf for t in sorted(trees) for leaf in _leaves(trees[t], value, weights[t])]


def base_value(leaves: Sequence[Leaf]) -> float:
    """The mean over the training rows."""
    return math.fsum(x.value * math.prod(x.shares) for x in leaves)


def tree_attributions(leaves: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """Attribution of each feature (column) for each row of ``x``."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        d = len(leaf.features)
        if not d:
            continue
        on = np.ones((len(x), d), dtype=bool)
        for j, (f, tests) in enumerate(zip(leaf.features, leaf.tests, strict=True)):
            for threshold, categories, left in tests:
                goes = x[:, f] <= threshold if categories is None else np.isin(x[:, f], categories)
                on[:, j] &= goes if left else ~goes
        seen, back = np.unique(on, axis=0, return_inverse=True)  # rows that pass the same splits get the same
        o, z = seen.astype(float), np.array(leaf.shares)
        weight = [math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)]
        got = np.zeros(o.shape)
        for j in range(d):
            sizes = np.zeros((len(o), d))  # by how many of the other features are given
            sizes[:, 0] = 1.0
            for k, i in enumerate(i for i in range(d) if i != j):
                sizes[:, 1:k + 2] = sizes[:, 1:k + 2] * z[i] + sizes[:, :k + 1] * o[:, i:i + 1]
                sizes[:, 0] *= z[i]
            got[:, j] = leaf.value * (o[:, j] - z[j]) * (sizes @ weight)
        out[:, list(leaf.features)] += got[back.reshape(-1)]
    return out


def attributions(model, df: DataFrame, key: str, features: Sequence[str], of_class: int = 1, background: DataFrame | None = None) -> DataFrame:
    """(key, base_value, explained, feature, attribution): one row a feature of every row of ``df``, which has a ``features`` vector.

    ``explained`` is what is explained, the base value plus the row's attributions: the prediction, for logistic and boosted classifiers
    the margin, for other trees for classes the probability of ``of_class``.  ``background`` gives linear models their means (default:
    ``df``).  Rows whose vector is null or holds a missing number are left out."""
    spark, p = df.sparkSession, len(features)
    cells = F.when(F.col("features").isNotNull(), vector_to_array("features"))
    rows = df.select(c(key), cells.alias("x")).where("x is not null").where(~F.exists("x", lambda v: F.isnan(v)))
    if hasattr(model, "coefficients"):
        means = stats_row((background or df).select(cells.alias("x")), {i: F.avg(F.get("x", F.lit(i))) for i in range(p)})
        mean = [means[i] or 0.0 for i in range(p)]
        beta = [float(b) for b in model.coefficients.toArray()]
        base = float(model.intercept) + math.fsum(b * m for b, m in zip(beta, mean, strict=True))
        given = F.array(*[F.lit(b) * (F.get("x", F.lit(i)) - F.lit(m)) for i, (b, m) in enumerate(zip(beta, mean, strict=True))])
    elif hasattr(model, "trees") or hasattr(model, "depth"):
        leaves = stored_leaves(spark, model, of_class)
        base = base_value(leaves)

        @F.pandas_udf("array<double>")
        def shares(x: pd.Series) -> pd.Series:
            return pd.Series(list(tree_attributions(leaves, np.vstack(x.to_numpy())))) if len(x) else pd.Series([], dtype="object")

        given = shares("x")
    else:
        raise ValueError(f"{type(model).__name__} has no closed form; use permutation importance")
    got = rows.select(c(key), F.lit(base).alias("base_value"), given.alias("given"))
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in features]).alias("feature"), F.col("given").alias("attribution"))
    return got.select(c(key), "base_value", (F.col("base_value") + F.aggregate("given", F.lit(0.0), lambda a, b: a + b)).alias("explained"),
                      F.inline(pairs))


def explain_rows(df: DataFrame, key: str, target: str, name: str, task: str | None = None) -> DataFrame:
    """Attributions of the test rows by one algorithm of the catalogue, with the model's own prediction beside."""
    from .models import train

    model, p, scored = train(df, key, target, name, task)
    got = attributions(model, scored, "key", p.features).withColumnRenamed("key", "k")
    return got.join(scored.select(F.col("key").alias("k"), "prediction"), "k").withColumnRenamed("k", key)
