"""Regression trees, forests and boosted trees on cells, as MLlib's learners fit them on rows.

A feature has at most 32 bins, so a tree cannot tell rows apart that lie in the same bins of all features: such rows are one
cell, of which a fit needs the weight and the sum of the labels alone.  One shuffle brings the rows of a cell together and draws
the bags of all trees row by row; a second one deals the cells of every tree to a task, which grows it for the whole table and
for the training rows of every fold.  The work after the first shuffle grows with the cells, not with the rows."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import distinct_counts, exact_quantiles, stats_row
from ..session import TASK_ROWS

BINS = 32  # MLlib's maxBins
TREES, FOREST_DEPTH, BOOST_DEPTH, RATE = 100, 10, 5, 0.1  # as models.REGRESSORS builds them
TASK_BYTES = 1 << 26  # cells of one tree in one task; tables with more are left to MLlib

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # what runs in tasks travels with them

LEARNERS = ("Decision Tree", "Random Forest", "Gradient Boosting")


def cuts_of(df: DataFrame, features: int) -> list[np.ndarray]:
    """Thresholds of each feature from all rows: between its values if there are at most 32, else its exact 32nds."""
    x = vector_to_array("features")
    flat = df.select(*[x[i].alias(f"_x{i}") for i in range(features)])
    names = flat.columns
    u = distinct_counts(flat, names)
    few = [n for n in names if u[n] <= BINS]
    got = stats_row(flat, {n: F.collect_set(n) for n in few}) if few else {}  # at most 32 values each
    ranks = exact_quantiles(flat, [n for n in names if n not in few], [i / BINS for i in range(1, BINS)]) if len(few) < features else {}
    out = []
    for n in names:
        if n in few:
            v = np.unique(np.array(got[n], dtype=float))
            out.append((v[:-1] + v[1:]) / 2)
        else:
            out.append(np.unique(np.array(ranks[n], dtype=float)))
    return out


def _binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of every value: a value up to the first threshold lies in bin 0."""
    return np.stack([np.searchsorted(t, x[:, i], side="left") for i, t in enumerate(cuts)], axis=1).astype(np.uint8)


def grow(bins: np.ndarray, sizes: Sequence[int], w: np.ndarray, s: np.ndarray, depth: int, subset: int | None = None,
         rng: np.random.Generator | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(flat tree, leaf of every cell): variance splits level by level, each node over ``subset`` features drawn for it.

    ``w`` and ``s`` are weight and label sum of the cells.  Node i has ``feature`` (-1: leaf), the last ``bin`` that goes
    left, the ``left`` child (the right one follows it), ``value`` and ``gain`` (times weight)."""
    p = bins.shape[1]
    w, s = w.astype(float), s.astype(float)
    mean = s.sum() / w.sum()
    s = s - w * mean  # sums of centred labels lose no digits
    feature, cut, left = [np.array([-1])], [np.array([0])], [np.array([0])]
    value, gains = [np.array([mean])], [np.array([0.0])]
    leaf = np.zeros(len(w), dtype=np.int64)
    at = np.nonzero(w > 0)[0]
    least = 1e-13 * float((s[at] ** 2 / w[at]).sum())
    node, first, count = np.zeros(len(at), dtype=np.int64), 0, 1
    for level in range(depth):
        best, place = np.full(count, -np.inf), np.zeros((count, 2), dtype=np.int64)
        open_ = np.ones((count, p), dtype=bool)
        if subset is not None and subset < p:
            open_ = rng.random((count, p)).argsort(axis=1).argsort(axis=1) < subset
        for j in range(p):
            if sizes[j] < 2:
                continue
            i = node * sizes[j] + bins[at, j]
            ws = np.bincount(i, w[at], count * sizes[j]).reshape(count, -1).cumsum(axis=1)
            ss = np.bincount(i, s[at], count * sizes[j]).reshape(count, -1).cumsum(axis=1)
            wl, sl = ws[:, :-1], ss[:, :-1]
            wr, sr = ws[:, -1:] - wl, ss[:, -1:] - sl
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = sl * sl / wl + sr * sr / wr - ss[:, -1:] ** 2 / ws[:, -1:]
            gain[(wl < 0.5) | (wr < 0.5) | ~open_[:, j, None]] = -np.inf  # whole numbers of rows, at least one on each side
            k = gain.argmax(axis=1)
            top = gain[np.arange(count), k]
            better = top > best
            best[better], place[better, 0], place[better, 1] = top[better], j, k[better]
        split = best > least
        if not split.any():
            break
        order = np.cumsum(split) - 1
        start = first + count
        feature[-1], cut[-1] = np.where(split, place[:, 0], -1), np.where(split, place[:, 1], 0)
        left[-1], gains[-1] = np.where(split, start + 2 * order, 0), np.where(split, best, 0.0)
        stays = ~split[node]
        leaf[at[stays]] = first + node[stays]
        at, node = at[~stays], node[~stays]
        right = bins[at, place[node, 0]] > place[node, 1]
        node = 2 * order[node] + right
        first, count = start, 2 * int(split.sum())
        ws, ss = np.bincount(node, w[at], count), np.bincount(node, s[at], count)
        feature.append(np.full(count, -1))
        cut.append(np.zeros(count, dtype=np.int64))
        left.append(np.zeros(count, dtype=np.int64))
        value.append(mean + ss / ws)
        gains.append(np.zeros(count))
    leaf[at] = first + node
    tree = {"feature": np.concatenate(feature).astype(np.int16), "bin": np.concatenate(cut).astype(np.uint8),
            "left": np.concatenate(left).astype(np.int32), "value": np.concatenate(value), "gain": np.concatenate(gains)}
    return tree, leaf


def boost(bins: np.ndarray, sizes: Sequence[int], w: np.ndarray, s: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Boosted trees with squared loss: after the first, each fits minus the gradient and counts by the rate."""
    keep = w > 0
    bins, w, s = bins[keep], w[keep].astype(float), s[keep].astype(float)
    said, out = np.zeros(len(w)), []
    for i in range(TREES):
        tree, leaf = grow(bins, sizes, w, s if i == 0 else 2 * (s - w * said), BOOST_DEPTH)
        said += (RATE if i else 1.0) * tree["value"][leaf]
        out.append(tree)
    return out


def walk(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """Value of the leaf of every row."""
    at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while True:
        f = tree["feature"][at[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        if not len(rows):
            return tree["value"][at]
        n = at[rows]
        at[rows] = tree["left"][n] + (bins[rows, f] > tree["bin"][n])


@dataclass
class TreesOnCells:
    """Fitted trees with their weights; scores rows by their bins."""

    cuts: list[np.ndarray]
    trees: list[dict[str, np.ndarray]]
    weights: list[float]
    each: bool  # importances are shares of every tree

    def transform(self, df: DataFrame) -> DataFrame:
        cuts, trees, weights = self.cuts, [{k: t[k] for k in ("feature", "bin", "left", "value")} for t in self.trees], self.weights

        def predict(x: pd.Series) -> pd.Series:
            bins = _binned(np.vstack(x.to_numpy()), cuts) if len(x) else np.zeros((0, len(cuts)), dtype=np.uint8)
            cells, back = _distinct(bins)
            out = np.zeros(len(cells))
            for t, v in zip(trees, weights, strict=True):
                out += v * walk(t, cells)
            return pd.Series(out[back])

        return df.withColumn("prediction", F.pandas_udf(predict, "double")(vector_to_array("features")))

    @property
    def featureImportances(self) -> DenseVector:
        total = np.zeros(len(self.cuts))
        for t in self.trees:
            inner = t["feature"] >= 0
            one = np.bincount(t["feature"][inner], t["gain"][inner], len(self.cuts))
            total += one / one.sum() if self.each and one.sum() > 0 else one
        return DenseVector(total / total.sum() if total.sum() > 0 else total)


def _distinct(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, which of them every row is)."""
    if not len(bins):
        return bins, np.zeros(0, dtype=np.int64)
    names = np.ascontiguousarray(bins).view(f"V{bins.shape[1]}").ravel()
    _, first, back = np.unique(names, return_index=True, return_inverse=True)
    return bins[first], back


def _packer(features: int, folds: int, learners: Sequence[str], seed: int):
    """Batches of rows in the order of their cells to the cells of every job: bins, and weight and label sum by fold.

    Jobs are 'forest' with a number for every tree, whose rows are drawn with Poisson weights, 'boost' with one for the whole
    table (0) and one for each fold, and 'tree'."""
    plain = [("boost", i) for i in range(folds + 1 if folds > 1 else 1)] if "Gradient Boosting" in learners else []
    plain += [("tree", 0)] if "Decision Tree" in learners else []

    def pack(batches):
        rng = None
        for d in batches:
            if not len(d):
                continue
            raw = d["cell"].to_numpy()
            if rng is None:
                rng = np.random.default_rng([seed, *raw[0]])
            rows = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(d), features)
            cells, back = _distinct(rows)
            y, unit = d["label"].to_numpy(), back * folds + d["fold"].to_numpy()
            size = len(cells) * folds

            def sums(weight=None, unit=unit, y=y, size=size):
                w = np.bincount(unit, weight, size).astype(np.float32)
                return w.tobytes(), np.bincount(unit, y if weight is None else y * weight, size).tobytes()

            out = [(*job, *sums()) for job in plain]
            if "Random Forest" in learners:
                bags = rng.poisson(1.0, (len(d), TREES)).astype(float)
                out += [("forest", t, *sums(bags[:, t])) for t in range(TREES)]
            yield pd.DataFrame([(*r, cells.tobytes()) for r in out], columns=["job", "number", "w", "s", "cells"])

    return pack


def _grower(sizes: list[int], folds: int, seed: int):
    """The trees of one job for every fit: fit 0 has all folds, fit i + 1 all but fold i."""
    features = len(sizes)
    fits = folds + 1 if folds > 1 else 1

    def run(key, d):
        job, number = key
        bins = np.frombuffer(b"".join(d["cells"]), dtype=np.uint8).reshape(-1, features)
        w = np.frombuffer(b"".join(d["w"]), dtype=np.float32).reshape(-1, folds).astype(float)
        s = np.frombuffer(b"".join(d["s"]), dtype=float).reshape(-1, folds)
        out = []
        for fit in ([int(number)] if job == "boost" else range(fits)):
            mine = [i for i in range(folds) if i != fit - 1]
            fw, fs = w[:, mine].sum(axis=1), s[:, mine].sum(axis=1)
            if not fw.any():
                continue
            if job == "boost":
                trees = list(enumerate(boost(bins, sizes, fw, fs)))
            elif job == "tree":
                trees = [(0, grow(bins, sizes, fw, fs, FOREST_DEPTH)[0])]
            else:
                rng = np.random.default_rng([seed, int(number), fit])
                trees = [(int(number), grow(bins, sizes, fw, fs, FOREST_DEPTH, math.ceil(features / 3), rng)[0])]
            out += [(job, fit, n, *(t[k].tobytes() for k in ("feature", "bin", "left", "value", "gain"))) for n, t in trees]
        return pd.DataFrame(out, columns=["job", "fit", "tree", "feature", "bin", "left", "value", "gain"])

    return run


KINDS = {"feature": np.int16, "bin": np.uint8, "left": np.int32, "value": float, "gain": float}
JOBS = {"tree": "Decision Tree", "forest": "Random Forest", "boost": "Gradient Boosting"}


def fit_on_cells(data: DataFrame, features: int, folds: int, learners: Sequence[str], fold=None, seed: int = 42) -> dict:
    """{(learner, fit): model} over ``data`` (key, features, label): fit 0 has all rows, fit i + 1 those outside fold i of
    ``fold``.  None if the cells of the table are too many for one task."""
    cuts = cuts_of(data, features)
    sizes = [len(t) + 1 for t in cuts]
    folds = folds if folds > 1 else 1
    to_cell = F.pandas_udf(lambda x: pd.Series([r.tobytes() for r in _binned(np.vstack(x.to_numpy()), cuts)] if len(x) else []), "binary")
    rows = data.select("key", "label", to_cell(vector_to_array("features")).alias("cell"),
                       (F.lit(0) if fold is None or folds == 1 else fold).cast("int").alias("fold"))
    most = TASK_BYTES // (features + 12 * folds)
    if math.prod(sizes) > most and rows.select("cell").distinct().count() > most:
        return {}
    n = data.count()
    # in order, so that draws repeat
    dealt = rows.repartition(max(1, -(-n // TASK_ROWS)), "cell").sortWithinPartitions("cell", "key", "label").select("cell", "fold", "label")
    packed = dealt.mapInPandas(_packer(features, folds, learners, seed), "job string, number int, w binary, s binary, cells binary")
    jobs = (TREES if "Random Forest" in learners else 0) + 8
    grown = packed.repartition(jobs, "job", "number").groupBy("job", "number").applyInPandas(
        _grower(sizes, folds, seed), "job string, fit int, tree int, feature binary, bin binary, left binary, value binary, gain binary")
    trees: dict = {}
    for r in grown.collect():  # the models: at most 2047 nodes a tree
        trees.setdefault((JOBS[r["job"]], r["fit"]), []).append((r["tree"], {k: np.frombuffer(r[k], dtype=t) for k, t in KINDS.items()}))
    out = {}
    for (name, fit), some in trees.items():
        some = [t for _, t in sorted(some, key=lambda x: x[0])]
        weights = [1.0] + [RATE] * (len(some) - 1) if name == "Gradient Boosting" else [1.0 / len(some)] * len(some)
        out[(name, fit)] = TreesOnCells(cuts, some, weights, name != "Gradient Boosting")
    return out
