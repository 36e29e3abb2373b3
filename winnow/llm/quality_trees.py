"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of
from .quality_rules import labelled_sample, rule_features, stats_table
from .textstats import STATS, text_stats

FIT_ROWS = 20_000  # most labelled rows the trees are fitted on
ROUNDS, DEPTH, BINS, RATE, SHRINK = 80, 4, 64, 0.1, 1.0
CUT = 0.3


def quality_features(s: np.ndarray) -> np.ndarray:
    """Document statistics from rows of ``STATS``; shares, and sizes on a log scale."""
    f = s.astype(np.float64)
    n, chars, lines = np.maximum(f[:, 0], 1), np.maximum(f[:, 13], 1), np.maximum(f[:, 5], 1)
    return np.column_stack([rule_features(s), np.log1p(f[:, 0]), np.log1p(f[:, 13]), f[:, 6] / n, f[:, 10] / n, f[:, 11] / chars,
                            np.log1p(f[:, 12]), np.log1p(n / lines), f[:, 2] / chars])


class Trees:
    """Perfect trees of one depth in flat arrays; a node that does not split sends everything left."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
        inner = 2 ** DEPTH - 1
        self.feature = np.zeros((ROUNDS, inner), dtype=np.int64)
        self.at = np.full((ROUNDS, inner), np.inf)
        self.leaf = np.zeros((ROUNDS, inner + 1))
        rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        raw = np.full(len(y), self.start)
        for t in range(ROUNDS):
            p = 1 / (1 + np.exp(-raw))
            node = self._grow(t, binned, edges, p - y, p * (1 - p))
            raw += self.leaf[t][node]

    def _grow(self, t: int, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Level by level: gradient histograms of all nodes of a level, then their best splits."""
        node = np.zeros(len(g), dtype=np.int64)
        for depth in range(DEPTH):
            width, first = 2 ** depth, 2 ** depth - 1
            gain, feature, cut = np.full(width, 1e-6), np.zeros(width, dtype=np.int64), np.full(width, BINS)
            for f in range(binned.shape[1]):
                where = node * BINS + binned[:, f]
                gs = np.bincount(where, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(where, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                total_g, total_h = gs[:, -1:], hs[:, -1:]
                won = gs ** 2 / (hs + SHRINK) + (total_g - gs) ** 2 / (total_h - hs + SHRINK) - total_g ** 2 / (total_h + SHRINK)
                won[(hs < 1) | (total_h - hs < 1)] = 0
                best = won.argmax(axis=1)
                better = won[np.arange(width), best] > gain
                gain = np.where(better, won[np.arange(width), best], gain)
                feature, cut = np.where(better, f, feature), np.where(better, best, cut)
            for k in range(width):
                if cut[k] < BINS and cut[k] < len(edges[feature[k]]):
                    self.feature[t, first + k], self.at[t, first + k] = feature[k], edges[feature[k]][cut[k]]
                else:
                    cut[k] = BINS
            node = 2 * node + (binned[np.arange(len(g)), feature[node]] > cut[node])
        sums, weights = np.bincount(node, g, 2 ** DEPTH), np.bincount(node, h, 2 ** DEPTH)
        self.leaf[t] = -RATE * sums / (weights + SHRINK)
        return node

    def score(self, x: np.ndarray) -> np.ndarray:
        raw, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, at, leaf in zip(self.feature, self.at, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > at[node])
            raw += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-raw))


def is_held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, key: str = "doc_id",
                text: str = "text") -> Trees | None:
    """Trees fitted on at most ``rows`` labelled rows, none of them held out; None without any."""
    s, y = stats_table(labelled_sample(docs, labels, label, rows, ~is_held_out("id"), key, text))
    return Trees(quality_features(s), y) if len(y) else None


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = CUT, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """key, held_out, score, predicted for every row: the likelihood of label 1 from statistics of the whole text.

    A row is held out from learning if crc32 of its key is divisible by 5 (a null key: null).  Null and empty texts are
    scored by their statistics, all zero.  Without labels every score is 0.5.  Repeated rows score alike; an empty table
    gives an empty result; other columns are not read."""
    small_batches(docs.sparkSession)
    model = fit_quality(docs, labels, label, key=key, text=text)

    def run(text: pd.Series) -> pd.Series:
        s = np.array([text_stats(t) for t in text], dtype=np.int64).reshape(-1, len(STATS))
        return pd.Series(model.score(quality_features(s)) if model is not None else np.full(len(s), 0.5))

    scored = docs.select(docs[key].alias("id"), F.pandas_udf(run, "double")(text_of(docs, text)).alias("score"))
    return scored.select(F.col("id").alias(key), is_held_out("id").alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"))
