"""Quality rules: isolation forest on rule statistics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, small_batches, text_of
from .textstats import STATS, text_stats

BASE = STATS[:5]
MIN_WORDS, MAX_REPEAT_PCT = 10, 20
FEATURES = 8
RANGES = 1 << 14       # ranges of scores whose counts reach the driver
TREES, POINTS, DEPTH = 200, 256, 12
GOOD_COST = 5          # a good row rejected counts as much as five bad ones kept


def rule_features(s: np.ndarray) -> np.ndarray:
    """Shares that do not grow with a text's length, from rows of ``STATS``."""
    s = s.astype(np.float64)
    n, chars = np.maximum(s[:, 0], 1), np.maximum(s[:, 13], 1)
    sym = s[:, 2] / n
    return np.stack([sym / (1 + sym), s[:, 4] / n, s[:, 3] / np.maximum(s[:, 5], 1), s[:, 7] / n, s[:, 8] / chars,
                     np.minimum(s[:, 1] / n, 30.0) / 30.0, s[:, 9] / chars, s[:, 14] / chars], axis=1)


class Forest:
    """Isolation trees as flat arrays.  Splits are random over the box of all labelled rows, nodes hold good rows only: a
    text in a part of the box without good rows comes to its leaf early."""

    def __init__(self, good: np.ndarray, box: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        nodes: list[tuple[int, float, int, int, float]] = []
        self.roots = []
        self.base = max(_path(min(len(good), POINTS)), 1.0)
        for _ in range(TREES):
            picked = good[rng.choice(len(good), min(len(good), POINTS), replace=False)]
            self.roots.append(self._grow(nodes, picked, box[0].copy(), box[1].copy(), 0, rng))
        cols = list(zip(*nodes, strict=True))
        self.feature, self.at = np.array(cols[0]), np.array(cols[1])
        self.low, self.high, self.depth = np.array(cols[2]), np.array(cols[3]), np.array(cols[4])

    def _grow(self, nodes: list, x: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        me = len(nodes)
        nodes.append((-1, 0.0, me, me, depth + _path(len(x))))
        open_ = np.nonzero(high > low)[0]
        if depth < DEPTH and len(x) > 1 and len(open_):
            f = int(rng.choice(open_))
            at = float(rng.uniform(low[f], high[f]))
            left, right = high.copy(), low.copy()
            left[f], right[f] = at, at
            a = self._grow(nodes, x[x[:, f] < at], low, left, depth + 1, rng)
            b = self._grow(nodes, x[x[:, f] >= at], right, high, depth + 1, rng)
            nodes[me] = (f, at, a, b, 0.0)
        return me

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score, 0 to 1: shorter mean paths score higher."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                f = self.feature[at]
                at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] < self.at[at], self.low[at], self.high[at]))
            total += self.depth[at]
        return 2.0 ** (-total / len(self.roots) / self.base)


def _path(n: int) -> float:
    """Mean path of an unsuccessful search among ``n`` points."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def base_failed(s: np.ndarray) -> np.ndarray:
    return (s[:, 0] < MIN_WORDS) | (100 * s[:, 4] > MAX_REPEAT_PCT * s[:, 0])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, where: Column | None = None,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, body, y) of at most ``rows`` labelled documents, those with the smallest key hashes.  The sample of labels,
    at most ``rows`` small rows, is sent to all tasks; the documents are scanned once."""
    y = labels.select(labels[key].alias("id"), labels[label].cast("int").alias("y")).where("id is not null and y is not null")
    y = (y.where(where) if where is not None else y).groupBy("id").agg(F.max("y").alias("y"))
    y = y.orderBy(F.xxhash64("id"), "id").limit(rows)
    return docs.select(docs[key].alias("id"), text_of(docs, text).alias("body")).join(F.broadcast(y), "id")


@F.pandas_udf(T.ArrayType(T.LongType()))
def stats_of(text: pd.Series) -> pd.Series:
    return pd.Series([text_stats(t) for t in text])


def stats_table(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of a bounded sample, on the driver."""
    small_batches(sample.sparkSession)
    got = sample.select("id", "y", stats_of("body").alias("s")).toPandas().sort_values("id")
    return np.array(got["s"].tolist(), dtype=np.int64).reshape(-1, len(STATS)), got["y"].to_numpy(dtype=np.int64)


def labelled_stats(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, y, ok, x) of every labelled document: its label, whether it passes the base rules, and its features."""
    def run(text: pd.Series) -> pd.DataFrame:
        s = np.array([text_stats(t) for t in text], dtype=np.int64).reshape(-1, len(STATS))
        return pd.DataFrame({"ok": ~base_failed(s), "x": list(rule_features(s))})

    small_batches(docs.sparkSession)
    y = labels.select(labels[key].alias("id"), labels[label].cast("int").alias("y")).where("id is not null and y is not null")
    y = y.groupBy("id").agg(F.max("y").alias("y"))
    found = docs.select(docs[key].alias("id"), F.pandas_udf(run, "ok boolean, x array<double>")(text_of(docs, text)).alias("s"))
    return found.join(y, "id").select("id", "y", "s.ok", "s.x")  # the texts stay where they are, only their features are joined


def cheapest_cut(scores: DataFrame) -> float:
    """The middle of the cheapest thresholds over (score, y): rows above are rejected, a good one costs GOOD_COST, a bad one kept 1.

    Equal scores are counted first; the running counts go range by range of the scores, so no task orders all of them."""
    spark = scores.sparkSession
    per = scores.groupBy("score").agg(F.count(F.when(F.col("y") == 1, 1)).alias("good"), F.count(F.when(F.col("y") == 0, 1)).alias("bad"))
    per = per.unionByName(spark.range(1).select(F.lit(1.0).alias("score"), F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("bad")))
    per = materialise(per.groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).withColumn(
        "part", F.floor(F.col("score") * RANGES).cast("int")), "scores")
    ends = per.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("part").collect()  # at most RANGES + 1
    all_good, below, rows = sum(r["good"] for r in ends), 0, []
    for r in ends:
        rows.append((r["part"], GOOD_COST * all_good + below))
        below += r["bad"] - GOOD_COST * r["good"]
    upto = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cost = per.join(F.broadcast(spark.createDataFrame(rows, "part int, before bigint")), "part").select(
        "score", (F.col("before") + F.sum(F.col("bad") - GOOD_COST * F.col("good")).over(upto)).alias("cost"))
    best = cost.groupBy("cost").agg(F.min("score").alias("first"), F.max("score").alias("last")).orderBy("cost").first()
    high = per.where(F.col("score") > best["last"]).agg(F.min("score").alias("s")).first()["s"]
    return (best["first"] + (best["last"] if high is None else high)) / 2  # up to the next score all thresholds are alike


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> tuple[Forest | None, float]:
    """A forest and the score above which a text is rejected, from all labelled rows.

    The box of the forest spans every labelled row and the threshold is calibrated on every one that passes the base rules: of the scores
    that cost least, good rows rejected counting five times, the middle one.  Each tree grows, as isolation trees do, on POINTS good rows of its
    own draw; they are drawn from all good rows, or from as many as all trees take, those with the smallest key hashes.
    Without good rows there is no forest, and only the base rules decide."""
    rows = materialise(labelled_stats(docs, labels, label, key, text), "rules")
    good = rows.where("ok and y = 1")
    size = rows.agg(F.count(F.when(F.expr("ok and y = 1"), 1)).alias("n"), *[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(FEATURES)
                                                                          for n, f in (("l", F.min), ("h", F.max))]).first()
    if size["n"] < 2:
        return None, 1.0
    pool = good if size["n"] <= TREES * POINTS else good.orderBy(F.xxhash64("id"), "id").limit(TREES * POINTS)
    x = np.array(pool.select("id", "x").toPandas().sort_values("id")["x"].tolist())
    low, high = (np.array([size[f"{n}{i}"] for i in range(FEATURES)]) for n in "lh")
    forest = Forest(x, np.stack([low, np.maximum(high, low + 0.05)]))

    def score(x: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.vstack(x.to_numpy())) if len(x) else [], dtype="float64")

    return forest, cheapest_cut(rows.where("ok").select(F.pandas_udf(score, "double")("x").alias("score"), "y"))


def judge(forest: Forest | None, threshold: float) -> Callable[[Column], Column]:
    """A column function: struct of the base statistics, base_failed, anomaly and kept."""
    schema = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, anomaly double, kept boolean"

    def run(text: pd.Series) -> pd.DataFrame:
        s = np.array([text_stats(t) for t in text], dtype=np.int64).reshape(-1, len(STATS))
        failed = base_failed(s)
        anomaly = forest.score(rule_features(s)) if forest is not None else np.zeros(len(s))
        return pd.DataFrame({n: s[:, i] for i, n in enumerate(BASE)}).assign(
            base_failed=failed, anomaly=anomaly, kept=~failed & (anomaly <= threshold))

    return F.pandas_udf(run, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly, kept for every row.

    A text fails the base rules with under 10 words or more than 20 % of its words in repeated five-word windows; it is
    kept if it passes them and the forest finds it no anomaly.  Null texts have no words and fail.  Rows are judged one
    by one: repeated rows alike, an empty table gives an empty result, other columns are not read."""
    small_batches(docs.sparkSession)
    rule = judge(*fit_rules(docs, labels, label, key=key, text=text))
    out = docs.select(docs[key].alias("id"), rule(text_of(docs, text)).alias("q"))
    return out.select(F.col("id").alias(key), "q.*")


def drop_low_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``quality_rules`` does not keep; columns unchanged."""
    small_batches(docs.sparkSession)
    rule = judge(*fit_rules(docs, labels, label, key=key, text=text))
    return docs.where(rule(text_of(docs, text)).getField("kept"))
