"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, small_batches, text_of
from .quality_rules import labelled_sample
from .quality_trees import is_held_out

FIT_ROWS = 20_000    # most labelled rows the chain is fitted on
TERMS = 256          # most indicator terms
FAMILIES = 4         # toxicity categories before the overall one
MIN_ROWS, MIN_SHARE = 4, 0.8
PREFIXES = (4, 5)
FOLDS = 5
CLEAN_FLAGGED = 0.001
SKETCH_BY = np.random.default_rng(11).integers(1 << 62, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> set[str]:
    """Distinct lower-case words of a whole text, and their beginnings marked with a caret."""
    words = set(_WORD.findall(text.lower()))
    return words.union(*[{"^" + w[:n] for w in words if len(w) > n} for n in PREFIXES])


@F.pandas_udf(T.ArrayType(T.StringType()))
def distinct_terms(text: pd.Series) -> pd.Series:
    return pd.Series([sorted(terms_of(t)) for t in text])


def copy_key(text: str) -> bytes:
    """Smallest word hashes under eight independent hash functions: copies of a text, and most copies with a few words
    changed, agree on all of them; texts that share half of their words do so once in 256 times."""
    words = set(_WORD.findall(text.lower()))
    if not words:
        return b""
    h = np.array([int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little") for w in words], dtype=np.uint64)
    h = h[:, None] * SKETCH_BY[None, :]
    h = (h ^ (h >> np.uint64(29))) * SKETCH_BY[None, ::-1]
    return (h ^ (h >> np.uint64(32))).min(axis=0).tobytes()


@F.pandas_udf(T.BinaryType())
def sketch(text: pd.Series) -> pd.Series:
    """``copy_key`` of texts: copies of a text share it, so they count once in training."""
    return pd.Series([copy_key(t) for t in text], dtype=object)


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the intercept and is not shrunk."""
    a = np.column_stack([x, np.ones(len(x))])
    b, keep = np.zeros(a.shape[1]), np.full(a.shape[1], l2)
    keep[-1] = 1e-6
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        v = weight * p * (1 - p) + 1e-9
        step = np.linalg.solve((a * v[:, None]).T @ a + np.diag(keep), a.T @ (weight * (p - y)) + keep * b)
        b -= step
        if np.abs(step).max() < 1e-5:
            break
    return b


def _apply(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ b[:-1] + b[-1], -30, 30)))


def _families(x: np.ndarray, count: int) -> np.ndarray:
    """Family of each term: terms that occur in the same texts, by k-means on their directions."""
    v = x.T / np.maximum(np.linalg.norm(x.T, axis=1, keepdims=True), 1e-9)
    heads = [0]
    while len(heads) < min(count, len(v)):
        heads.append(int((v @ v[heads].T).max(axis=1).argmin()))
    c = v[heads]
    for _ in range(20):
        at = (v @ c.T).argmax(axis=1)
        c = np.stack([v[at == k].sum(axis=0) if (at == k).any() else c[k] for k in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return at


class Chain:
    """Linear models in sequence.  The categories are families of indicator terms, the last one is the label itself; each
    model also reads the probabilities of the categories before it, out of fold while training."""

    def __init__(self, terms: list[str], x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> None:
        self.index = {t: i for i, t in enumerate(terms)}
        at = _families(x[y == 1], FAMILIES)
        names = range(int(at.max()) + 1)
        targets = [((x[:, at == k].sum(axis=1) > 0) & (y == 1)).astype(float) for k in names] + [y.astype(float)]
        self.models, inputs = [], x
        one = np.ones(len(y))
        for target in targets:
            self.models.append(_fit(inputs, target, one))
            out = np.zeros(len(y))
            for f in range(FOLDS):
                out[fold == f] = _apply(inputs[fold == f], _fit(inputs[fold != f], target[fold != f], one[fold != f]))
            inputs = np.column_stack([inputs, out])
        score = inputs[:, -1]  # out of fold
        clean = np.sort(score[y == 0])[::-1]
        floor = clean[min(int(CLEAN_FLAGGED * len(clean)), len(clean) - 1)] if len(clean) else 0.0
        self.cut = float(min(max(floor + 1e-9, 0.3), 0.9))

    def score(self, texts: pd.Series) -> np.ndarray:
        x = np.zeros((len(texts), len(self.index)))
        for i, t in enumerate(texts):
            x[i, [self.index[w] for w in terms_of(t) & self.index.keys()]] = 1
        for b in self.models:
            x = np.column_stack([x, _apply(x, b)])
        return x[:, len(self.index):]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS, key: str = "doc_id",
                 text: str = "text") -> Chain | None:
    """A chain fitted on at most ``rows`` labelled rows outside the held-out fifth; None without toxic rows or terms.

    Spark counts the rows of every term; a term is an indicator if at least 4 different texts have it and 80 % of them
    are toxic.  The 256 strongest, and which of the rows have which, are all the driver sees."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, rows, ~is_held_out("id"), key, text)
    held = sample.select("id", "y", sketch("body").alias("k"), distinct_terms("body").alias("terms"))
    held = materialise(held, "toxic-sample")
    one = held.groupBy("k", "y").agg(F.min_by("terms", "id").alias("terms"), F.min("id").alias("id"))
    one = materialise(one.withColumn("fold", F.pmod(F.xxhash64("k"), F.lit(FOLDS)).cast("int")), "toxic-texts")
    counts = one.select("y", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n")).where((F.col("bad") >= MIN_ROWS) & (F.col("bad") >= MIN_SHARE * F.col("n")))
    top = counts.orderBy(F.desc(F.col("bad") * F.col("bad") / F.col("n")), "term").limit(TERMS)
    terms = [r[0] for r in top.collect()]
    if not terms:
        return None
    has = F.array_intersect("terms", F.array(*[F.lit(t) for t in terms]))
    got = one.select("id", "y", "fold", has.alias("has")).toPandas().sort_values("id")  # at most ``rows`` rows
    x = np.zeros((len(got), len(terms)))
    index = {t: i for i, t in enumerate(terms)}
    for i, h in enumerate(got["has"]):
        x[i, [index[t] for t in h]] = 1
    return Chain(terms, x, got["y"].to_numpy(), got["fold"].to_numpy())


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, categories (probability of each term family), score, predicted for every row.

    Terms are looked up in the whole text.  The threshold flags at most one in a thousand labelled clean texts out of fold
    (and lies between 0.3 and 0.9).  Null and empty texts have no term.  Without toxic labels all scores are 0.  Repeated
    rows score alike; an empty table gives an empty result; other columns are not read."""
    chain = fit_toxicity(docs, labels, label, key=key, text=text)

    def run(text: pd.Series) -> pd.Series:
        return pd.Series(list(chain.score(text)) if chain is not None else [[0.0]] * len(text))

    scored = docs.select(docs[key].alias("id"), F.pandas_udf(run, "array<double>")(text_of(docs, text)).alias("p"))
    out = scored.select("id", F.slice("p", 1, F.size("p") - 1).alias("categories"), F.element_at("p", -1).alias("score"))
    cut = chain.cut if chain is not None else 1.0
    return out.select(F.col("id").alias(key), is_held_out("id").alias("held_out"), "categories", "score",
                      (F.col("score") >= cut).cast("int").alias("predicted"))
