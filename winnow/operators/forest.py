"""Isolation forest: trees are grown in parallel on small row samples, rows are scored where they are."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import c, num, require
from ..functions.stats import exact_quantiles, stats_row
from ..session import cut_lineage, spread
from .sample import random_sample

NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double"


def average_path(n: float) -> float:
    """Expected depth of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(p: int, limit: int, seed: int):
    """Grow one tree of random splits; self-contained for the executors."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import math

        import numpy as np
        import pandas as pd

        tree = int(pdf["tree"].iloc[0])
        x = pdf[[f"x{i}" for i in range(p)]].to_numpy()
        x = x[np.lexsort(x.T)]  # row order must not matter
        rng = np.random.default_rng([seed, tree])
        rows = []

        def depth_left(n):
            if n <= 1:
                return 0.0
            return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n

        def grow(part, depth):
            node = len(rows)
            rows.append(None)
            lo, hi = part.min(axis=0), part.max(axis=0)
            able = np.nonzero(hi > lo)[0]
            if depth >= limit or len(part) <= 1 or not len(able):
                rows[node] = (tree, node, -1, 0.0, 0, 0, depth + depth_left(len(part)))
                return node
            f = int(rng.choice(able))
            cut = float(rng.uniform(lo[f], hi[f]))
            mask = part[:, f] <= cut
            a = grow(part[mask], depth + 1)
            b = grow(part[~mask], depth + 1)
            rows[node] = (tree, node, f, cut, a, b, 0.0)
            return node

        grow(x, 0)
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "cut", "left", "right", "depth"])

    return run


def fit_forest(df: DataFrame, key: str, cols: Sequence[str], trees: int = 100, rows: int = 256, seed: int = 42) -> dict:
    """Medians for missing values and the trees (at most trees · 2 · rows nodes)."""
    require(df, key, *cols)
    med = {n: q[0] or 0.0 for n, q in exact_quantiles(df, cols, [0.5]).items()}
    pts = df.select(c(key).alias("k"), *[F.coalesce(num(df, n), F.lit(med[n])).alias(f"x{i}") for i, n in enumerate(cols)])
    total = df.count()
    size = min(rows, total)
    pool = random_sample(pts, "k", min(total, trees * rows), seed)
    each = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    w = Window.partitionBy("tree").orderBy(F.xxhash64("k", "tree", F.lit(seed)), "k")
    each = each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size)  # a sampling operator: rows per tree
    limit = math.ceil(math.log2(max(size, 2)))
    nodes = each.groupBy("tree").applyInPandas(_grow(len(cols), limit, seed), NODE_SCHEMA).collect()
    by: dict[int, list] = {}
    for r in nodes:
        by.setdefault(r["tree"], []).append(tuple(r)[1:])
    return {"cols": list(cols), "median": med, "size": size, "trees": [sorted(v) for _, v in sorted(by.items())]}


def score_forest(df: DataFrame, model: dict, out: str = "score") -> DataFrame:
    """Anomaly score in 0..1 per row, by vectorised tree walks over Arrow batches."""
    trees = [tuple(list(v) for v in zip(*t)) for t in model["trees"]]
    norm = average_path(model["size"]) or 1.0

    def walk(x: pd.Series) -> pd.Series:
        import numpy as np
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype="float64")
        m = np.vstack(x.to_numpy())
        total = np.zeros(len(m))
        for _, feature, cut, left, right, depth in trees:
            f, v, a, b, d = (np.asarray(t) for t in (feature, cut, left, right, depth))
            at = np.zeros(len(m), dtype=np.int64)
            while True:
                idx = np.nonzero(f[at] >= 0)[0]
                if not len(idx):
                    break
                cur = at[idx]
                at[idx] = np.where(m[idx, f[cur]] <= v[cur], a[cur], b[cur])
            total += d[at]
        return pd.Series(np.exp2(-total / len(trees) / norm))

    vec = F.array(*[F.coalesce(num(df, n), F.lit(model["median"][n])) for n in model["cols"]])
    return df.withColumn(out, F.pandas_udf(walk, "double")(vec))


def isolation_forest(df: DataFrame, key: str, cols: Sequence[str], contamination: float = 0.05, trees: int = 100,
                     seed: int = 42) -> DataFrame:
    """(key, cols, score, is_outlier): the highest-scoring share of rows, clamped to 1..40 %."""
    share = max(0.01, min(0.4, contamination))
    model = fit_forest(df, key, cols, trees, seed=seed)
    rows = df.select(c(key), *[c(n) for n in cols])
    s = cut_lineage(score_forest(spread(rows, key, df.count()), model))  # scored once, read by every pass of the quantile
    cut = exact_quantiles(s, ["score"], [1.0 - share])["score"][0]
    return s.withColumn("is_outlier", F.col("score") > F.lit(cut))


def outlier_summary(flagged: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, outlier_count, min, max) over the flagged rows."""
    from ..functions.stats import rows_to_df

    aggs = {}
    for n in cols:
        x = F.when(F.col("is_outlier"), num(flagged, n))
        aggs.update({("k", n): F.count(x), ("lo", n): F.min(x), ("hi", n): F.max(x)})
    got = stats_row(flagged, aggs)
    rows = [(n, got[("k", n)], got[("lo", n)], got[("hi", n)]) for n in cols]
    return rows_to_df(flagged.sparkSession, rows, "column string, outlier_count bigint, min double, max double")


