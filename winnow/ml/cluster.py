"""Clustering, cluster metrics, projections, density clustering."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import c, num
from ..functions.keys import attach
from ..functions.stats import exact_quantiles, rows_to_df, stats_row
from ..operators.encode import sorted_index
from ..operators.neighbors import LeafIndex, _locations
from ..session import cut_lineage, spread

SEED = 42


def standardised(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(key, cols filled with medians, features scaled to mean 0 and deviation 1)."""
    med = {n: q[0] or 0.0 for n, q in exact_quantiles(df, cols, [0.5]).items()}
    d = df.select(c(key), *[F.coalesce(num(df, n), F.lit(med[n])).alias(n) for n in cols])
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="_raw"),
                            StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)])
    return pipe.fit(d).transform(d).drop("_raw")


def _estimator(algorithm: str, k: int):
    if algorithm == "kmeans":
        return KMeans(k=k, seed=SEED, maxIter=50)
    if algorithm == "gmm":
        return GaussianMixture(k=k, seed=SEED, maxIter=100)
    if algorithm == "bisecting":
        return BisectingKMeans(k=k, seed=SEED)
    raise ValueError(f"unknown algorithm {algorithm!r}")


def cluster(df: DataFrame, key: str, cols: Sequence[str], algorithm: str = "kmeans", k: int = 3) -> DataFrame:
    """(key, cols, features, cluster)."""
    s = standardised(df, key, cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = _estimator(algorithm, k).fit(s)
    finally:
        s.unpersist()
    return model.transform(s).withColumnRenamed("prediction", "cluster")


def append_labels(df: DataFrame, labels: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """The table with one more column, matched by key."""
    return df.join(labels.select(c(key), c(column).alias(name)), key, "left")


def cluster_sizes(df: DataFrame, cols: Sequence[str], label: str = "cluster") -> DataFrame:
    """(cluster, n, pct, mean of every column)."""
    total = df.count()
    return (df.groupBy(c(label).alias("cluster"))
            .agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c(n)), 3).alias(f"{n}_mean") for n in cols])
            .withColumn("pct", F.round(F.col("n") / F.lit(float(max(total, 1))) * 100, 1)))


def cluster_metrics(df: DataFrame, cols: Sequence[str], label: str = "cluster") -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz scores; noise (-1) is left out."""
    d = df.where(c(label) != -1)
    cent = d.groupBy(c(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c(n)).alias(f"_m_{n}") for n in cols])
    cent = cut_lineage(cent)
    j = attach(d.withColumn("_l", c(label)), cent.withColumn("_rows", F.col("_n")), ["_l"], "_rows")
    sq = sum(((c(n) - c(f"_m_{n}")) ** 2 for n in cols[1:]), (c(cols[0]) - c(f"_m_{cols[0]}")) ** 2)
    spread = cent.join(j.groupBy("_l").agg(F.avg(F.sqrt(sq)).alias("_s"), F.sum(sq).alias("_w")), "_l")
    rows = spread.collect()  # one row per cluster
    k, n = len(rows), sum(r["_n"] for r in rows)
    if k < 2 or n <= k:
        return rows_to_df(df.sparkSession, [(k, 0.0, 0.0)], METRIC_SCHEMA)
    mid = {m: sum(r[f"_m_{m}"] * r["_n"] for r in rows) / n for m in cols}
    worst = []
    for a in rows:
        best = 0.0
        for b in rows:
            if a["_l"] != b["_l"]:
                dist = math.sqrt(sum((a[f"_m_{m}"] - b[f"_m_{m}"]) ** 2 for m in cols))
                best = max(best, (a["_s"] + b["_s"]) / dist if dist else 0.0)
        worst.append(best)
    between = sum(r["_n"] * sum((r[f"_m_{m}"] - mid[m]) ** 2 for m in cols) for r in rows)
    within = sum(r["_w"] for r in rows)
    ch = (between / (k - 1)) / (within / (n - k)) if within else 1.0
    return rows_to_df(df.sparkSession, [(k, sum(worst) / k, ch)], METRIC_SCHEMA)


METRIC_SCHEMA = "clusters int, davies_bouldin double, calinski_harabasz double"


def silhouette(df: DataFrame, label: str = "cluster") -> float:
    """Silhouette with squared Euclidean distances."""
    d = df.select("features", c(label).cast("double").alias("prediction"))
    return ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(d)


def elbow_curve(df: DataFrame, key: str, cols: Sequence[str], top: int = 8) -> DataFrame:
    """(k, inertia, silhouette) for k = 2..top."""
    n = df.count()
    s = spread(standardised(df, key, cols), key, n).persist(StorageLevel.MEMORY_AND_DISK)

    def fit(k: int) -> tuple[int, float, float]:
        model = KMeans(k=k, seed=SEED, maxIter=50).fit(s)
        return k, model.summary.trainingCost, silhouette(model.transform(s).withColumnRenamed("prediction", "cluster"))

    try:
        s.count()  # kept before the fits, which run side by side
        with ThreadPool(4) as pool:
            rows = pool.map(fit, range(2, max(2, min(top, n - 1)) + 1), chunksize=1)
    finally:
        s.unpersist()
    return rows_to_df(df.sparkSession, rows, "k int, inertia double, silhouette double")


def cluster_board(df: DataFrame, key: str, cols: Sequence[str], k: int = 3, eps: float | None = 1.5) -> DataFrame:
    """All algorithms ranked by silhouette."""
    rows = []
    found = {a: cluster(df, key, cols, a, k) for a in ("kmeans", "gmm", "bisecting")}
    if eps:
        s = standardised(df, key, cols)
        flat = s.select(c(key), "features", *[vector_to_array("features")[i].alias(n) for i, n in enumerate(cols)])
        lab = dbscan(flat, key, cols, eps, max(2, min(5, flat.count() // 10)))
        found["dbscan"] = append_labels(s, lab, key, "cluster", "cluster")
    for name, d in found.items():
        d = cut_lineage(d.select(c(key), "features", "cluster", *[vector_to_array("features")[i].alias(n) for i, n in enumerate(cols)]))
        n = d.where("cluster <> -1").select("cluster").distinct().count()
        sil = silhouette(d) if d.select("cluster").distinct().count() > 1 else 0.0
        m = cluster_metrics(d, cols).first()
        rows.append((name, n, sil, m["davies_bouldin"], m["calinski_harabasz"]))
    rows.sort(key=lambda r: -r[2])
    return rows_to_df(df.sparkSession, [(i, *r) for i, r in enumerate(rows, 1)],
                      "rank int, model string, clusters int, silhouette double, davies_bouldin double, calinski_harabasz double")


def pca_2d(df: DataFrame, key: str, cols: Sequence[str], points: int | None = None) -> DataFrame:
    """(key, x, y, explained_1, explained_2): projection on the first two principal components.

    With ``points``, only that many rows by smallest key hash, for a plot."""
    s = standardised(df, key, cols)
    model = PCA(k=2, inputCol="features", outputCol="_pca").fit(s)
    e = [float(v) for v in model.explainedVariance]
    v = vector_to_array("_pca")
    out = model.transform(s).select(c(key), v[0].alias("x"), v[1].alias("y"), F.lit(e[0]).alias("explained_1"),
                                    F.lit(e[1]).alias("explained_2"))
    if points is not None:
        from ..operators.sample import random_sample

        out = random_sample(out, key, points)
    return out


# ---------------------------------------------------------------- connected components

def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b); the component is its smallest node.

    Alternates the large-star and small-star steps, which need few rounds even on long chains.
    Each round is materialised, and minima are attached with hot nodes spread out."""
    e = edges.select(c("a"), c("b")).where("a <> b")
    nodes = edges.select(c("a").alias("node")).union(edges.select(c("b").alias("node"))).distinct()
    nodes = cut_lineage(nodes)
    e = cut_lineage(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("_rows"))
        large = attach(both, least, ["u"], "_rows").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_rows"))
        small = attach(large, low, ["u"], "_rows")
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut_lineage(e.where("u <> v").distinct())
        mark = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == last:
            break
        last = mark
    root = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


# ---------------------------------------------------------------- DBSCAN

MAX_DIMS = 4


def _near_offsets(dims: int) -> list[list[int]]:
    """Steps to cells that can hold a point within eps (cell side eps / sqrt(dims)), without the cell itself."""
    reach = math.ceil(math.sqrt(dims))
    out = []
    for o in itertools.product(range(-reach, reach + 1), repeat=dims):
        if any(o) and sum(max(abs(i) - 1, 0) ** 2 for i in o) <= dims:
            out.append(list(o))
    return out


def _dist2(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _box_gap2(al: str, ah: str, bl: str, bh: str) -> Column:
    """Smallest squared distance between two boxes."""
    g = F.zip_with(F.zip_with(al, bh, lambda x, y: x - y), F.zip_with(bl, ah, lambda x, y: x - y),
                   lambda p, q: F.greatest(p, q, F.lit(0.0)))
    return F.aggregate(g, F.lit(0.0), lambda s, v: s + v * v)


def _box_span2(al: str, ah: str, bl: str, bh: str) -> Column:
    """Largest squared distance between two boxes."""
    g = F.zip_with(F.zip_with(ah, bl, lambda x, y: x - y), F.zip_with(bh, al, lambda x, y: x - y),
                   lambda p, q: F.greatest(F.abs(p), F.abs(q)))
    return F.aggregate(g, F.lit(0.0), lambda s, v: s + v * v)


def _boxes(points: DataFrame, dims: int, side: float, level: int) -> DataFrame:
    """(cell, sub, parent, lo, hi): tight boxes of the points in the sub-cells of a level."""
    def at(lv):
        w = side / 2 ** lv
        return F.transform("x", lambda v: F.floor(v / F.lit(w)).cast("bigint"))

    g = points.groupBy("cell", at(level).alias("sub"), at(max(level - 1, 0)).alias("parent")).agg(
        *[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(dims) for k, f in (("l", F.min), ("h", F.max))])
    return g.select("cell", "sub", "parent", F.array(*[F.col(f"l{i}") for i in range(dims)]).alias("lo"),
                    F.array(*[F.col(f"h{i}") for i in range(dims)]).alias("hi"))


def _dense_links(points: DataFrame, dims: int, side: float, eps2: float, offsets: list[list[int]]) -> DataFrame:
    """Pairs of neighbouring dense cells with two points within eps.

    Pairs of tight boxes are settled by their smallest and largest distance; undecided ones are
    halved again.  No point pairs are formed, however full the cells are."""
    steps = F.array(*[F.array(*[F.lit(i).cast("bigint") for i in o]) for o in offsets if o > [0] * dims])
    b0 = cut_lineage(_boxes(points, dims, side, 0))
    left = b0.select(F.col("cell").alias("a"), F.col("sub").alias("sa"), F.col("lo").alias("al"), F.col("hi").alias("ah"))
    right = b0.select(F.col("cell").alias("b"), F.col("sub").alias("sb"), F.col("lo").alias("bl"), F.col("hi").alias("bh"))
    to = left.withColumn("b", F.explode(F.transform(steps, lambda o: F.zip_with(F.col("a"), o, lambda x, y: x + y))))
    pairs = to.join(right, "b")
    found = None
    level = 0
    while True:
        judged = cut_lineage(pairs.withColumns({"near": _box_gap2("al", "ah", "bl", "bh"),
                                                "far": _box_span2("al", "ah", "bl", "bh")}).where(F.col("near") <= eps2))
        yes = judged.where(F.col("far") <= eps2).select("a", "b").distinct()
        yes = cut_lineage(yes)
        found = yes if found is None else found.union(yes)
        open_ = judged.where(F.col("far") > eps2).join(yes, ["a", "b"], "left_anti").select("a", "sa", "b", "sb")
        open_ = cut_lineage(open_)
        if open_.isEmpty():
            return found
        level += 1
        busy = open_.select(F.col("a").alias("cell")).union(open_.select(F.col("b").alias("cell"))).distinct()
        sub = cut_lineage(_boxes(points.join(busy, "cell", "left_semi"), dims, side, level))
        left = sub.select(F.col("cell").alias("a"), F.col("parent").alias("sa"), F.col("sub").alias("na"),
                          F.col("lo").alias("al"), F.col("hi").alias("ah"))
        right = sub.select(F.col("cell").alias("b"), F.col("parent").alias("sb"), F.col("sub").alias("nb"),
                           F.col("lo").alias("bl"), F.col("hi").alias("bh"))
        pairs = open_.join(left, ["a", "sa"]).join(right, ["b", "sb"]).select(
            "a", F.col("na").alias("sa"), "al", "ah", "b", F.col("nb").alias("sb"), "bl", "bh")


def dbscan(df: DataFrame, key: str, cols: Sequence[str], eps: float = 1.5, min_points: int = 5) -> DataFrame:
    """(key, cluster): density clusters numbered from 0, noise -1.  Any number of columns.

    Cells of side eps/sqrt(d) make all points of a cell neighbours: a cell with ``min_points``
    rows is core as a whole and is treated as one node.  Only rows of sparser cells, of which
    each holds fewer than ``min_points``, are compared with the rows around them.  The cells around a cell grow as a power of
    the columns, so beyond four of them the leaves of a tree take the place of cells (``leaf_dbscan``)."""
    dims = len(cols)
    if not dims:
        raise ValueError("density clustering takes at least one column")
    if dims > MAX_DIMS:
        return leaf_dbscan(df, key, cols, eps, min_points)
    side, eps2 = eps / math.sqrt(dims), eps * eps * (1 + 1e-12)
    offsets = _near_offsets(dims)
    x = F.array(*[num(df, n) for n in cols])
    p = df.select(c(key).alias("k"), x.alias("x")).where(~F.exists("x", lambda v: v.isNull()))
    p = p.withColumn("cell", F.transform("x", lambda v: F.floor(v / F.lit(side)).cast("bigint")))
    sizes = p.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    p = cut_lineage(attach(p, sizes.withColumn("_rows", F.col("n")), ["cell"], "_rows"))
    dense, sparse = p.where(F.col("n") >= min_points), p.where(F.col("n") < min_points)

    all_steps = F.array(*[F.array(*[F.lit(i).cast("bigint") for i in o]) for o in [[0] * dims, *offsets]])
    probe = sparse.select(F.col("k").alias("pk"), F.col("x").alias("px"), F.col("cell").alias("pcell"),
                          F.explode(F.transform(all_steps, lambda o: F.zip_with("cell", o, lambda a, b: a + b))).alias("cell"))
    probe = cut_lineage(probe)
    hits = probe.join(p.select("k", "x", "cell"), "cell").where(_dist2("px", "x") <= eps2)
    count = hits.groupBy("pk").agg(F.count(F.lit(1)).alias("near"))
    core_sparse = cut_lineage(sparse.join(count.where(F.col("near") >= min_points), sparse["k"] == count["pk"])
                              .select("k", "x", "cell"))
    core = dense.select("k", "x", "cell").unionByName(core_sparse)

    links = _dense_links(dense, dims, side, eps2, offsets) if not dense.isEmpty() else None
    from_sparse = probe.join(core_sparse.select(F.col("k").alias("pk")), "pk", "left_semi") \
        .join(core.select("x", "cell"), "cell").where(_dist2("px", "x") <= eps2)
    cells = from_sparse.select(F.col("pcell").alias("a"), F.col("cell").alias("b")).distinct()
    loops = core.select(F.col("cell").alias("a"), F.col("cell").alias("b")).distinct()
    edges = cells.union(loops) if links is None else cells.union(loops).union(links)
    name = lambda n: F.array_join(c(n).cast("array<string>"), ",").alias(n)
    comp = cut_lineage(components(edges.select(name("a"), name("b"))))
    core = core.withColumn("node", F.array_join(F.col("cell").cast("array<string>"), ","))
    csize = core.groupBy("node").agg(F.count(F.lit(1)).alias("_rows"))
    core = attach(core, comp.join(csize, "node"), ["node"], "_rows").select("k", "x", "cell", "component")
    core = cut_lineage(core)
    edge_rows = probe.join(core_sparse.select(F.col("k").alias("pk")), "pk", "left_anti")
    border = (edge_rows.join(core.select("x", "cell", "component"), "cell").where(_dist2("px", "x") <= eps2)
              .groupBy(F.col("pk").alias("k")).agg(F.min("component").alias("component")))
    names = core.groupBy("component").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("_rows"))
    ids = sorted_index(names, "first", "cluster").select("component", "cluster", "_rows")
    labelled = attach(core.select("k", "component").unionByName(border), ids, ["component"], "_rows").select("k", "cluster")
    out = p.select("k").join(labelled, "k", "left")
    return out.select(F.col("k").alias(key), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def _near(q: np.ndarray, b: np.ndarray, eps2: float):
    """(rows of q, whether each is within reach of each row of b), a bounded block of distances at a time."""
    step = max(1, 4_000_000 // max(len(b), 1))
    for at in range(0, len(q), step):
        d = np.zeros((min(step, len(q) - at), len(b)))
        for j in range(b.shape[1]):
            gap = q[at:at + step, j, None] - b[None, :, j]
            d += gap * gap
        yield slice(at, at + len(d)), d <= eps2


def _counter(eps2: float):
    """Rows within reach of each visitor of a leaf."""
    def run(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        near = np.zeros(len(qs), dtype=np.int64)
        if len(qs) and len(bs):
            rows = bs["n"].to_numpy()
            for part, hit in _near(np.vstack(qs["loc"].to_numpy()), np.vstack(bs["loc"].to_numpy()), eps2):
                near[part] = hit @ rows
        return pd.DataFrame({"i": qs["i"], "near": near})

    return run


def _toucher(eps2: float):
    """Groups of a leaf that each visitor touches, each pair of groups once."""
    def run(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        found = set()
        if len(qs) and len(bs):
            mine, theirs = qs["who"].to_numpy(), bs["local"].to_numpy()
            names, at = np.unique(theirs, return_inverse=True)
            for part, hit in _near(np.vstack(qs["loc"].to_numpy()), np.vstack(bs["loc"].to_numpy()), eps2):
                touch = np.zeros((len(hit), len(names)), dtype=bool)
                rows, places = np.nonzero(hit)
                touch[rows, at[places]] = True
                rows, groups = np.nonzero(touch)
                found |= set(zip(mine[part][rows].tolist(), names[groups].tolist(), strict=True))
        return pd.DataFrame(sorted(found), columns=["a", "b"]).astype("int64")

    return run


def _linker(eps2: float):
    """Groups of a leaf that each visiting group touches.  A pair is settled by its first two locations within reach, so the
    distances formed do not grow with how full the groups are."""
    def run(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(qs) and len(bs):
            x, mine = np.vstack(qs["loc"].to_numpy()), qs["who"].to_numpy()
            y, theirs = np.vstack(bs["loc"].to_numpy()), bs["local"].to_numpy()
            middle = (y.min(axis=0) + y.max(axis=0)) / 2
            order = np.lexsort((np.abs(x - middle).sum(axis=1), mine))  # those that lie nearest first
            x, mine = x[order], mine[order]
            starts = np.flatnonzero(np.append(True, mine[1:] != mine[:-1])).tolist()
            for a, z in zip(starts, [*starts[1:], len(mine)], strict=True):
                left, at, size = np.ones(len(y), dtype=bool), a, 16
                while at < z and left.any():
                    hit = np.zeros(int(left.sum()), dtype=bool)
                    for _, near in _near(x[at:min(at + size, z)], y[left], eps2):
                        hit |= near.any(axis=0)
                    new = np.unique(theirs[left][hit])
                    found += [(int(mine[a]), int(g)) for g in new]
                    left &= ~np.isin(theirs, new)
                    at, size = at + size, size * 2
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def _leaf_groups(eps2: float):
    """The connected core locations of one leaf, named by their smallest id."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i", kind="stable")
        x, local = np.vstack(rows["loc"].to_numpy()), np.full(len(rows), -1)
        for start in range(len(rows)):
            if local[start] >= 0:
                continue
            local[start], front = start, np.array([start])
            while len(front):
                left = np.nonzero(local < 0)[0]
                reached = np.zeros(len(left), dtype=bool)
                for _, hit in _near(x[front], x[left], eps2):
                    reached |= hit.any(axis=0)
                front = left[reached]
                local[front] = start
        return rows[["i", "loc", "leaf"]].assign(local=rows["i"].to_numpy()[local])

    return run


def leaf_dbscan(df: DataFrame, key: str, cols: Sequence[str], eps: float, min_points: int) -> DataFrame:
    """(key, cluster): density clusters in any number of columns; a border row takes the smallest number it can have.

    Distinct locations are dealt to the leaves of a kd-tree; a location visits the leaves whose box lies within eps.  The first visit counts
    its neighbours, at home and, where these are too few, around; the core locations of a leaf are joined into groups there, and a second
    visit links groups of different leaves, each pair once, so no pairs of rows are formed.  The third gives border rows the groups they touch."""
    eps2 = eps * eps * (1 + 1e-12)
    locs = _locations(df, key, cols, 1).select("loc", "n", F.element_at("keys", 1).alias("first")).withColumn("i", F.monotonically_increasing_id())
    index = LeafIndex(cut_lineage(locs), len(cols))
    hosts = index.base.select("loc", "n", "leaf")
    # most are core by the rows of their own leaf; only the others count those of the leaves around
    near = cut_lineage(index.meet(index.base.select("i", "loc", F.col("leaf").alias("to")), hosts, _counter(eps2), "i bigint, near bigint"))
    few = near.where(F.col("near") < min_points)
    away = cut_lineage(index.visits(index.base.join(few, "i").select("i", "loc", "leaf"), eps).where("to <> leaf"))
    more = index.meet(away.select("i", "loc", "to"), hosts, _counter(eps2), "i bigint, near bigint")
    core = near.where(F.col("near") >= min_points).select("i").union(
        few.union(more).groupBy("i").agg(F.sum("near").alias("near")).where(F.col("near") >= min_points).select("i"))
    core = cut_lineage(core)
    groups = cut_lineage(index.base.join(core, "i").select("i", "loc", "leaf").groupBy("leaf").applyInPandas(
        _leaf_groups(eps2), "i bigint, loc array<double>, leaf int, local bigint"))
    homes = groups.select("loc", "local", "leaf")
    abroad = index.visits(groups.select(F.col("local").alias("who"), "loc", "leaf"), eps).where("to <> leaf").select("who", "loc", "to")
    links = index.meet(cut_lineage(abroad), homes, _linker(eps2), "a bigint, b bigint").distinct()
    loops = groups.select(F.col("local").alias("a"), F.col("local").alias("b")).distinct()
    comp = cut_lineage(components(links.union(loops)))
    edge = index.visits(index.base.join(core, "i", "left_anti").select(F.col("i").alias("who"), "loc", "leaf"), eps).select("who", "loc", "to")
    border = index.meet(cut_lineage(edge), homes, _toucher(eps2), "a bigint, b bigint").select(F.col("a").alias("i"), F.col("b").alias("local"))
    of = comp.select(F.col("node").alias("local"), "component")
    named = groups.join(of, "local").join(index.base.select("i", "first"), "i").groupBy("component").agg(F.min("first").alias("first"))
    ids = sorted_index(named, "first", "cluster").select("component", "cluster")
    known = groups.select("i", "local").union(border).join(of, "local").join(ids, "component").groupBy("i").agg(F.min("cluster").alias("cluster"))
    found = cut_lineage(index.base.join(known, "i").select("loc", "cluster", "n"))
    loc = F.array(*[num(df, n) for n in cols])
    rows = df.select(c(key), loc.alias("loc")).where(~F.exists("loc", lambda v: v.isNull()))
    return attach(rows, found, ["loc"], "n").select(c(key), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def anomaly_board(df: DataFrame, key: str, cols: Sequence[str], contamination: float = 0.05) -> DataFrame:
    """Isolation forest and local outlier factor: rows flagged at the same contamination."""
    from ..operators.forest import isolation_forest
    from ..operators.neighbors import local_outlier_factor

    share = min(max(contamination, 0.01), 0.5)
    n = df.count()
    rows = []
    f = isolation_forest(df, key, cols, share)
    rows.append(("Isolation Forest", stats_row(f, {"k": F.count(F.when(F.col("is_outlier"), 1))})["k"]))
    lof = cut_lineage(local_outlier_factor(df, key, cols))
    cut = exact_quantiles(lof, ["lof"], [1 - share])["lof"][0]
    rows.append(("Local Outlier Factor (LOF)", stats_row(lof, {"k": F.count(F.when(F.col("lof") > cut, 1))})["k"]))
    rows.sort(key=lambda r: r[1])
    return rows_to_df(df.sparkSession, [(i, m, k, round(k / max(n, 1) * 100, 2), n, share) for i, (m, k) in enumerate(rows, 1)],
                      "rank int, model string, anomaly_count bigint, anomaly_pct double, total_rows bigint, contamination double")
