"""Exact k nearest neighbours without a cross join.

Rows are first reduced to distinct locations, of each of which only the k+1 smallest keys can
ever be among anyone's k nearest.  Locations are cut into the leaves of a kd-tree (its splits
come from a bounded sample and only decide where work is done).  Every leaf finds neighbours
among its own locations; a location then visits just those other leaves whose box lies within
the distance found so far.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import c, num
from ..functions.keys import attach
from ..session import cut_lineage

LEAF_ROWS = 4000
SAMPLE_ROWS = 20_000
VISITORS = 20_000


def _key_type(df: DataFrame, key: str) -> str:
    """Integer keys are carried as bigint, all others in their own type."""
    t = dict(df.dtypes)[key]
    return "bigint" if t in ("tinyint", "smallint", "int", "bigint") else t


def _complete(df: DataFrame, cols: Sequence[str], *more) -> DataFrame:
    """The rows with complete coordinates, with ``loc`` and its hash, which is quicker to sort by."""
    loc = F.array(*[num(df, n) for n in cols])
    return df.select(*more, loc.alias("loc")).where(~F.exists("loc", lambda v: v.isNull())).withColumn("_h", F.xxhash64("loc"))


def _sizes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(loc, n): distinct coordinates and how many rows share them."""
    return _complete(df, cols).groupBy("_h", "loc").agg(F.count(F.lit(1)).alias("n"))


def _smallest_keys(df: DataFrame, key: str, cols: Sequence[str], copies: int) -> DataFrame:
    """(loc, keys): distinct coordinates and the smallest keys of their rows.

    The rank filter is applied per partition before the shuffle, so a location that holds a
    large part of the table sends only ``copies`` rows from each."""
    rows = _complete(df, cols, c(key).cast(_key_type(df, key)).alias("k"))
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("_h", "loc").orderBy("k"))).where(F.col("r") <= copies)
    return few.groupBy("_h", "loc").agg(F.sort_array(F.collect_list("k")).alias("keys"))  # at most `copies` per location


def _locations(df: DataFrame, key: str, cols: Sequence[str], copies: int) -> DataFrame:
    """(loc, keys, n): distinct coordinates, the smallest keys of their rows, and how many rows share them."""
    return _smallest_keys(df, key, cols, copies).join(_sizes(df, cols), ["_h", "loc"]).drop("_h")


def _tree(points: np.ndarray, leaves: int) -> list[tuple]:
    """Balanced kd-splits as (dimension, value, left, right) nodes, leaves as (-1, leaf, 0, 0)."""
    nodes: list[tuple] = []
    count = 0

    def grow(p: np.ndarray, want: int) -> int:
        nonlocal count
        at = len(nodes)
        nodes.append(())
        spread = p.max(axis=0) - p.min(axis=0) if len(p) else np.zeros(points.shape[1])
        dim = int(spread.argmax())
        if want <= 1 or len(p) < 2 or spread[dim] == 0:
            nodes[at] = (-1, float(count), 0, 0)
            count += 1
            return at
        cut = float(np.median(p[:, dim]))
        if cut == p[:, dim].max():
            cut = float(p[:, dim][p[:, dim] < cut].max())
        left = p[:, dim] <= cut
        a = grow(p[left], want // 2)
        b = grow(p[~left], want - want // 2)
        nodes[at] = (dim, cut, a, b)
        return at

    grow(points, leaves)
    return nodes


def _coordinates(p: int) -> list[Column]:
    """The numbers of ``loc`` one by one, which reach Python without a list for every row."""
    return [F.get("loc", F.lit(i)) for i in range(p)]


def _leaf_of(nodes: list[tuple], p: int) -> Column:
    dims = [t[0] for t in nodes]
    vals = [t[1] for t in nodes]
    lefts = [t[2] for t in nodes]
    rights = [t[3] for t in nodes]

    def leaf(*xs: pd.Series) -> pd.Series:
        import numpy as np
        import pandas as pd

        if not len(xs[0]):
            return pd.Series([], dtype="int32")
        x = np.column_stack([v.to_numpy(dtype=float) for v in xs])
        dim, val, lt, rt = (np.asarray(v) for v in (dims, vals, lefts, rights))
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = dim[at] >= 0
            if not inner.any():
                return pd.Series(val[at].astype("int32"))
            idx = np.nonzero(inner)[0]
            go_left = x[idx, dim[at[idx]]] <= val[at[idx]]
            at[idx] = np.where(go_left, lt[at[idx]], rt[at[idx]])

    return F.pandas_udf(leaf, "int")(*_coordinates(p))


def _boxes(nodes: list[tuple], ends: list, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowest and highest corner and number of base locations of every node of the tree, from those of its leaves."""
    lo, hi, n = np.full((len(nodes), p), np.inf), np.full((len(nodes), p), -np.inf), np.zeros(len(nodes), dtype=np.int64)
    at = {int(t[1]): i for i, t in enumerate(nodes) if t[0] < 0}
    for r in ends:
        i = at[r["leaf"]]
        lo[i, r["dim"]], hi[i, r["dim"]], n[i] = r["lo"], r["hi"], r["n"]
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parent
        if nodes[i][0] >= 0:
            a, z = nodes[i][2:]
            lo[i], hi[i], n[i] = np.minimum(lo[a], lo[z]), np.maximum(hi[a], hi[z]), n[a] + n[z]
    return lo, hi, n


def _visits(nodes: list[tuple], boxes: tuple[np.ndarray, np.ndarray, np.ndarray], k: int):
    """Leaves other than its own that a location must visit: those whose box lies within its radius.

    All locations of a batch go down the tree together, and only into nodes whose box they reach.  A location that
    found fewer than ``k`` at home takes the far corner of the smallest node around its leaf with ``k`` locations."""
    lo, hi, n = boxes
    up = {child: i for i, t in enumerate(nodes) if t[0] >= 0 for child in t[2:]}
    leaf_at = {int(t[1]): i for i, t in enumerate(nodes) if t[0] < 0}
    inner = [(t[2], t[3]) if t[0] >= 0 else None for t in nodes]
    leaf_id = [int(t[1]) for t in nodes]

    def others(radius: pd.Series, home: pd.Series, *xs: pd.Series) -> pd.Series:
        import numpy as np
        import pandas as pd

        if not len(home):
            return pd.Series([], dtype="object")
        x, far, own = np.column_stack([v.to_numpy(dtype=float) for v in xs]), radius.to_numpy(dtype=float).copy(), home.to_numpy()
        for leaf in np.unique(own[np.isinf(far)]):
            at = leaf_at[int(leaf)]
            while n[at] < k and at in up:
                at = up[at]
            rows = np.nonzero(np.isinf(far) & (own == leaf))[0]
            if n[at] >= k:
                gap = np.maximum(np.abs(x[rows] - lo[at]), np.abs(x[rows] - hi[at]))
                far[rows] = np.sqrt((gap * gap).sum(axis=1))
        out: list[list[int]] = [[] for _ in range(len(x))]
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if not n[at]:
                continue
            gap = np.maximum(np.maximum(lo[at] - x[rows], x[rows] - hi[at]), 0.0)
            rows = rows[np.sqrt((gap * gap).sum(axis=1)) <= far[rows] * (1 + 1e-12)]
            if not len(rows):
                continue
            if inner[at]:
                todo += [(child, rows) for child in inner[at]]
                continue
            for i in rows[own[rows] != leaf_id[at]].tolist():
                out[i].append(leaf_id[at])
        return pd.Series(out)

    return others


def _search(k: int):
    """Distances and keys nearest to ``queries`` among ``base``, no farther than ``far``, a group of close queries at a time; ties go
    to the location with the smallest key.  Self-contained, so that it travels to executors by value.

    The base locations nearest to the middle of a group bound how far its queries have to look.  What may lie within is found from
    products of matrices, with a margin for their rounding; distances are then taken of those pairs alone."""
    def run(queries, base):
        import numpy as np

        base = base.sort_values("first", kind="stable")
        b = np.vstack(base["loc"].to_numpy())
        keys = base["keys"].to_numpy()
        lone = [x[0] for x in keys] if all(len(x) == 1 for x in keys) else None
        q = np.vstack(queries["loc"].to_numpy())
        far = queries["far"].to_numpy(dtype=float)
        ds, ks = [None] * len(q), [None] * len(q)
        plain = np.isfinite(b).all() and np.isfinite(q).all()
        most = max(1, min(64, 1_000_000 // max(len(b), 1)))
        some = min(len(b), max(256, 4 * k))
        todo = [np.arange(len(q))]

        def squares(x, y):
            """Squared distances up to rounding, and a bound of the rounding."""
            xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
            return xx[:, None] + yy[None] - 2 * (x @ y.T), 1e-12 * (xx.max() + yy.max())

        while todo:
            rows = todo.pop()
            part = q[rows]
            if len(rows) > most:  # halves along the widest side
                place = np.argpartition(part[:, int((part.max(axis=0) - part.min(axis=0)).argmax())], len(rows) // 2)
                todo += [rows[place[:len(rows) // 2]], rows[place[len(rows) // 2:]]]
                continue
            reach, at = far[rows] * (1 + 1e-9), np.arange(len(b))
            if plain:
                middle = part.mean(axis=0)
                x, y = part - middle, b - middle
                if len(b) > k and not np.isfinite(reach).all():
                    near = np.argpartition((y * y).sum(axis=1), some - 1)[:some]
                    d, off = squares(x, y[near])
                    reach = np.minimum(reach, np.sqrt(np.maximum(np.partition(d, k - 1, axis=1)[:, k - 1] + off, 0.0)) * (1 + 1e-9))
                if np.isfinite(reach).all():  # what lies beyond the distance already found changes no list
                    at = np.flatnonzero(((b >= (part - reach[:, None]).min(axis=0)) & (b <= (part + reach[:, None]).max(axis=0))).all(axis=1))
            if plain and len(at) and np.isfinite(reach).all():
                d, off = squares(x, y[at])
                i, j = np.nonzero(d <= (reach * reach * (1 + 1e-9) + off)[:, None])
            else:
                i, j = np.repeat(np.arange(len(rows)), len(at)), np.tile(np.arange(len(at)), len(rows))
            j = at[j]
            dist = np.zeros(len(i))
            for c in range(b.shape[1]):
                diff = part[i, c] - b[j, c]
                dist += diff * diff
            dist = np.sqrt(dist)  # ties are ties of the distance itself, here and when lists are merged
            within = ~(dist > reach[i])
            i, j, dist = i[within], j[within], dist[within]
            place = np.lexsort((j, dist, i))
            i, j, dist = i[place], j[place], dist[place]
            ends = np.searchsorted(i, np.arange(len(rows) + 1)).tolist()
            dist, j = dist.tolist(), j.tolist()
            for n, row in enumerate(rows.tolist()):
                first, last = ends[n], min(ends[n + 1], ends[n] + k)
                if lone is not None:
                    ds[row], ks[row] = dist[first:last], [lone[x] for x in j[first:last]]
                    continue
                got = [(dist[x], key) for x in range(first, last) for key in keys[j[x]]]
                got.sort()
                ds[row], ks[row] = [x for x, _ in got[:k]], [y for _, y in got[:k]]
        return ds, ks

    return run


def _neighbour_lists(queries: DataFrame, index: LeafIndex, k: int, p: int) -> DataFrame:
    """(loc, cands): the k nearest (distance, key) of every query location, nearest first."""
    b, nodes, ids = index.base, index.nodes, index.ids
    key_type = b.schema["keys"].dataType.elementType.simpleString()
    axes = [f"x{i}" for i in range(p)]
    flat = [x.alias(n) for n, x in zip(axes, _coordinates(p), strict=True)]
    search = _search(k)

    def nearest(key, qs, bs):
        import pandas as pd

        if not len(qs) or not len(bs):
            return pd.DataFrame({n: [] for n in ["leaf", *axes, "d", "key"]})
        qs, bs = qs.reset_index(drop=True), bs.reset_index(drop=True)
        d, keys = search(qs.assign(loc=list(qs[axes].to_numpy(dtype=float))), bs.assign(loc=list(bs[axes].to_numpy(dtype=float))))
        return qs[axes].assign(leaf=key[0], d=d, key=keys)

    def cogroup(qs: DataFrame, sizes: DataFrame) -> DataFrame:
        """Search queries in the leaf they are sent to, in portions of at most about VISITORS."""
        parts = sizes.select("leaf", F.greatest(F.lit(1), F.ceil(F.col("visits") / VISITORS)).cast("int").alias("parts"))
        q = qs.join(F.broadcast(parts), "leaf")  # one row per leaf
        q = q.withColumn("part", F.pmod(F.xxhash64("loc"), F.col("parts")).cast("int"))
        bb = b.join(F.broadcast(parts), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return (q.select("leaf", "part", *flat, "far").groupBy("leaf", "part")
                .cogroup(bb.select("leaf", "part", *flat, "keys", "first").groupBy("leaf", "part"))
                .applyInPandas(nearest, ", ".join(["leaf int", *[f"{n} double" for n in axes], f"d array<double>, key array<{key_type}>"]))
                .select("leaf", F.array(*axes).alias("loc"), F.arrays_zip("d", "key").alias("cands")))

    # a leaf of the tree without any base location sends its queries to the next leaf that has some
    used = [(d, float(ids[min(bisect_left(ids, v), len(ids) - 1)]), a, z) if d < 0 else (d, v, a, z) for d, v, a, z in nodes]
    own = cut_lineage(queries.select("loc").withColumns({"leaf": _leaf_of(used, p), "far": F.lit(float("inf"))}))
    first = cut_lineage(cogroup(own, own.groupBy("leaf").agg(F.count(F.lit(1)).alias("visits"))))
    if len(ids) == 1:
        return first.select("loc", "cands")
    visit = F.pandas_udf(_visits(nodes, index.boxes, k), "array<int>")
    radius = F.when(F.size("cands") >= k, F.element_at("cands", k)["d"]).otherwise(F.lit(float("inf")))
    trips = first.select("loc", radius.alias("far"), F.explode(visit(radius, "leaf", *_coordinates(p))).alias("to"))
    trips = cut_lineage(trips.withColumnRenamed("to", "leaf"))
    more = cogroup(trips, trips.groupBy("leaf").agg(F.count(F.lit(1)).alias("visits")))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("cands"))), 1, k)  # k per visited leaf
    return first.unionByName(more).groupBy(F.xxhash64("loc").alias("_h"), "loc").agg(best.alias("cands")).drop("_h")


class LeafIndex:
    """Locations in the leaves of a kd-tree, for visits within a fixed distance."""

    def __init__(self, base: DataFrame, p: int) -> None:
        n = base.count()
        leaves = max(1, math.ceil(n / LEAF_ROWS))
        self.nodes = [(-1, 0.0, 0, 0)]
        if leaves > 1:
            rows = base.select("loc").orderBy(F.xxhash64("loc")).limit(SAMPLE_ROWS).collect()  # bounded, splits only
            self.nodes = _tree(np.array([r["loc"] for r in rows], dtype=float), min(leaves, len(rows)))
        #: the locations with their ``leaf``
        self.base = cut_lineage(base.withColumn("leaf", _leaf_of(self.nodes, p)))
        ends = self.base.select("leaf", F.posexplode("loc").alias("dim", "v")).groupBy("leaf", "dim").agg(
            F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).collect()  # leaves times dimensions
        self.boxes = _boxes(self.nodes, ends, p)
        self.p = p
        #: the leaves that hold locations
        self.ids = sorted({r["leaf"] for r in ends})

    def visits(self, rows: DataFrame, radius: float) -> DataFrame:
        """``rows`` once for each leaf ``to`` whose box lies within ``radius`` of their ``loc``, their own leaf included."""
        visit = F.pandas_udf(_visits(self.nodes, self.boxes, 1), "array<int>")
        return rows.withColumn("to", F.explode(visit(F.lit(float(radius)), F.lit(-1), *_coordinates(self.p))))

    def meet(self, visitors: DataFrame, hosts: DataFrame, run, schema: str) -> DataFrame:
        """``run`` on the visitors (with ``to``) and the hosts (with ``leaf``) of each leaf, at most about VISITORS at a time."""
        sizes = visitors.groupBy(F.col("to").alias("leaf")).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / VISITORS)).cast("int").alias("parts"))
        sizes = cut_lineage(sizes)
        q = visitors.withColumnRenamed("to", "leaf").join(F.broadcast(sizes), "leaf")  # one row per leaf
        q = q.withColumn("part", F.pmod(F.xxhash64("loc"), F.col("parts")).cast("int")).drop("parts")
        b = hosts.join(F.broadcast(sizes), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        b = b.toDF(*b.columns)  # visitors and hosts often come from one table
        return q.groupBy("leaf", "part").cogroup(b.groupBy("leaf", "part")).applyInPandas(run, schema)


def knn_index(base: DataFrame, base_key: str, cols: Sequence[str], need: int) -> LeafIndex:
    """The locations of ``base`` with their ``need`` smallest keys, for searches of up to ``need`` neighbours."""
    locs = cut_lineage(_smallest_keys(base.where(c(base_key).isNotNull()), base_key, cols, need))
    return LeafIndex(locs.select("loc", "keys", F.col("keys")[0].alias("first")), len(cols))


def knn(queries: DataFrame, base: DataFrame, query_key: str, base_key: str, cols: Sequence[str], k: int,
        exclude_self: bool = False, index: LeafIndex | None = None) -> DataFrame:
    """(query_key, neighbour, distance, rank) over rows with complete coordinates.

    Keys may be of any type that can be ordered; base rows without one are no neighbours.  Ties go to the smaller key.  ``exclude_self`` drops the row whose key equals the query's.
    ``index`` is that of ``knn_index`` over ``base``, where several searches share it."""
    need = k + 1 if exclude_self else k
    index = knn_index(base, base_key, cols, need) if index is None else index
    q = cut_lineage(_sizes(queries, cols))
    lists = _neighbour_lists(q, index, need, len(cols)).withColumn("_h", F.xxhash64("loc"))
    rows = _complete(queries, cols, c(query_key).alias("_q"))
    j = attach(rows, lists.join(q, ["_h", "loc"]).select("_h", "loc", "cands", "n"), ["_h", "loc"], "n")
    cands = F.col("cands")
    if exclude_self:
        cands = F.filter(cands, lambda x: x["key"] != F.col("_q").cast(_key_type(base, base_key)))
    out = j.select("_q", F.posexplode(F.slice(cands, 1, k)).alias("pos", "x"))
    return out.select(F.col("_q").alias(query_key), F.col("x.key").alias("neighbour"), F.col("x.d").alias("distance"),
                      (F.col("pos") + 1).alias("rank"))


def local_outlier_factor(df: DataFrame, key: str, cols: Sequence[str], k: int | None = None) -> DataFrame:
    """(key, lof, is_outlier): density against that of the neighbours; above 1.5 is an outlier."""
    n = df.count()
    k = min(20, max(2, n - 1)) if k is None else k
    nn = cut_lineage(knn(df, df, key, key, cols, k, exclude_self=True))
    reach = nn.groupBy(c(key)).agg(F.max("distance").alias("kdist"))
    d = nn.join(reach.select(c(key).alias("neighbour"), "kdist"), "neighbour")
    lrd = d.groupBy(c(key)).agg((F.lit(1.0) / (F.avg(F.greatest("distance", "kdist")) + 1e-10)).alias("lrd"))
    lrd = cut_lineage(lrd)
    other = nn.join(lrd.select(c(key).alias("neighbour"), F.col("lrd").alias("o")), "neighbour")
    mean = other.groupBy(c(key)).agg(F.avg("o").alias("m"))
    out = mean.join(lrd, key).select(c(key), (F.col("m") / F.col("lrd")).alias("lof"))
    return out.withColumn("is_outlier", F.col("lof") > 1.5)


def knn_predict(train: DataFrame, rows: DataFrame, train_key: str, key: str, cols: Sequence[str], target: str,
                k: int = 5, classify: bool = False, index: LeafIndex | None = None) -> DataFrame:
    """(key, prediction): mean target of the k nearest training rows, or their most frequent class
    (the smallest one on ties)."""
    nn = knn(rows, train, key, train_key, cols, k, index=index)
    t = train.select(c(train_key).alias("neighbour"), c(target).alias("_y"))
    j = nn.join(t, "neighbour")
    best = F.mode("_y", True) if classify else F.avg("_y")  # k values per row
    return j.groupBy(c(key)).agg(best.alias("prediction"))


def smote(df: DataFrame, key: str, label: str, cols: Sequence[str], k: int = 5, ratio: float = 1.8, least: int = 6,
          seed: int = 42) -> DataFrame:
    """Original rows plus synthetic ones for every class far smaller than the largest.

    Each synthetic row lies between a row and one of its k nearest of the same class; which one
    and how far along follow from a hash, so the result is reproducible."""
    base = df.select(c(key).cast(_key_type(df, key)).alias(key), *[num(df, n).alias(n) for n in cols], c(label))
    sizes = {r[label]: r["n"] for r in base.groupBy(c(label)).agg(F.count(F.lit(1)).alias("n")).collect()}
    top, small = max(sizes.values()), min(sizes.values())
    out = base.withColumn("synthetic", F.lit(False))
    if small < least or top / small <= ratio:
        return out
    for value, n in sizes.items():
        if n == top:
            continue
        mine = base.where(c(label) == F.lit(value))
        kk = min(k, n - 1)
        nn = knn(mine, mine, key, key, cols, kk, exclude_self=True)
        extra, rest = divmod(top - n, n)
        # `rest` rows get one copy more; take them by smallest hash
        from .sample import random_sample

        plus = random_sample(mine.select(c(key)), key, rest, seed).withColumn("_more", F.lit(1)) if rest else None
        m = mine if plus is None else mine.join(plus, key, "left")
        copies = F.lit(extra) + (F.coalesce(F.col("_more"), F.lit(0)) if plus is not None else F.lit(0))
        m = m.withColumn("_i", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))))
        h = F.xxhash64(c(key), F.col("_i"), F.lit(seed))
        m = m.withColumns({"_rank": (F.pmod(h, F.lit(kk)) + 1).cast("int"),
                           "_gap": F.pmod(F.shiftrightunsigned(h, 8), F.lit(1 << 30)) / F.lit(float(1 << 30))})
        pick = nn.select(c(key), F.col("rank").alias("_rank"), "neighbour")
        far = mine.select(c(key).alias("neighbour"), *[c(x).alias(f"_b_{x}") for x in cols])
        s = m.join(pick, [key, "_rank"]).join(far, "neighbour")
        new = s.select(F.lit(None).cast(_key_type(df, key)).alias(key),
                       *[(c(x) + F.col("_gap") * (F.col(f"_b_{x}") - c(x))).alias(x) for x in cols], c(label),
                       F.lit(True).alias("synthetic"))
        out = out.unionByName(new)
    return out
