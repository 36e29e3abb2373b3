"""Statistics that feed literals into the next projection.

A *stats barrier* is one aggregate job whose single row comes back to the driver.
Nothing here brings rows of the table to the driver: results are bounded by the
number of columns, percentiles or histogram cells.
"""

from __future__ import annotations

import math
import weakref
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gather
from .core import c, num
from .gram import pair_moments

# Aggregates per job, to keep the generated code within JVM method limits.
CHUNK = 200
# From so many columns on, pairs of columns are counted by matrix products, not by an expression each.
GRAM_COLUMNS = 16
# Inputs at or below this plan size may use the buffering `percentile` aggregate,
# whose state holds one entry per distinct value in a single task.
SMALL_BYTES_CONF = "spark.winnow.exactQuantileBytes"
SMALL_BYTES = 1 << 20
CELLS = 4096


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df``; None where the client cannot see it."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return None


def _small(df: DataFrame) -> bool:
    limit = int(df.sparkSession.conf.get(SMALL_BYTES_CONF, str(SMALL_BYTES)))
    size = plan_bytes(df)
    return size is not None and size <= limit


def plain_join_ok(df: DataFrame, limit: int = 32 << 20) -> bool:
    """Whether a look-up is small enough to leave its join to the optimizer."""
    size = plan_bytes(df)
    return size is not None and size <= min(limit, int(df.sparkSession.conf.get(
        "spark.winnow.plainJoinBytes", str(limit))))


def spread(df: DataFrame, most_bytes: int = 1 << 30) -> DataFrame:
    """Small inputs, which often come as a single file split, dealt out to all cores.

    For work that costs much more per row than moving the row (pattern matching, repeated
    passes).  Large inputs have enough splits and are left alone."""
    if df in _DEALT:
        return df
    size = plan_bytes(df)
    if size is None or size > most_bytes:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


_DEALT: weakref.WeakSet = weakref.WeakSet()  # tables that ``dealt`` holds just now


@contextmanager
def dealt(df: DataFrame) -> Iterator[DataFrame]:
    """A table that several passes read: a small one is dealt to all cores and held in memory meanwhile."""
    some = df if df in _DEALT else spread(df)
    if some is df:
        yield df
        return
    some = some.persist()
    _DEALT.add(some)
    try:
        yield some
    finally:
        _DEALT.discard(some)
        some.unpersist()


def _merge_stats(df: DataFrame, payloads: list[dict[str, Column]]):
    """One row with the aggregates of all; Catalyst computes equal ones once."""
    columns = [a for p in payloads for a in p.values()]
    frame = df.agg(*[a.alias(f"s{i}") for i, a in enumerate(columns)])

    def read(rows: list) -> list[dict]:
        cells = iter(rows[0])
        return [{k: next(cells) for k in p} for p in payloads]

    return frame, read


gather.MERGERS["stats"] = _merge_stats


def stats_row(df: DataFrame, aggs: dict[str, Column]) -> dict:
    """Evaluate all aggregates in as few passes as the code-size limit allows."""
    out: dict = {}
    items = list(aggs.items())
    for at in range(0, len(items), CHUNK):
        out.update(gather.ask("stats", df, dict(items[at:at + CHUNK])))
    return out


# ---------------------------------------------------------------- quantiles

def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str] | dict[str, Column],
    ps: Sequence[float],
) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles of several columns.

    Small inputs use ``percentile``.  Beyond a checked size the ranks are located by
    histogram refinement: every pass counts at most ``CELLS`` cells per open interval
    (partial aggregation, tiny shuffle) and narrows each interval to the one cell that
    holds the wanted rank, until the cell holds a single value.
    """
    xs = dict(cols) if isinstance(cols, dict) else {n: num(df, n) for n in cols}
    if not xs:
        return {}
    names = list(xs)
    if _small(df.select(*xs.values())):
        arr = F.array(*[F.lit(float(p)) for p in ps])
        row = stats_row(df, {n: F.percentile(x, arr) for n, x in xs.items()})
        return {n: list(q) if q is not None else [None] * len(ps) for n, q in row.items()}
    if df in _DEALT:
        return _refined_quantiles(df, names, list(xs.values()), ps)
    with dealt(df.select(*[x.alias(f"x{i}") for i, x in enumerate(xs.values())])) as cells:
        return _refined_quantiles(cells, names, [F.col(f"x{i}") for i in range(len(names))], ps)


def _cell(v: Column, iv: dict) -> Column:
    """Monotone map of the interval onto 0..CELLS-1 (halved to avoid overflow)."""
    lo, hi = iv["lo"], iv["hi"]
    t = (v * 0.5 - lo * 0.5) / (hi * 0.5 - lo * 0.5)
    if iv["log"]:
        t = F.log1p(t * 2.0 ** 60) / math.log1p(2.0 ** 60)
    return F.least(F.floor(t * CELLS).cast("int"), F.lit(CELLS - 1))


def _merge_cells(df: DataFrame, payloads: list[list[tuple[Column, list[dict]]]]):
    """Counts of the cells of all open intervals, at most CELLS rows for each; an interval belongs to one column."""
    triples, ivs = [], 0
    for x, mine in (pair for p in payloads for pair in p):
        which = cell = None
        for iv in mine:
            cond = x.between(iv["lo"], iv["hi"])
            which = F.when(cond, F.lit(ivs)) if which is None else which.when(cond, F.lit(ivs))
            cell = F.when(cond, _cell(x, iv)) if cell is None else cell.when(cond, _cell(x, iv))
            ivs += 1
        triples += [which, cell, x]
    long = df.select(F.stack(F.lit(len(triples) // 3), *triples).alias("iv", "cell", "v")).where("iv is not null")
    frame = long.groupBy("iv", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))

    def read(rows: list) -> list[list[list]]:
        by: list[list] = [[] for _ in range(ivs)]
        for r in rows:
            by[r["iv"]].append((r["cell"], r["n"], r["lo"], r["hi"]))
        each = iter(by)
        return [[next(each) for _, mine in p for _ in mine] for p in payloads]

    return frame, read


gather.MERGERS["cells"] = _merge_cells


def _refined_quantiles(df: DataFrame, names: list[str], raw: list[Column], ps: Sequence[float]) -> dict:
    """Ranks are located among finite values; infinities are counted at either end."""
    inf = float("inf")
    xs = [F.when(F.abs(x) < F.lit(inf), x) for x in raw]
    head = stats_row(df, {(k, i): f for i, (r, x) in enumerate(zip(raw, xs, strict=True)) for k, f in (
        ("n", F.count(r)), ("below", F.count(F.when(r == F.lit(-inf), 1))), ("finite", F.count(x)),
        ("lo", F.min(x)), ("hi", F.max(x)))})
    want: dict[int, list] = {}
    found: dict[tuple[int, int], float] = {}
    todo = []
    for i in range(len(names)):
        n = head[("n", i)]
        if not n:
            continue
        spots = []
        for p in ps:
            h = (n - 1) * float(p)
            spots.append((math.floor(h), math.ceil(h), h))
        want[i] = spots
        first, last = head[("below", i)], head[("below", i)] + head[("finite", i)]
        ranks = sorted({r for a, b, _ in spots for r in (a, b)})
        found.update({(i, r): -inf if r < first else inf for r in ranks if not first <= r < last})
        inside = [r for r in ranks if first <= r < last]
        if inside:
            todo.append({"col": i, "lo": head[("lo", i)], "hi": head[("hi", i)], "base": first,
                         "n": head[("finite", i)], "ranks": inside, "log": False})
    while True:
        open_ivs = []
        for iv in todo:
            if iv["lo"] == iv["hi"]:
                found.update({(iv["col"], r): iv["lo"] for r in iv["ranks"]})
            else:
                open_ivs.append(iv)
        if not open_ivs:
            break
        hits: dict[int, list[int]] = {}  # the open intervals of each column
        for k, iv in enumerate(open_ivs):
            hits.setdefault(iv["col"], []).append(k)
        got = gather.ask("cells", df, [(xs[i], [open_ivs[k] for k in ks]) for i, ks in hits.items()])
        by_iv = dict(zip([k for ks in hits.values() for k in ks], got, strict=True))
        todo = []
        for k, iv in enumerate(open_ivs):
            cum = iv["base"]
            for _, n, lo, hi in sorted(by_iv[k]):
                mine = [r for r in iv["ranks"] if cum <= r < cum + n]
                if mine:
                    poor = n * 4 > iv["n"] and not iv["log"]
                    todo.append({"col": iv["col"], "lo": lo, "hi": hi, "base": cum, "n": n,
                                 "ranks": mine, "log": poor})
                cum += n
    out: dict = {}
    for i, name in enumerate(names):
        if i not in want:
            out[name] = [None] * len(ps)
            continue
        qs = []
        for a, b, h in want[i]:
            lo, hi = found[(i, a)], found[(i, b)]
            qs.append(lo if lo == hi else (b - h) * lo + (h - a) * hi)
        out[name] = qs
    return out


# ---------------------------------------------------------------- value counts, distinct, mode

def as_text(df: DataFrame, name: str) -> Column:
    """Text form used as a grouping value; -0.0 and 0.0 are one value."""
    t = dict(df.dtypes)[name]
    if t in ("double", "float"):
        return F.when(~F.isnan(c(name)), (c(name) + F.lit(0.0)).cast("string"))
    return c(name).cast("string")


def value_counts(df: DataFrame, cols: Sequence[str], digest: bool = False) -> DataFrame:
    """(column, value, n) for all given columns with one partially aggregated shuffle.

    ``digest`` replaces each value by its 128-bit hash, for callers that only need how many
    distinct values there are and not which."""
    def val(n):
        return text_digest(df, n) if digest else as_text(df, n)

    cells = F.stack(F.lit(len(cols)), *[y for n in cols for y in (F.lit(n), val(n))]).alias("column", "value")
    return (df.select(cells).where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


@dataclass(frozen=True)
class Values:
    """What counting the distinct non-null values of a column tells."""
    distinct: int = 0
    extra: int = 0        # cells beyond the first of each value
    repeated: int = 0     # cells of values that occur more than once
    least_repeated: object = None
    mode: object = None   # the most frequent value, the smallest of them
    most: int = 0         # how often it occurs
    last_mode: object = None  # the largest of the most frequent values


def _merge_values(df: DataFrame, payloads: list[dict[str, Column]]):
    """Values of all columns counted by one shuffle, pre-aggregated per value, so no task holds a column's whole value set."""
    asked = [x for p in payloads for x in p.values()]
    shapes = [f.dataType.simpleString() for f in df.select(*[x.alias(f"x{i}") for i, x in enumerate(asked)]).schema]
    once: dict[tuple[str, str], int] = {}  # several reports may ask for the same values
    at = [once.setdefault((str(x), t), len(once)) for x, t in zip(asked, shapes, strict=True)]
    xs, types = [asked[at.index(i)] for i in range(len(once))], [shapes[at.index(i)] for i in range(len(once))]
    kinds = sorted(set(types))
    cells = []
    for i, (x, t) in enumerate(zip(xs, types, strict=True)):
        if t in ("float", "double"):
            x = F.when(~F.isnan(x), x + F.lit(0.0).cast(t))  # -0.0 and 0.0 are one value
        cells += [F.when(x.isNotNull(), F.lit(i)), *[(x if t == k else F.lit(None)).cast(k) for k in kinds]]
    named = [f"v{j}" for j in range(len(kinds))]
    long = df.select(F.stack(F.lit(len(xs)), *cells).alias("column", *named)).where("column is not null")
    counts = long.groupBy("column", *named).agg(F.count(F.lit(1)).alias("n"))
    many = F.col("n") > 1
    frame = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("u"), F.sum("n").alias("n"), F.sum(F.when(many, F.col("n"))).alias("k"),
        F.min(F.when(many, F.struct(*named))).alias("e"), F.min(F.struct((-F.col("n")).alias("k"), *named)).alias("a"),
        F.max(F.struct("n", *named)).alias("z"))

    def one(i: int, r) -> Values:
        v = named[kinds.index(types[i])]
        return Values(r["u"], r["n"] - r["u"], r["k"] or 0, r["e"][v] if r["e"] else None, r["a"][v], -r["a"]["k"], r["z"][v])

    def read(rows: list) -> list[dict[str, Values]]:
        got = {r["column"]: r for r in rows}  # one row a column
        place = iter(at)
        return [{n: one(i, got[i]) if (i := next(place)) in got else Values() for n in p} for p in payloads]

    return frame, read


gather.MERGERS["values"] = _merge_values


def value_stats(df: DataFrame, cols: dict[str, Column]) -> dict[str, Values]:
    """Exact counts over the distinct values of each column."""
    return gather.ask("values", df, dict(cols)) if cols else {}


def text_digest(df: DataFrame, name: str) -> Column:
    """A value's text, or its 128-bit hash where that is shorter: enough to count how many values there are."""
    x = as_text(df, name)
    return F.when(F.length(x) > 32, F.md5(x)).otherwise(x)


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Exact number of distinct non-null values per column."""
    return {n: v.distinct for n, v in value_stats(df, {n: text_digest(df, n) for n in cols}).items()}


def maybe_few(df: DataFrame, cols: Sequence[str], limit: int) -> list[str]:
    """Columns a sketch cannot rule out to have at most ``limit`` distinct values.

    Twice the limit is far outside the sketch's error, and keeps ids and free text out of the
    exact count that follows."""
    got = stats_row(df, {n: F.approx_count_distinct(c(n), 0.05) for n in cols}) if cols else {}
    return [n for n in cols if got[n] <= 2 * limit + 10]


def few_values(df: DataFrame, cols: Sequence[str], limit: int) -> dict[str, list[str] | None]:
    """Sorted distinct values of each column that has at most ``limit`` of them, else None."""
    cols = list(cols)
    some = maybe_few(df, cols, limit)
    out: dict[str, list[str] | None] = {n: None for n in cols}
    if not some:
        return out
    got: dict[str, list[str]] = {n: [] for n in some}
    vals = value_counts(df, some).select("column", "value")
    for r in gather.bounded_rows(vals):  # the screen leaves a few times `limit` values per column
        got[r["column"]].append(r["value"])
    out.update({n: sorted(v) for n, v in got.items() if len(v) <= limit})
    return out


def modes_and_distinct(df: DataFrame, cols: dict[str, Column] | Sequence[str]) -> dict[str, tuple]:
    """(most frequent value, number of distinct values) per column; the smallest value wins ties."""
    xs = dict(cols) if isinstance(cols, dict) else {n: c(n) for n in cols}
    return {n: (v.mode, v.distinct) for n, v in value_stats(df, xs).items()}


def column_modes(df: DataFrame, cols: dict[str, Column] | Sequence[str]) -> dict:
    """Most frequent value per column, the smallest one on ties."""
    return {n: m for n, (m, _) in modes_and_distinct(df, cols).items()}


# ---------------------------------------------------------------- moments

def sample_skew(x: Column) -> Column:
    """Bias-corrected skewness; NULL below three values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows that have both values; NULL where one side is constant
    (the built-in divides by zero there, or by what rounding leaves of it)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def pair_correlations(df: DataFrame, xs: dict[str, Column], complete: bool = False) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of every pair: an expression each, or for many columns one matrix product a batch of rows."""
    names = list(xs)
    if len(names) >= GRAM_COLUMNS:
        m = pair_moments(df, list(xs.values()), complete)
        return {(a, b): m.correlation(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if i < j}
    if complete:
        df = df.select(*[x.alias(f"x{i}") for i, x in enumerate(xs.values())]).dropna()
        xs = {n: F.col(f"x{i}") for i, n in enumerate(names)}
    return stats_row(df, {(a, b): safe_corr(xs[a], xs[b]) for a, b in pairs(names)})


def correlations(df: DataFrame, cols: Sequence[str], complete: bool = False) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of every pair: pairwise-complete, or over complete rows only."""
    return pair_correlations(df, {n: num(df, n) for n in cols}, complete)


def covariances(df: DataFrame, xs: Sequence[Column]) -> tuple[int, list[float], list[list[float]]]:
    """(rows, means, population covariances) over the rows that have all of the given numbers."""
    p = len(xs)
    if p >= GRAM_COLUMNS:
        m = pair_moments(df, xs, complete=True)
        return int(m.n[0, 0]), m.mean.diagonal().tolist(), m.cov.tolist()
    d = df.select(*[x.alias(f"x{i}") for i, x in enumerate(xs)]).dropna()
    aggs = {"n": F.count(F.lit(1)), **{i: F.avg(f"x{i}") for i in range(p)}}
    aggs.update({(i, j): F.covar_pop(f"x{i}", f"x{j}") for i in range(p) for j in range(i, p)})
    got = stats_row(d, aggs)
    return got["n"], [got[i] or 0.0 for i in range(p)], [[got[min(i, j), max(i, j)] or 0.0 for j in range(p)] for i in range(p)]


# ---------------------------------------------------------------- chi-square quantile

def _lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma by series or continued fraction."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny = 1e-300
    b = x + 1 - a
    cc, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        cc = b + an / cc or tiny
        h *= d * cc
        if abs(d * cc - 1) < 1e-15:
            break
    return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, max(10.0, dof * 10.0)
    while _lower_gamma(dof / 2, hi / 2) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if _lower_gamma(dof / 2, mid / 2) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def rows_to_df(spark, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A report whose rows are already bounded by the number of columns or checks."""
    return spark.createDataFrame(list(rows), schema)


# ---------------------------------------------------------------- grouped quantiles

def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: Column, ps: Sequence[float]) -> DataFrame:
    """Exact quantiles per group as (keys, q: array).  NULL keys are dropped.

    Small inputs use the buffering aggregate.  Otherwise values are counted per
    (group, value) first and the ranks are narrowed cell by cell, so that a group holding a
    large part of the table is never gathered in one task."""
    keys = list(keys)
    src = df.select(*[c(k) for k in keys], value.cast("double").alias("_v")).dropna()
    if _small(df):
        return src.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in ps])).alias("q"))
    from ..session import cut_lineage

    counts = cut_lineage(src.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")))
    head = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_t"))
    h = [(F.col("_t") - 1) * F.lit(float(p)) for p in ps]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in h])))
    iv = head.select(*keys, F.explode(ranks).alias("_r"), "_lo", "_hi", F.lit(0).cast("bigint").alias("_base"),
                     F.col("_t").alias("_size"), F.lit(False).alias("_log"))
    from pyspark.sql import Window

    done: list[DataFrame] = []
    while True:
        iv = cut_lineage(iv)
        done.append(iv.where("_lo = _hi").select(*keys, "_r", F.col("_lo").alias("_x")))
        iv = iv.where("_lo < _hi")
        if iv.isEmpty():
            break
        t = (F.col("_v") * 0.5 - F.col("_lo") * 0.5) / (F.col("_hi") * 0.5 - F.col("_lo") * 0.5)
        t = F.when(F.col("_log"), F.log1p(t * 2.0 ** 60) / math.log1p(2.0 ** 60)).otherwise(t)
        cell = F.least(F.floor(t * CELLS).cast("int"), F.lit(CELLS - 1))
        # several ranks often share one interval: count its cells once
        spans = iv.groupBy(*keys, "_lo", "_hi", "_base", "_size", "_log").agg(F.collect_set("_r").alias("_rs"))
        hit = counts.join(spans, keys).where("_v between _lo and _hi")
        cells = (hit.groupBy(*keys, "_base", "_size", "_log", cell.alias("_cell"))
                 .agg(F.sum("_n").alias("_k"), F.min("_v").alias("_l"), F.max("_v").alias("_h"),
                      F.first("_rs").alias("_rs")))
        w = Window.partitionBy(*keys, "_base").orderBy("_cell")  # at most CELLS rows
        up = cells.withColumn("_end", F.col("_base") + F.sum("_k").over(w))
        inside = F.filter("_rs", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_k")))
        poor = (F.col("_k") * 4 > F.col("_size")) & ~F.col("_log")
        iv = up.select(*keys, F.explode(inside).alias("_r"), F.col("_l").alias("_lo"), F.col("_h").alias("_hi"),
                       (F.col("_end") - F.col("_k")).alias("_base"), F.col("_k").alias("_size"), poor.alias("_log"))
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    at = found.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("_r", "_x"))).alias("_at"))
    j = at.join(head.select(*keys, "_t"), keys)

    def q(x):
        lo, hi = F.floor(x), F.ceil(x)
        a, b = F.element_at("_at", lo), F.element_at("_at", hi)
        return F.when(lo == hi, a).otherwise((hi - x) * a + (x - lo) * b)

    return j.select(*keys, F.array(*[q(x) for x in h]).alias("q"))
