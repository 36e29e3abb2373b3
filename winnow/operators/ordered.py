"""Operators over a global row order, without a single-task window.

The table is cut into blocks of consecutive rows along a unique order column (number, date
or timestamp).  Block edges come from a merged quantile sketch, so blocks are even whatever
the distribution of the column.  Windows run per block; what crosses a block edge is carried
in a table with one row per block.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import c, is_date, is_numeric, num, require
from ..functions.gather import bounded_rows
from ..functions.keys import attach
from ..functions.stats import stats_row

BLOCK_ROWS = 1_000_000
SKETCH_GROUPS = 256
FIRST_BLOCKS = 1000
MAX_BLOCKS = 1_000_000


def _order_number(df: DataFrame, order: str) -> Column:
    if is_date(df, order):
        return F.unix_micros(c(order).cast("timestamp")).cast("double")
    if is_numeric(df, order):
        x = c(order).cast("double")
        return F.when(~F.isnan(x), x)
    raise ValueError(f"order column {order} must be a number, date or timestamp")


def _sketched_edges(keys: DataFrame, blocks: int, by: str | None = None) -> list[float]:
    """Edges that cut ``k`` (within each group of ``by``) into even blocks.

    Sketches are merged in two levels, so that no task has to merge one per input split."""
    group = [by] if by else []
    part = (keys.groupBy(*group, (F.spark_partition_id() % SKETCH_GROUPS).alias("g"))
            .agg(F.kll_sketch_agg_double("k", F.lit(4096)).alias("s")))
    probs = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    merged = part.groupBy(*group).agg(F.kll_merge_agg_double("s").alias("s"), F.min("g").alias("g"))
    rows = bounded_rows(merged.select(F.kll_sketch_get_quantile_double("s", probs).alias("e")))  # one row per group
    return sorted({x for r in rows for x in r["e"]})


def _cut(df: DataFrame, edges: list[float]) -> DataFrame:
    b = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="_ord", outputCol="_block", handleInvalid="keep")
    # rows without an order value come first, as they do in the windows
    return b.transform(df).withColumn("_block", F.when(F.col("_ord").isNull(), F.lit(-1)).otherwise(c("_block").cast("int")))


def blocked(df: DataFrame, order: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_block``: consecutive ranges of the order column with about ``block_rows`` rows each.

    A sketch resolves about a thousand blocks; where more are needed, each of those is cut
    again by a sketch of its own."""
    return _blocked(df, order, block_rows)[0]


def _blocked(df: DataFrame, order: str, block_rows: int) -> tuple[DataFrame, bool]:
    """``blocked``, and whether there is more than one block, so that anything can cross an edge."""
    require(df, order)
    key = _order_number(df, order)
    n = stats_row(df, {"n": F.count(F.lit(1))})["n"]
    blocks = math.ceil(n / max(block_rows, n / MAX_BLOCKS)) if n else 1
    if blocks <= 1:
        return df.withColumn("_block", F.lit(0)), False
    src = df.withColumn("_ord", key)
    keys = src.select(F.col("_ord"), F.col("_ord").alias("k")).where("k is not null")
    edges = _sketched_edges(keys, min(blocks, FIRST_BLOCKS))
    if blocks > FIRST_BLOCKS:
        first = _cut(keys, edges)
        edges = sorted({*edges, *_sketched_edges(first, math.ceil(blocks / FIRST_BLOCKS), by="_block")})
    return _cut(src, edges).drop("_ord"), True


def _win(order: str):
    return Window.partitionBy("_block").orderBy(c(order))


def _edges(b: DataFrame, **aggs: Column) -> DataFrame:
    """One row per block."""
    return b.groupBy("_block").agg(*[a.alias(k) for k, a in aggs.items()])


def _before():
    """All earlier blocks; runs over a table with one row per block."""
    return Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def with_row_index(df: DataFrame, order: str, out: str = "row_index", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """0-based position of every row in the global order."""
    b = blocked(df, order, block_rows)
    offs = _edges(b, _n=F.count(F.lit(1))).select(
        F.col("_block"), F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_off"))
    b = b.withColumn("_rn", F.row_number().over(_win(order)))
    return (b.join(F.broadcast(offs), "_block")  # one row per block
            .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("bigint")).drop("_block", "_off", "_rn"))


def with_neighbours(df: DataFrame, order: str, cols: dict[str, Column], nxt: bool = False,
                    block_rows: int = BLOCK_ROWS, keep_block: bool = False) -> DataFrame:
    """Add ``_prev_<name>`` (and ``_next_<name>``): the expressions on the adjacent rows of the order."""
    b, many = _blocked(df, order, block_rows)
    b = b.withColumns({f"_x_{k}": x for k, x in cols.items()})
    w = _win(order)
    pack = F.struct(*[F.col(f"_x_{k}") for k in cols])
    j = b.withColumns({"_p": F.lag(pack).over(w), "_q": F.lead(pack).over(w) if nxt else F.lit(None), "_rn": F.row_number().over(w)})
    if many:
        e = _edges(b, _last=F.max_by(pack, c(order)), _first=F.min_by(pack, c(order)))
        by_block = Window.orderBy("_block")
        e = e.select("_block", F.lag("_last").over(by_block).alias("_in"), F.lead("_first").over(by_block).alias("_out"))
        j = j.join(F.broadcast(e), "_block")  # one row per block
    else:
        j = j.withColumns({x: F.when(F.lit(False), pack) for x in ("_in", "_out")})
    new = {}
    for k in cols:
        new[f"_prev_{k}"] = F.when(F.col("_p").isNotNull(), F.col("_p")[f"_x_{k}"]).otherwise(F.col("_in")[f"_x_{k}"])
        if nxt:
            new[f"_next_{k}"] = F.when(F.col("_q").isNotNull(), F.col("_q")[f"_x_{k}"]) \
                .otherwise(F.col("_out")[f"_x_{k}"])
    new["_is_first"] = F.col("_p").isNull() & F.col("_in").isNull()
    out = j.withColumns(new).drop("_p", "_q", "_in", "_out", "_rn", *[f"_x_{k}" for k in cols])
    return out if keep_block else out.drop("_block")


def diff_previous(df: DataFrame, column: str, order: str, out: str = "diff", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Difference to the previous non-null value; rows without a value are left out."""
    x = num(df, column)
    d = with_neighbours(df.where(x.isNotNull()), order, {"v": x}, block_rows=block_rows)
    return d.withColumn(out, x - F.col("_prev_v")).drop("_prev_v", "_is_first")


def with_streaks(df: DataFrame, column: str, order: str, out: str = "streak", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Length of the run of equal values each (non-null) row belongs to."""
    x = num(df, column)
    d = with_neighbours(df.where(x.isNotNull()), order, {"v": x}, block_rows=block_rows, keep_block=True)
    start = F.when(F.col("_is_first") | ~x.eqNullSafe(F.col("_prev_v")), 1).otherwise(0)
    d = d.withColumn("_s", start)
    offs = _edges(d, _n=F.sum("_s")).select("_block", F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_off"))
    run = F.sum("_s").over(_win(order).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_run", run).join(F.broadcast(offs), "_block").withColumn("_run", F.col("_run") + F.col("_off"))
    d = d.drop("_s", "_off", "_prev_v", "_is_first", "_block")
    sizes = d.groupBy("_run").agg(F.count(F.lit(1)).alias(out), F.count(F.lit(1)).alias("_rows"))
    return attach(d, sizes, ["_run"], "_rows").drop("_run")


def fill_forward(df: DataFrame, column: str, order: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Forward fill in order; leading gaps take the first value there is."""
    b = blocked(df, order, block_rows)
    x = c(column)
    e = _edges(b, _last=F.max_by(x, F.when(x.isNotNull(), c(order))),
               _first=F.min_by(x, F.when(x.isNotNull(), c(order))))
    e = e.select("_block", F.last("_last", ignorenulls=True).over(_before()).alias("_carry"))
    first = stats_row(df, {"f": F.min_by(x, F.when(x.isNotNull(), c(order)))})["f"]
    own = F.last(x, ignorenulls=True).over(_win(order).rowsBetween(Window.unboundedPreceding, 0))
    return (b.withColumn("_own", own).join(F.broadcast(e), "_block")  # one row per block
            .withColumn(column, F.coalesce(F.col("_own"), F.col("_carry"), F.lit(first)))
            .select(*[c(n) for n in df.columns]))


def median3(a: Column, b: Column, d: Column, middle=None) -> Column:
    """Median of up to three values, NULLs left out; ``middle`` gives the mean of two."""
    v = F.array_sort(F.array_compact(F.array(a, b, d)))
    low, high = F.get(v, F.lit(0)), F.get(v, F.lit(1))
    return (F.when(F.size(v) == 3, high)
            .when(F.size(v) == 2, (low + high) / 2 if middle is None else middle(low, high))
            .when(F.size(v) == 1, F.get(v, F.lit(0))))


def rolling_median(df: DataFrame, column: str, order: str, out: str | None = None,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Centred median over the row and its two neighbours."""
    x = num(df, column)
    d = with_neighbours(df, order, {"v": x}, nxt=True, block_rows=block_rows)
    return d.withColumn(out or column, median3(F.col("_prev_v"), x, F.col("_next_v"))) \
            .drop("_prev_v", "_next_v", "_is_first")


def date_gaps(df: DataFrame, column: str, days: int = 365) -> DataFrame:
    """(from_ts, to_ts, gap_days) for consecutive distinct times more than ``days`` days apart.

    Only the first and last time of every calendar month can border such a gap, so the ordered
    step runs over that small summary."""
    from ..functions.dates import as_date

    ts = as_date(df, column)
    m = (df.select(ts.alias("t")).where("t is not null").groupBy(F.trunc(F.to_date("t"), "month").alias("m"))
         .agg(F.min("t").alias("a"), F.max("t").alias("b")))
    g = m.withColumn("p", F.lag("b").over(Window.orderBy("a")))
    gap = F.floor((F.unix_micros("a") - F.unix_micros("p")) / F.lit(86400000000))
    return (g.select(F.col("p").alias("from_ts"), F.col("a").alias("to_ts"), gap.cast("bigint").alias("gap_days"))
            .where(F.col("gap_days") > days))

