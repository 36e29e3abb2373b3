"""Grouping, pivoting, sampling, row order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered, reshape, sample
from ..operators.profile import describe_numeric, distinct_sample, group_mean, scatter_points
from .base import DC, DE, dirty_customer, dirty_events, query, sql, table


@query("group_agg", sql("""
SELECT segment, age, round(sum(balance), 6) AS balance_sum, round(avg(balance), 6) AS balance_mean, count(balance) AS balance_count,
 min(balance) AS balance_min, max(balance) AS balance_max, round(stddev_samp(balance), 6) AS balance_std,
 round(median(balance), 6) AS balance_median, count(DISTINCT phone) AS phone_nunique
FROM dc WHERE segment IS NOT NULL GROUP BY segment, age""", DC))
def group_agg(spark, sf):
    d = reshape.group_agg(dirty_customer(spark, sf), ["segment", "age"], {
        "balance": ["sum", "mean", "count", "min", "max", "std", "median"], "phone": ["nunique"]})
    return d.withColumns({f"balance_{k}": F.round(f"balance_{k}", 6) for k in ("sum", "mean", "std", "median")})


_PIV = """SELECT l_returnflag, {} FROM lineitem GROUP BY l_returnflag"""


@query("pivot", _PIV.format("""coalesce(round(avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 4), 0) AS "F",
 coalesce(round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 4), 0) AS "O" """))
def pivot(spark, sf):
    d = reshape.pivot_table(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "mean")
    return d.select("l_returnflag", F.round("F", 4).alias("F"), F.round("O", 4).alias("O"))


@query("pivot_median", """
SELECT o_orderpriority, coalesce(median(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0) AS "F",
 coalesce(median(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 0) AS "O",
 coalesce(median(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 0) AS "P" FROM orders GROUP BY 1""")
def pivot_median(spark, sf):
    return reshape.pivot_table(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", "median")


@query("melt", """
SELECT o_orderkey, 'o_orderstatus' AS variable, o_orderstatus AS value FROM orders
UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders""")
def melt(spark, sf):
    return reshape.melt(table(spark, sf, "orders"), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query("transpose_small", """
SELECT 'count' AS key, CAST(count(l_discount) AS DOUBLE) AS l_discount, CAST(count(l_quantity) AS DOUBLE) AS l_quantity FROM lineitem
UNION ALL SELECT 'mean', round(avg(l_discount), 4), round(avg(l_quantity), 4) FROM lineitem
UNION ALL SELECT 'max', max(l_discount), max(l_quantity) FROM lineitem""")
def transpose_small(spark, sf):
    d = describe_numeric(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"])
    d = d.select("column", F.col("count").cast("double").alias("count"), "mean", "max")
    return reshape.transpose_small(d, "column")


@query("top_values", sql("""
SELECT "column", value, n FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS r FROM (
  SELECT 'segment' AS "column", segment AS value, count(*) AS n FROM dc WHERE segment IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'email', email, count(*) FROM dc GROUP BY 2)) WHERE r <= 5""", DC))
def top_values(spark, sf):
    return reshape.top_values(dirty_customer(spark, sf), ["segment", "email"], 5)


@query("top_values_share", """
SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share
FROM orders GROUP BY 2 ORDER BY n DESC, value LIMIT 12""")
def top_values_share(spark, sf):
    return reshape.top_values(table(spark, sf, "orders"), ["o_orderpriority"], 12, normalize=True)


_HIST = """
SELECT CAST(i AS INT) AS bin, lo + (hi - lo) * i / {b} AS bin_start, lo + (hi - lo) * (i + 1) / {b} AS bin_end,
 (SELECT count(*) FROM {t} WHERE least(floor(({x} - lo) / (hi - lo) * {b}), {b} - 1) = i) AS n
FROM (SELECT min({x}) AS lo, max({x}) AS hi FROM {t}), range({b}) r(i)"""


@query("histogram", f"SELECT bin, round(bin_start, 4) AS bin_start, round(bin_end, 4) AS bin_end, n FROM "
                    f"({_HIST.format(b=10, t='lineitem', x='l_extendedprice')})")
def histogram(spark, sf):
    h = reshape.histogram(table(spark, sf, "lineitem"), "l_extendedprice")
    return h.select("bin", F.round("bin_start", 4).alias("bin_start"), F.round("bin_end", 4).alias("bin_end"), "n")


@query("chart_group_mean", sql("""
SELECT segment AS label, round(avg(balance), 2) AS mean, count(balance) AS n FROM dc WHERE segment IS NOT NULL
GROUP BY 1""", DC))
def chart_group_mean(spark, sf):
    return group_mean(dirty_customer(spark, sf), "segment", "balance")


@query("chart_scatter", sql("SELECT CAST(age AS DOUBLE) AS x, balance AS y FROM dc WHERE balance IS NOT NULL ORDER BY md5(CAST(c_custkey AS VARCHAR)) LIMIT 100", DC))
def chart_scatter(spark, sf):
    return scatter_points(dirty_customer(spark, sf), "c_custkey", "age", "balance")


@query("chart_largest_groups", """SELECT l_suppkey AS label, round(avg(l_quantity), 2) AS mean, count(l_quantity) AS n FROM lineitem
GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 15""")
def chart_largest_groups(spark, sf):
    return group_mean(table(spark, sf, "lineitem"), "l_suppkey", "l_quantity", 15)


@query("distinct_values", "SELECT DISTINCT p_brand AS value FROM part ORDER BY 1 LIMIT 5")
def distinct_values(spark, sf):
    return distinct_sample(table(spark, sf, "part"), "p_brand", 5)


@query("concat_tables", """SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderkey AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS o_orderstatus, 0 AS part
FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, NULL, o_totalprice, o_orderpriority, o_orderstatus, 1 FROM orders WHERE o_orderkey % 5 = 0""")
def concat_tables(spark, sf):
    """Training and test rows put together: columns by name, different types, columns that one side lacks."""
    d = table(spark, sf, "orders")
    a = d.where("o_orderkey % 5 <> 0").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderkey").alias("code"))
    b = d.where("o_orderkey % 5 = 0").select(F.col("o_totalprice").cast("float").cast("double").alias("x"), F.col("o_orderpriority").alias("code"), "o_orderstatus",
                                             "o_totalprice", "o_orderkey").drop("x")
    return reshape.concat_tables(a, b, "part")


# ---------------------------------------------------------------- samples

def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


_OC = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders "


@query("sample_head", _OC + "ORDER BY o_orderkey LIMIT 100")
def sample_head(spark, sf):
    return sample.head(_orders(spark, sf), "o_orderkey", 100)


@query("sample_tail", _OC + "ORDER BY o_orderkey DESC LIMIT 100")
def sample_tail(spark, sf):
    return sample.tail(_orders(spark, sf), "o_orderkey", 100)


@query("sample_systematic", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i,
 count(*) OVER () // 120 AS step FROM orders) WHERE i % step = 0 AND i < 120 * step""")
def sample_systematic(spark, sf):
    return sample.systematic(_orders(spark, sf), "o_orderkey", 120)


@query("sample_random", """SELECT CAST(least(250, count(*)) AS INT) AS n, CAST(least(250, count(DISTINCT o_orderkey)) AS INT) AS keys, true AS known FROM orders""")
def sample_random(spark, sf):
    """Exact size, no repeats, all rows from the table."""
    d = _orders(spark, sf)
    s = sample.random_sample(d, "o_orderkey", 250)
    j = s.join(d.select("o_orderkey", F.lit(1).alias("hit")), "o_orderkey", "left")
    return j.agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("o_orderkey").cast("int").alias("keys"),
                 (F.count("hit") == F.count(F.lit(1))).alias("known"))


@query("sample_random_rows")
def sample_random_rows(spark, sf):
    d = _orders(spark, sf)
    return sample.random_sample(d, "o_orderkey", sample.resolve_size(d.count(), frac=0.1))


@query("sample_stratified", """
SELECT o_orderstatus, greatest(1, CAST(round_even(count(*) * (500 / (SELECT count(*) FROM orders)), 0) AS BIGINT)) AS n
FROM orders GROUP BY 1""")
def sample_stratified(spark, sf):
    s = sample.stratified(_orders(spark, sf), "o_orderkey", "o_orderstatus", 500)
    return s.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("sample_info", "SELECT count(*) AS original_rows, CAST(100 AS BIGINT) AS sample_rows, round(100 / count(*), 4) AS sampling_ratio, 'head' AS method FROM orders")
def sample_info(spark, sf):
    d = _orders(spark, sf)
    return sample.sample_info(d, sample.head(d, "o_orderkey", 100), "head")


# ---------------------------------------------------------------- row order (small blocks, so that edges are crossed)

BLOCK = 1500


@query("row_index", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM events")
def row_index(spark, sf):
    return ordered.with_row_index(table(spark, sf, "events").select("event_id"), "event_id", block_rows=BLOCK)


@query("diff_previous", sql("""
SELECT event_id, value, round(value - lag(value) OVER (ORDER BY event_id), 6) AS diff FROM ev WHERE value IS NOT NULL""", DE))
def diff_previous(spark, sf):
    d = ordered.diff_previous(dirty_events(spark, sf).select("event_id", "value"), "value", "event_id", block_rows=BLOCK)
    return d.select("event_id", "value", F.round("diff", 6).alias("diff"))


@query("streaks", sql("""
SELECT event_id, value, count(*) OVER (PARTITION BY run) AS streak FROM (SELECT event_id, value,
  sum(CASE WHEN value IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS run FROM
  (SELECT event_id, value, lag(value) OVER (ORDER BY event_id) AS p FROM ev WHERE value IS NOT NULL))""", DE))
def streaks(spark, sf):
    return ordered.with_streaks(dirty_events(spark, sf).select("event_id", "value"), "value", "event_id", block_rows=BLOCK)


@query("rolling_median3", sql("""
SELECT event_id, round(median(value) OVER (ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS value FROM ev""", DE))
def rolling_median3(spark, sf):
    d = ordered.rolling_median(dirty_events(spark, sf).select("event_id", "value"), "value", "event_id", block_rows=BLOCK)
    return d.withColumn("value", F.round("value", 6))


@query("fill_ffill", sql("""
SELECT event_id, coalesce(last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM ev""", DE))
def fill_ffill(spark, sf):
    return ordered.fill_forward(dirty_events(spark, sf).select("event_id", "value"), "value", "event_id", block_rows=BLOCK)


_GAPPY = "CASE WHEN year(o_orderdate) % 3 = 1 THEN NULL ELSE o_orderdate END"


@query("date_gaps", f"""
SELECT strftime(p, '%Y-%m-%d') AS from_day, strftime(t, '%Y-%m-%d') AS to_day, date_diff('day', p, t) AS gap_days FROM (
 SELECT t, lag(t) OVER (ORDER BY t) AS p FROM (SELECT DISTINCT {_GAPPY} AS t FROM orders) WHERE t IS NOT NULL)
WHERE date_diff('day', p, t) > 365""")
def date_gaps(spark, sf):
    d = table(spark, sf, "orders").select(F.expr(_GAPPY).alias("day"))
    g = ordered.date_gaps(d, "day")
    return g.select(F.date_format("from_ts", "yyyy-MM-dd").alias("from_day"),
                    F.date_format("to_ts", "yyyy-MM-dd").alias("to_day"), "gap_days")
