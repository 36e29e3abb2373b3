"""Encoding, scaling, binning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as op
from ..operators import reshape, scale
from .base import DC, dirty_customer, query, sql, table

_LAB = """lab AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM
  (SELECT DISTINCT coalesce(segment, 'Missing') AS v FROM dc))"""
_JOIN = "FROM dc JOIN lab ON lab.v = coalesce(dc.segment, 'Missing')"


@query("encode_label", sql(f"SELECT c_custkey, code AS segment {_JOIN}", DC, _LAB))
def encode_label(spark, sf):
    return op.encode_label(dirty_customer(spark, sf).select("c_custkey", "segment"), "segment")


@query("encode_ordinal", sql("""
SELECT c_custkey, CAST(coalesce(code, -1) AS DOUBLE) AS segment FROM dc LEFT JOIN
 (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)) k
 ON k.v = coalesce(dc.segment, 'Missing')""", DC))
def encode_ordinal(spark, sf):
    """Codes learnt from the clean table, so the dirty spellings are unknown."""
    known = op.label_map(table(spark, sf, "customer"), "c_mktsegment")
    return op.encode_ordinal(dirty_customer(spark, sf).select("c_custkey", "segment"), "segment", known)


@query("encode_binary", sql(f"""SELECT c_custkey, CAST(code & 1 AS INT) AS segment_bin_0, CAST((code >> 1) & 1 AS INT) AS segment_bin_1,
 CAST((code >> 2) & 1 AS INT) AS segment_bin_2, CAST((code >> 3) & 1 AS INT) AS segment_bin_3 {_JOIN}""", DC, _LAB))
def encode_binary(spark, sf):
    return op.encode_binary(dirty_customer(spark, sf).select("c_custkey", "segment"), "segment")


@query("encode_onehot", """SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'N' AS INT) AS l_returnflag_N,
 CAST(l_returnflag = 'R' AS INT) AS l_returnflag_R FROM lineitem""")
def encode_onehot(spark, sf):
    return op.encode_onehot(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag")


_FREQ = "fr AS (SELECT segment AS v, count(*) / (SELECT count(segment) FROM dc) AS share FROM dc WHERE segment IS NOT NULL GROUP BY 1)"


@query("encode_frequency", sql("SELECT c_custkey, round(coalesce(share, 0), 6) AS segment FROM dc LEFT JOIN fr ON v = segment", DC, _FREQ))
def encode_frequency(spark, sf):
    d = op.encode_frequency(dirty_customer(spark, sf).select("c_custkey", "segment"), "segment")
    return d.withColumn("segment", F.round("segment", 6))


@query("encode_target", sql("""
SELECT c_custkey, round(coalesce(m, (SELECT avg(balance) FROM dc)), 4) AS segment FROM dc LEFT JOIN
 (SELECT segment AS v, avg(balance) AS m FROM dc WHERE segment IS NOT NULL GROUP BY 1) ON v = segment""", DC))
def encode_target(spark, sf):
    d = op.encode_target(dirty_customer(spark, sf).select("c_custkey", "segment", "balance"), "segment", "balance")
    return d.select("c_custkey", F.round("segment", 4).alias("segment"))


@query("encode_auto", "SELECT o_orderkey, CAST(o_orderstatus = 'O' AS INT) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS INT) AS o_orderstatus_P FROM orders")
def encode_auto(spark, sf):
    return op.encode_auto(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


# ---------------------------------------------------------------- scaling

_FIL = "fl AS (SELECT c_custkey, coalesce(balance, (SELECT median(balance) FROM dc)) AS x FROM dc)"


def _scale(method):
    def run(spark, sf):
        d, _ = scale.scale_features(dirty_customer(spark, sf).select("c_custkey", "balance"), ["balance"], method)
        return d.select("c_custkey", F.round("balance", 6).alias("balance"))
    return run


query("scale_minmax", sql("SELECT c_custkey, round((x - lo) / (hi - lo), 6) AS balance FROM fl, (SELECT min(x) AS lo, max(x) AS hi FROM fl)",
                          DC, _FIL))(_scale("minmax"))
query("scale_standard", sql("SELECT c_custkey, round((x - m) / s, 6) AS balance FROM fl, (SELECT avg(x) AS m, stddev_pop(x) AS s FROM fl)",
                            DC, _FIL))(_scale("standard"))
query("scale_robust", sql("""SELECT c_custkey, round((x - m) / (b - a), 6) AS balance FROM fl,
 (SELECT median(x) AS m, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM fl)""", DC, _FIL))(_scale("robust"))


@query("scale_log_sqrt", sql("""SELECT c_custkey, round(ln(1 + greatest(coalesce(balance, 0), 0)), 6) AS lg,
 round(sqrt(greatest(coalesce(balance, 0), 0)), 6) AS sq FROM dc""", DC))
def scale_log_sqrt(spark, sf):
    d = dirty_customer(spark, sf).select("c_custkey", F.col("balance").alias("lg"), F.col("balance").alias("sq"))
    d = scale.scale_features(d, ["lg"], "log")[0]
    d = scale.scale_features(d, ["sq"], "sqrt")[0]
    return d.select("c_custkey", F.round("lg", 6).alias("lg"), F.round("sq", 6).alias("sq"))


@query("scale_inverse", "SELECT l_orderkey, l_linenumber, round(l_quantity, 4) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice FROM lineitem")
def scale_inverse(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    s, params = scale.scale_features(d, ["l_quantity", "l_extendedprice"], "robust")
    back = scale.inverse_scale(s, params)
    return back.select("l_orderkey", "l_linenumber", F.round("l_quantity", 4).alias("l_quantity"),
                       F.round("l_extendedprice", 4).alias("l_extendedprice"))


# ---------------------------------------------------------------- bins

_BIN = """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN {x} < e[1] THEN NULL WHEN {x} <= e[2] THEN 0 WHEN {x} <= e[3] THEN 1
 WHEN {x} <= e[4] THEN 2 WHEN {x} <= e[5] THEN 3 WHEN {x} <= e[6] THEN 4 END AS INT) AS bin FROM lineitem, ({edges})"""


def _bins(column, method, bins):
    def run(spark, sf):
        d = reshape.bin_numeric(table(spark, sf, "lineitem"), column, method, bins)
        return d.select("l_orderkey", "l_linenumber", F.col(f"{column}_bin").alias("bin"))
    return run


query("bin_width", _BIN.format(x="l_extendedprice", edges="""SELECT [lo - (hi - lo) * 0.001, lo + (hi - lo) * 0.2, lo + (hi - lo) * 0.4,
 lo + (hi - lo) * 0.6, lo + (hi - lo) * 0.8, hi] AS e FROM (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)"""))(
    _bins("l_extendedprice", "equal_width", 5))
query("bin_freq", _BIN.format(x="l_extendedprice", edges="""SELECT quantile_cont(l_extendedprice, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e
 FROM lineitem"""))(_bins("l_extendedprice", "equal_frequency", 5))
query("bin_custom", _BIN.format(x="l_quantity", edges="SELECT [5.0, 10.0, 20.0, 30.0, 40.0, 50.0] AS e"))(
    _bins("l_quantity", "custom", [5, 10, 20, 30, 40, 50]))


@query("bin_labels", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 10 THEN 'small' WHEN l_quantity <= 30 THEN 'medium' ELSE 'large' END AS size
FROM lineitem""")
def bin_labels(spark, sf):
    d = reshape.bin_numeric(table(spark, sf, "lineitem"), "l_quantity", "custom", [0, 10, 30, 50], ["small", "medium", "large"])
    return d.select("l_orderkey", "l_linenumber", F.col("l_quantity_binned").alias("size"))
