"""Projections and column operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns as op
from .base import (DC, DO, DT, dirty_customer, dirty_orders, date_texts, query, sq_date, sql, table)


def _cust(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("rename_column", "SELECT c_custkey, c_name AS customer_name, c_acctbal, c_mktsegment FROM customer")
def rename_column(spark, sf):
    return op.rename_column(_cust(spark, sf), "c_name", "customer_name")


@query("rename_snake", "SELECT c_custkey AS Customer_Key, c_name AS Full_Name, c_acctbal, c_mktsegment FROM customer")
def rename_snake(spark, sf):
    return op.rename_snake(_cust(spark, sf).withColumnsRenamed({"c_custkey": "Customer Key", "c_name": "Full Name"}))


@query("drop_column", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def drop_column(spark, sf):
    return op.drop_column(_cust(spark, sf), "c_acctbal")


@query("change_dtype", sql(f"""
SELECT o_orderkey, try_cast(amount_text AS BIGINT) AS amount_int, try_cast(amount_text AS DOUBLE) AS amount_float,
       CAST(flag AS VARCHAR) AS flag, strftime({sq_date('date_text')}, '%Y-%m-%d') AS day
FROM (SELECT DISTINCT * FROM ord) JOIN dt USING (o_orderkey)""", DO, DT))
def change_dtype(spark, sf):
    d = dirty_orders(spark, sf).distinct().join(date_texts(spark, sf), "o_orderkey")
    d = d.withColumns({"amount_int": F.col("amount_text"), "amount_float": F.col("amount_text"), "day": F.col("date_text")})
    for n, t in (("amount_int", "int"), ("amount_float", "float"), ("flag", "str"), ("day", "datetime")):
        d = op.change_dtype(d, n, t)
    return d.select("o_orderkey", "amount_int", "amount_float", "flag", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("convert_types", sql(f"""
SELECT o_orderkey, o_orderstatus, try_cast(amount_text AS DOUBLE) AS amount_text,
       strftime({sq_date('date_text')}, '%Y-%m-%d') AS date_text
FROM (SELECT DISTINCT * FROM ord) JOIN dt USING (o_orderkey)""", DO, DT))
def convert_types(spark, sf):
    d = dirty_orders(spark, sf).distinct().join(date_texts(spark, sf), "o_orderkey")
    d = op.convert_types(d.select("o_orderkey", "o_orderstatus", "amount_text", "date_text"))
    return d.withColumn("date_text", F.date_format("date_text", "yyyy-MM-dd"))


def _sparse(spark, sf):
    """Adds a column that is mostly sentinels and one that is mostly NULL."""
    return dirty_customer(spark, sf).withColumns({
        "mostly_na": F.expr("CASE WHEN c_custkey % 7 = 0 THEN name ELSE 'n/a' END"),
        "mostly_null": F.expr("CASE WHEN c_custkey % 10 = 0 THEN 1 END")})


@query("remove_empty_columns", sql("SELECT c_custkey, name, segment, round(balance, 4) AS balance, age, email, phone FROM dc", DC))
def remove_empty_columns(spark, sf):
    return op.remove_empty_columns(_sparse(spark, sf)).withColumn("balance", F.round("balance", 4))


@query("remove_empty_columns_native", sql("""SELECT c_custkey, age,
  CASE WHEN c_custkey % 7 = 0 THEN name ELSE 'n/a' END AS mostly_na FROM dc""", DC))
def remove_empty_columns_native(spark, sf):
    d = _sparse(spark, sf).select("c_custkey", "age", "mostly_na", "mostly_null")
    return op.remove_empty_columns(d, 80.0, sentinels=False, strict=True)


@query("remove_constant_columns", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def remove_constant_columns(spark, sf):
    return op.remove_constant_columns(_cust(spark, sf).withColumns({
        "unit": F.lit("EUR"), "half": F.expr("CASE WHEN c_custkey % 2 = 0 THEN 7 END")}))


@query("remove_constant_columns_null", """
SELECT c_custkey, c_name, c_acctbal, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 7 END AS half FROM customer""")
def remove_constant_columns_null(spark, sf):
    return op.remove_constant_columns(_cust(spark, sf).withColumns({
        "unit": F.lit("EUR"), "half": F.expr("CASE WHEN c_custkey % 2 = 0 THEN 7 END")}), null_is_value=True)


@query("merge_cols_prefer", sql("""
SELECT a.c_custkey, a.merged AS first_wins, b.merged AS second_wins FROM
 (SELECT c_custkey, coalesce(segment, email) AS merged FROM dc) a JOIN
 (SELECT c_custkey, coalesce(email, segment) AS merged FROM dc) b USING (c_custkey)""", DC))
def merge_cols_prefer(spark, sf):
    d = dirty_customer(spark, sf).select("c_custkey", "segment", "email", F.col("segment").alias("s2"), F.col("email").alias("e2"))
    d = op.merge_columns(d, "segment", "email", "prefer_first", "first_wins")
    return op.merge_columns(d, "s2", "e2", "prefer_second", "second_wins")


@query("merge_cols_concat", sql("""
SELECT c_custkey, nullif(regexp_replace(coalesce(name, '') || ' ' || coalesce(segment, ''), '^\\s+|\\s+$', '', 'g'), '')
  AS label FROM dc""", DC))
def merge_cols_concat(spark, sf):
    d = dirty_customer(spark, sf).select("c_custkey", "name", "segment")
    return op.merge_columns(d, "name", "segment", "concatenate", "label")


@query("merge_cols_sum", sql("SELECT c_custkey, round(coalesce(balance, 0) + coalesce(age, 0), 4) AS total FROM dc", DC))
def merge_cols_sum(spark, sf):
    d = op.merge_columns(dirty_customer(spark, sf).select("c_custkey", "balance", "age"), "balance", "age", "sum", "total")
    return d.withColumn("total", F.round("total", 4))


@query("merge_cols_avg", sql("""
SELECT c_custkey, round(CASE WHEN balance IS NULL THEN age ELSE (balance + age) / 2 END, 4) AS mean FROM dc""", DC))
def merge_cols_avg(spark, sf):
    d = op.merge_columns(dirty_customer(spark, sf).select("c_custkey", "balance", "age"), "balance", "age", "average", "mean")
    return d.withColumn("mean", F.round("mean", 4))


@query("concat_columns", sql("""
SELECT c_custkey, coalesce(segment, '') || '|' || coalesce(phone, '') || '|' || CAST(age AS VARCHAR) AS label FROM dc""", DC))
def concat_columns(spark, sf):
    d = op.concat_columns(dirty_customer(spark, sf), ["segment", "phone", "age"], "|", "label")
    return d.select("c_custkey", "label")


@query("split_column", sql("""
SELECT c_custkey, split_part(phone, '-', 1) AS p1, split_part(phone, '-', 2) || '-' || split_part(phone, '-', 3) AS p2,
       split_part(email, '@', 1) AS user, split_part(email, '@', 2) AS host FROM dc""", DC))
def split_column(spark, sf):
    d = op.split_column(dirty_customer(spark, sf), "phone", "-", ["p1", "p2"])
    return op.split_column(d, "email", "@", ["user", "host"]).select("c_custkey", "p1", "p2", "user", "host")


@query("calc_column", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem""")
def calc_column(spark, sf):
    d = op.calc_column(table(spark, sf, "lineitem"), "charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)")
    return d.select("l_orderkey", "l_linenumber", F.round("charge", 6).alias("charge"))


@query("math_binary", """
SELECT l_orderkey, l_linenumber, l_quantity + 5 AS a, l_quantity - l_linenumber AS s, round(l_quantity * 1.5, 6) AS m,
       round(l_extendedprice / nullif(l_tax, 0), 4) AS d, l_quantity * l_quantity AS p, round(l_quantity / 4, 6) AS q
FROM lineitem""")
def math_binary(spark, sf):
    d = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_tax", *[F.col("l_quantity").alias(x) for x in "asmpq"],
        F.col("l_extendedprice").alias("d"))
    d = op.math_operation(d, "a", "add", 5)
    d = op.math_operation(d, "s", "subtract", other="l_linenumber")
    d = op.math_operation(d, "m", "multiply", 1.5)
    d = op.math_operation(d, "d", "divide", other="l_tax")
    d = op.math_operation(d, "p", "power")
    d = op.math_operation(d, "q", "divide", 4)
    return d.select("l_orderkey", "l_linenumber", "a", "s", F.round("m", 6).alias("m"), F.round("d", 4).alias("d"),
                    "p", F.round("q", 6).alias("q"))


@query("math_unary", sql("""
SELECT c_custkey, round(ln(1 + greatest(coalesce(balance, 0), 0)), 6) AS lg,
       round(sqrt(greatest(coalesce(balance, 0), 0)), 6) AS sq, abs(CAST(age AS DOUBLE)) AS ab FROM dc""", DC))
def math_unary(spark, sf):
    d = dirty_customer(spark, sf).select("c_custkey", F.col("balance").alias("lg"), F.col("balance").alias("sq"),
                                         F.col("age").alias("ab"))
    d = op.math_operation(op.math_operation(op.math_operation(d, "lg", "log"), "sq", "sqrt"), "ab", "abs")
    return d.select("c_custkey", F.round("lg", 6).alias("lg"), F.round("sq", 6).alias("sq"), "ab")


@query("feat_ratio", "SELECT l_orderkey, l_linenumber, round(coalesce(l_extendedprice / nullif(l_tax, 0), 0), 4) AS r FROM lineitem")
def feat_ratio(spark, sf):
    d = op.ratio_feature(table(spark, sf, "lineitem"), "l_extendedprice", "l_tax", "r")
    return d.select("l_orderkey", "l_linenumber", F.round("r", 4).alias("r"))


@query("feat_text_metrics", """
SELECT doc_id, length(text) AS text_char_length,
  CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 0
       ELSE len(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) END AS text_word_count
FROM documents""")
def feat_text_metrics(spark, sf):
    d = op.text_metrics(table(spark, sf, "documents"), "text")
    return d.select("doc_id", F.col("text_char_length").cast("bigint").alias("text_char_length"),
                    F.col("text_word_count").cast("bigint").alias("text_word_count"))


@query("cast_bool", sql("SELECT o_orderkey, o_orderstatus, flag = 1 AS flag FROM ord", DO))
def cast_bool(spark, sf):
    return op.cast_bool(dirty_orders(spark, sf), "flag").select("o_orderkey", "o_orderstatus", "flag")
