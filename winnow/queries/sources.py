"""Scans, sinks, paging, versions, recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sample
from ..plans import steps
from ..sources import tables
from ..sources.versions import VersionStore
from .base import DC, DO, dirty_customer, dirty_orders, query, sql, table, work_dir

_ORDERS_SQL = ("SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority "
               "FROM orders")


def _orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        "o_orderpriority")


@query("scan_csv", _ORDERS_SQL)
def scan_csv(spark, sf):
    path = work_dir(spark, "csv")
    tables.write_csv(_orders(spark, sf), path)
    got = tables.read_csv(spark, path)  # inferred types
    return got.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_totalprice",
                      F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")


@query("scan_json", "SELECT event_id, user_id, event_type, value, props FROM events")
def scan_json(spark, sf):
    path = work_dir(spark, "json")
    tables.write_json(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props"), path)
    return tables.read_json(spark, path).select("event_id", "user_id", "event_type", "value", "props")


@query("input_check", """SELECT * FROM (SELECT 0 AS n, 'parquet' AS format, 'ok' AS status, CAST(3 AS INT) AS columns, count(*) AS rows FROM orders
UNION ALL SELECT 1, 'csv', 'ok', 3, count(*) FROM orders UNION ALL SELECT 2, 'json', CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END, 3, count(*) FROM orders WHERE o_orderkey % 1000 = 1
UNION ALL SELECT 3, 'parquet', 'empty', 3, count(*) FROM orders WHERE o_orderkey < 0 UNION ALL SELECT 4, 'xlsx', 'unsupported', NULL, NULL
UNION ALL SELECT 5, 'parquet', 'unreadable: AnalysisException', NULL, NULL)""")
def input_check(spark, sf):
    """Inputs of all kinds before they are taken in: readable, empty, unsupported, missing."""
    src, path = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), work_dir(spark, "inputs")
    tables.write_parquet(src, f"{path}/0")
    tables.write_csv(src, f"{path}/1")
    tables.write_json(src.where("o_orderkey % 1000 = 1"), f"{path}/2")
    tables.write_parquet(src.where("o_orderkey < 0"), f"{path}/3")
    kinds = ("parquet", ".CSV", "json", "parquet", "xlsx", "parquet")
    got = tables.check_inputs(spark, [(f"{path}/{i}", k) for i, k in enumerate(kinds)])
    return got.select(F.element_at(F.split("path", "/"), -1).cast("int").alias("n"), "format", "status", "columns", "rows")


_DC_SQL = sql("SELECT c_custkey, name, segment, round(balance, 4) AS balance, age, email, phone FROM dc", DC)


def _round_trip(spark, sf, name, write, read):
    src, path = dirty_customer(spark, sf), work_dir(spark, name)
    write(src, path)
    got = tables.cast_like(read(path), src.schema)
    return got.withColumn("balance", F.round("balance", 4))


@query("sink_csv", _DC_SQL)
def sink_csv(spark, sf):
    return _round_trip(spark, sf, "csv", tables.write_csv, lambda p: tables.read_csv(
        spark, p, dirty_customer(spark, sf).schema))


@query("sink_tsv", _DC_SQL)
def sink_tsv(spark, sf):
    return _round_trip(spark, sf, "tsv", tables.write_tsv, lambda p: tables.read_csv(
        spark, p, dirty_customer(spark, sf).schema, sep="\t"))


@query("sink_json", _DC_SQL)
def sink_json(spark, sf):
    return _round_trip(spark, sf, "json", tables.write_json, lambda p: tables.read_json(
        spark, p, dirty_customer(spark, sf).schema))


@query("sink_parquet", _DC_SQL)
def sink_parquet(spark, sf):
    return _round_trip(spark, sf, "parquet", lambda d, p: tables.write_parquet(d, p, ["age"]),
                       lambda p: tables.read_parquet(spark, p))


@query("preview_head", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def preview_head(spark, sf):
    return sample.head(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 10)


@query("page_read", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_read(spark, sf):
    return sample.page(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"),
                       "o_orderkey", number=3, size=50)


@query("page_after", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 99 "
                     "ORDER BY o_orderkey LIMIT 50")
def page_after(spark, sf):
    return sample.page_after(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"),
                             "o_orderkey", 99, 50)


# ---------------------------------------------------------------- versions

def _store(spark, sf):
    """Three versions: as it came, trimmed, trimmed and filled; the last one undone."""
    from ..operators import clean

    v = VersionStore(spark, work_dir(spark, "versions"))
    d1 = dirty_customer(spark, sf)
    d2 = clean.trim_whitespace(d1)
    v.save(d1, "upload", "as it came")
    v.save(d2, "trim_whitespace", "trimmed")
    v.save(clean.fill_missing(d2, "balance", "custom_value", 0), "fill_missing", "filled")
    v.undo()
    return v


@query("version_save", sql("SELECT 3 AS version, count(*) AS n, round(sum(coalesce(balance, 0)), 2) AS total FROM dc", DC))
def version_save(spark, sf):
    d = _store(spark, sf).get(3)
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("total")).select(
        F.lit(3).alias("version"), "n", "total")


@query("version_history", sql("""
SELECT 1 AS version, 'upload' AS operation, count(*) AS "rows", false AS is_current FROM dc UNION ALL
SELECT 2, 'trim_whitespace', count(*), true FROM dc UNION ALL
SELECT 3, 'fill_missing', count(*), false FROM dc""", DC))
def version_history(spark, sf):
    return _store(spark, sf).history().select("version", "operation", "rows", "is_current")


_TRIMMED = sql("SELECT c_custkey, trim(name) AS name, segment, round(balance, 4) AS balance FROM dc", DC)


@query("version_undo", _TRIMMED)
def version_undo(spark, sf):
    v = _store(spark, sf)
    v.redo()
    return v.undo().select("c_custkey", "name", "segment", F.round("balance", 4).alias("balance"))


@query("version_restore", sql("SELECT c_custkey, name, segment, round(balance, 4) AS balance FROM dc", DC))
def version_restore(spark, sf):
    return _store(spark, sf).restore(1).select("c_custkey", "name", "segment", F.round("balance", 4).alias("balance"))


@query("diff_versions", sql("""
SELECT CAST(0 AS BIGINT) AS rows_added, CAST(0 AS BIGINT) AS rows_removed, '' AS columns_added, '' AS columns_removed,
       count(*) AS cells_changed FROM dc WHERE name <> trim(name)""", DC))
def diff_versions(spark, sf):
    return _store(spark, sf).compare(1, 2, "c_custkey").drop("quality_change")


# ---------------------------------------------------------------- recipes

@query("recipe_registry", sql("""SELECT c_custkey, upper(trim(name)) AS name, upper(trim(segment)) AS segment, upper(email) AS email
FROM dc""", DC))
def recipe_registry(spark, sf):
    """Save a recipe next to the presets, load it by name, and run it."""
    path = work_dir(spark, "recipes")
    steps.save_recipe(spark, path, "mine", [{"operation": "trim_whitespace"}, {"operation": "standardize_case_all", "case": "upper"}])
    d = steps.run_steps(dirty_customer(spark, sf), steps.load_recipe(spark, path, "mine"))
    return d.select("c_custkey", "name", "segment", "email")


_PRE = """
tr AS (SELECT c_custkey, trim(name) AS name, trim(segment) AS segment, balance, age, trim(email) AS email,
       trim(phone) AS phone FROM dc),
md AS (SELECT mode(segment ORDER BY segment) AS m FROM tr WHERE segment IS NOT NULL AND lower(segment) <> 'n/a'),
av AS (SELECT avg(balance) AS a FROM tr),
fl AS (SELECT c_custkey, name, CASE WHEN segment IS NULL OR lower(segment) = 'n/a' THEN (SELECT m FROM md)
       ELSE segment END AS segment, coalesce(balance, (SELECT a FROM av)) AS balance, age, email, phone FROM tr),
qq AS (SELECT quantile_cont(balance, 0.25) AS b1, quantile_cont(balance, 0.75) AS b3,
       quantile_cont(CAST(age AS DOUBLE), 0.25) AS a1, quantile_cont(CAST(age AS DOUBLE), 0.75) AS a3,
       quantile_cont(CAST(c_custkey AS DOUBLE), 0.25) AS k1, quantile_cont(CAST(c_custkey AS DOUBLE), 0.75) AS k3 FROM fl),
fe AS (SELECT b1 - 1.5*(b3-b1) AS bl, b3 + 1.5*(b3-b1) AS bh, b3-b1 AS bi, a1 - 1.5*(a3-a1) AS al,
       a3 + 1.5*(a3-a1) AS ah, a3-a1 AS ai FROM qq)"""

_CAP = """SELECT c_custkey, name, segment,
  round(CASE WHEN balance < bl - 1e-9*bi THEN bl + 1e-5*bi WHEN balance > bh + 1e-9*bi THEN bh - 1e-5*bi
        ELSE balance END, 4) AS balance,
  CAST(CASE WHEN age < al - 1e-9*ai THEN ceil(al + 1e-5*ai) WHEN age > ah + 1e-9*ai THEN floor(ah - 1e-5*ai) ELSE age END
       AS INT) AS age, email, phone FROM fl, fe"""


@query("preset_sales", sql(_CAP, DC, _PRE))
def preset_sales(spark, sf):
    return steps.run_preset(dirty_customer(spark, sf), "Sales Data").withColumn("balance", F.round("balance", 4))


def _title(x):
    from .base import sq_title

    return sq_title(x)


@query("preset_hr", sql(f"""SELECT c_custkey, {_title('name')} AS name, {_title('segment')} AS segment,
  round(balance, 4) AS balance, age, {_title('email')} AS email, phone FROM fl""", DC, _PRE))
def preset_hr(spark, sf):
    return steps.run_preset(dirty_customer(spark, sf), "HR Data").withColumn("balance", F.round("balance", 4))


# Removal goes column by column: each fence is taken after the previous removal.
@query("preset_health", sql("""SELECT c_custkey, name, segment, round(balance, 4) AS balance, age, email, phone
FROM nb, (SELECT quantile_cont(CAST(age AS DOUBLE), 0.25) AS a1, quantile_cont(CAST(age AS DOUBLE), 0.75) AS a3 FROM nb)
WHERE age BETWEEN a1 - 1.5*(a3-a1) AND a3 + 1.5*(a3-a1)""", DC, _PRE,
                            "nb AS (SELECT fl.* FROM fl, fe WHERE balance >= bl - 1e-9*bi AND balance <= bh + 1e-9*bi)"))
def preset_health(spark, sf):
    return steps.run_preset(dirty_customer(spark, sf), "Healthcare Data").withColumn("balance", F.round("balance", 4))


@query("preset_finance", sql(_CAP, DC, _PRE))
def preset_finance(spark, sf):
    return steps.run_preset(dirty_customer(spark, sf).withColumn("unit", F.lit("EUR")), "Finance Data").withColumn(
        "balance", F.round("balance", 4))


@query("steps_run", sql("""
SELECT 1 AS step, 'trim_whitespace' AS operation, count(*) AS affected FROM dc WHERE name <> trim(name) UNION ALL
SELECT 2, 'fill_missing_median', count(*) FROM dc WHERE balance IS NULL UNION ALL
SELECT 3, 'standardize_case', count(*) FROM dc WHERE segment <> upper(segment) UNION ALL
SELECT 4, 'remove_duplicates', CAST(0 AS BIGINT)""", DC))
def steps_run(spark, sf):
    recipe = [{"operation": "trim_whitespace"}, {"operation": "fill_missing_median", "column": "balance"},
              {"operation": "standardize_case", "column": "segment", "case": "upper"},
              {"operation": "remove_duplicates"}]
    return steps.run_steps(dirty_customer(spark, sf), recipe, report=True)[1]


@query("auto_clean", sql("""
SELECT c_key AS o_custkey, o_orderstatus,
  CASE WHEN x < l - 1e-9*i THEN l + 1e-5*i WHEN x > h + 1e-9*i THEN h - 1e-5*i ELSE x END AS amount, flag
FROM un, (SELECT a - 1.5*(b-a) AS l, b + 1.5*(b-a) AS h, b-a AS i FROM
  (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM un))""", DO, """
un AS (SELECT DISTINCT CAST(o_custkey AS DOUBLE) AS c_key, o_orderkey, o_orderstatus,
       try_cast(amount_text AS DOUBLE) AS x, flag FROM ord)"""))
def auto_clean(spark, sf):
    got = steps.auto_clean(dirty_orders(spark, sf).withColumn("unit", F.lit("EUR")))
    return got.select(F.col("o_custkey").cast("double").alias("o_custkey"), "o_orderstatus",
                      F.col("amount_text").alias("amount"), "flag")


@query("auto_clean_report", sql("""
SELECT 1 AS step, 'remove_empty_columns' AS operation, CAST(0 AS BIGINT) AS affected UNION ALL
SELECT 2, 'remove_constant_columns', 1 UNION ALL
SELECT 3, 'remove_duplicates', (SELECT count(*) FROM ord) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ord)) UNION ALL
SELECT 4, 'trim_whitespace', 0 UNION ALL SELECT 5, 'fill_all_missing', 0 UNION ALL
SELECT 6, 'fix_outliers', 0 UNION ALL SELECT 7, 'convert_dates', 0""", DO))
def auto_clean_report(spark, sf):
    return steps.auto_clean(dirty_orders(spark, sf).withColumn("unit", F.lit("EUR")), report=True)[1]
