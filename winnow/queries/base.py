"""Registry of the runnable queries, their SQL twins, and the inputs they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.core import MISSING_SENTINELS
from ..session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equivalent the checker runs, where SQL can say it."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder on shared storage for a query that writes."""
    return f"{shared_dir(spark)}/winnow-{name}-{uuid.uuid4().hex[:8]}"


# ---------------------------------------------------------------- shared dirty inputs
# The same expressions build the input in both engines; every row of the base table is kept.

_CUSTOMER = """c_custkey,
  CASE WHEN c_custkey % 13 = 0 THEN concat('  ', c_name, ' ') ELSE c_name END AS name,
  CASE WHEN c_custkey % 17 = 0 THEN NULL
       WHEN c_custkey % 19 = 0 THEN 'N/A'
       WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment)
       ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 10 = 0 THEN NULL
       WHEN c_custkey % 97 = 0 THEN c_acctbal * 100
       ELSE c_acctbal END AS balance,
  CASE WHEN c_custkey % 23 = 0 THEN -5 ELSE CAST(18 + c_custkey % 60 AS INT) END AS age,
  CASE WHEN c_custkey % 11 = 0 THEN 'invalid-email'
       ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END AS email,
  concat('555-123-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) AS phone"""

_ORDERS = """o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 29 = 0 THEN 'bad'
       ELSE CAST(CAST(o_orderkey % 1000 AS INT) AS STRING) END AS amount_text,
  CAST(o_orderkey % 2 AS INT) AS flag"""

_EVENTS = """event_id, ts, user_id, event_type,
  CASE WHEN event_id % 9 = 0 THEN NULL
       WHEN event_id % 500 < 12 THEN 7.0
       ELSE value END AS value"""

_COPIES = "CASE WHEN o_orderkey % 50 = 0 THEN 2 ELSE 1 END"


def _select(df: DataFrame, text: str) -> DataFrame:
    return df.sparkSession.sql(f"SELECT {text} FROM {{src}}", src=df)


def dirty_customer(spark: SparkSession, sf: str) -> DataFrame:
    return _select(table(spark, sf, "customer"), _CUSTOMER)


def dirty_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with some rows twice."""
    return _select(table(spark, sf, "orders"),
                   f"{_ORDERS}, explode(array_repeat(0, {_COPIES})) AS copy").drop("copy")


def dirty_events(spark: SparkSession, sf: str) -> DataFrame:
    return _select(table(spark, sf, "events"), _EVENTS)


def date_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates as text in three styles, with an unreadable value here and there."""
    return _select(table(spark, sf, "orders"), """o_orderkey,
      CASE WHEN o_orderkey % 41 = 0 THEN 'soon'
           WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd')
           WHEN o_orderkey % 3 = 1 THEN date_format(o_orderdate, 'yyyy/MM/dd')
           ELSE date_format(o_orderdate, 'dd.MM.yyyy') END AS date_text""")


DC = f"dc AS (SELECT {_CUSTOMER} FROM customer)"
DO = f"ord AS (SELECT {_ORDERS} FROM (SELECT *, unnest(range({_COPIES})) AS copy FROM orders))"
DE = f"ev AS (SELECT {_EVENTS} FROM events)"
DT = """dt AS (SELECT o_orderkey,
      CASE WHEN o_orderkey % 41 = 0 THEN 'soon'
           WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
           WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y/%m/%d')
           ELSE strftime(o_orderdate, '%d.%m.%Y') END AS date_text FROM orders)"""


def sql(body: str, *ctes: str) -> str:
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


# ---------------------------------------------------------------- SQL snippets for the twins

def sq_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sq_sentinel(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in MISSING_SENTINELS)
    return f"lower({sq_strip(x)}) IN ({words})"


def sq_missing(x: str) -> str:
    return f"({x} IS NULL OR {sq_sentinel(x)})"


def sq_title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), "
            f"lambda w: upper(w[1]) || lower(w[2:])), '')")


def sq_date(x: str) -> str:
    fmts = ("%Y-%m-%d", "%Y/%m/%d", "%m.%d.%Y", "%d.%m.%Y")
    return "coalesce(" + ", ".join(f"try_strptime({x}, '{f}')" for f in fmts) + ")"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)
