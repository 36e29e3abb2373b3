"""Scanning for and masking personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import c, count_if, flat_cols, require, sentinel, strip, text_cols
from ..functions.pii import BASIC_PATTERNS, PATTERNS, mask, mask_kind
from ..functions.stats import as_text, rows_to_df, spread, stats_row


def scan_pii(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(pii_type, column, count, sample, risk, recommendation) over whole values of every column.

    The sample is the masked smallest match."""
    cols = columns or flat_cols(df)
    aggs = {}
    for n in cols:
        x = as_text(df, n)
        for t, pattern, _, _ in PATTERNS:
            hit = F.when(x.rlike(pattern), x)
            aggs[("k", n, t)] = F.count(hit)
            aggs[("s", n, t)] = mask(F.min(hit), mask_kind(t))
    got = stats_row(spread(df.select(*[c(n) for n in cols])), aggs)
    rows = [(t, n, got[("k", n, t)], got[("s", n, t)], risk, advice)
            for n in cols for t, _, risk, advice in PATTERNS if got[("k", n, t)]]
    return rows_to_df(df.sparkSession, rows, "pii_type string, column string, count bigint, sample string, "
                                             "risk string, recommendation string")


def scan_pii_basic(df: DataFrame) -> DataFrame:
    """Five patterns over text columns."""
    cols = text_cols(df)
    got = stats_row(spread(df.select(*[c(n) for n in cols])), {(n, t): count_if(c(n).rlike(p)) for n in cols for t, p, _ in BASIC_PATTERNS})
    rows = [(n, t, got[(n, t)], risk) for n in cols for t, _, risk in BASIC_PATTERNS if got[(n, t)]]
    return rows_to_df(df.sparkSession, rows, "column string, pii_type string, count bigint, risk string")


def mask_pii(df: DataFrame, column: str, pii_type: str) -> DataFrame:
    """Mask every non-missing cell of the column; sentinels stay as they are."""
    require(df, column)
    x = c(column).cast("string")
    return df.withColumn(column, F.when(sentinel(x) | (strip(x) == ""), x).otherwise(mask(x, mask_kind(pii_type))))
