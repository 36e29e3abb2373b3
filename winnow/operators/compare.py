"""Keyed comparison of two tables: rows, cells, schema, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import c, count_if, is_missing, is_numeric, num
from ..functions.stats import as_text, distinct_counts, rows_to_df, stats_row
from .profile import detect_types, rnd


def _join(old: DataFrame, new: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    a = old.select(c(key).alias("_k1"), F.struct(*[as_text(old, n).alias(n) for n in cols]).alias("_o"))
    b = new.select(c(key).alias("_k2"), F.struct(*[as_text(new, n).alias(n) for n in cols]).alias("_n"))
    return a.join(b, F.col("_k1") == F.col("_k2"), "full_outer")


def common_columns(old: DataFrame, new: DataFrame, key: str) -> list[str]:
    return [n for n in old.columns if n in new.columns and n != key]


def _changed(cols: Sequence[str]) -> dict[str, Column]:
    both = F.col("_k1").isNotNull() & F.col("_k2").isNotNull()
    return {n: both & ~F.col("_o")[n].eqNullSafe(F.col("_n")[n]) for n in cols}


def diff_cells(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row per key present in both, one boolean per common column: did the cell change?"""
    cols = common_columns(old, new, key)
    j = _join(old, new, key, cols).where("_k1 is not null and _k2 is not null")
    return j.select(F.col("_k1").alias(key), *[f.alias(f"{n}_changed") for n, f in _changed(cols).items()])


def diff_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, column, old_value, new_value) for every changed cell."""
    cols = common_columns(old, new, key)
    ch = _changed(cols)
    cells = F.array(*[F.when(ch[n], F.struct(F.lit(n).alias("column"), F.col("_o")[n].alias("old_value"),
                                             F.col("_n")[n].alias("new_value"))) for n in cols])
    j = _join(old, new, key, cols)
    return j.select(F.col("_k1").alias(key), F.inline(F.array_compact(cells)))


def diff_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Added, deleted and modified rows."""
    cols = common_columns(old, new, key)
    any_change = F.lit(False)
    for f in _changed(cols).values():
        any_change = any_change | f
    return _join(old, new, key, cols).agg(
        count_if(F.col("_k1").isNull()).alias("added"), count_if(F.col("_k2").isNull()).alias("deleted"),
        count_if(any_change).alias("modified"))


def diff_sample(old: DataFrame, new: DataFrame, key: str, k: int = 20) -> DataFrame:
    """The changed cells of the k smallest changed keys."""
    ch = diff_changes(old, new, key)
    keys = ch.select(c(key)).distinct().orderBy(c(key)).limit(k)
    return ch.join(F.broadcast(keys), key, "left_semi")


def diff_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """(column, status, old_type, new_type): added, removed, type_changed or same (semantic types)."""
    a, b = detect_types(old), detect_types(new)
    rows = []
    for n in dict.fromkeys([*a, *b]):
        st = "removed" if n not in b else "added" if n not in a else "same" if a[n] == b[n] else "type_changed"
        rows.append((n, st, a.get(n), b.get(n)))
    return rows_to_df(old.sparkSession, rows, "column string, status string, old_type string, new_type string")


def _stats(df: DataFrame) -> dict:
    cols = df.columns
    aggs = {("m", n): count_if(is_missing(df, n)) for n in cols}
    aggs.update({("a", n): F.avg(num(df, n)) for n in cols if is_numeric(df, n)})
    got = stats_row(df, aggs)
    u = distinct_counts(df, cols)
    return {n: (got[("m", n)], rnd(got.get(("a", n))), u[n]) for n in cols}


def diff_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """Missing count, mean and distinct count of each column on both sides."""
    a, b = _stats(old), _stats(new)
    none = (None, None, None)
    rows = []
    for n in dict.fromkeys([*a, *b]):
        x, y = a.get(n, none), b.get(n, none)
        rows.append((n, n in a, n in b, x[0], y[0], x[1], y[1], x[2], y[2]))
    return rows_to_df(old.sparkSession, rows,
                      "column string, in_old boolean, in_new boolean, missing_old bigint, missing_new bigint, "
                      "mean_old double, mean_new double, unique_old bigint, unique_new bigint")


def diff_versions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows and columns added or removed and cells changed; a row on one side only counts all its common cells."""
    cols = common_columns(old, new, key)
    j = _join(old, new, key, cols)
    cells = F.lit(0)
    for f in _changed(cols).values():
        cells = cells + F.coalesce(f, F.lit(False)).cast("int")
    one = F.col("_k1").isNull() | F.col("_k2").isNull()
    got = stats_row(j, {"add": count_if(F.col("_k1").isNull()), "rem": count_if(F.col("_k2").isNull()),
                        "cells": F.sum(F.when(one, F.lit(len(cols) + 1)).otherwise(cells))})
    plus = ", ".join(n for n in new.columns if n not in old.columns)
    minus = ", ".join(n for n in old.columns if n not in new.columns)
    return rows_to_df(old.sparkSession, [(got["add"], got["rem"], plus, minus, got["cells"])],
                      "rows_added bigint, rows_removed bigint, columns_added string, columns_removed string, "
                      "cells_changed bigint")
