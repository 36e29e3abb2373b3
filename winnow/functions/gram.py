"""Pairwise moments of many columns from one scan, missing cells left out pair by pair.

Every batch is a matrix X with its mask M (1 where a cell is there).  The products of X, X² and M with each other, added up over all
batches, hold for each pair of columns the count, sums, squares and cross products over the rows that have both.  A task sends its sums in
bands of rows; these are added in two steps, so that no task adds the whole matrices of all others.  The scan costs one
matrix product a batch, whatever the number of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gather import bounded_rows

BAND = 16   # matrix rows that travel together
LOTS = 64   # first step of adding: tasks are dealt to so many lots
_BANDS = "band int, lot int, cells binary"


def added_matrices(df: DataFrame, width: int, step: Callable[[np.ndarray, list[pa.Array]], None], kinds: int) -> np.ndarray:
    """(kinds, width, width) sums of what ``step`` adds to its first argument for each batch of ``df``."""
    starts = range(0, width, BAND)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((kinds, width, width)), False
        for b in batches:
            if b.num_rows:
                step(total, b.columns)
                seen = True
        if seen:
            lot = TaskContext.get().partitionId() % LOTS
            yield pa.RecordBatch.from_arrays([
                pa.array([i // BAND for i in starts], pa.int32()), pa.array([lot] * len(starts), pa.int32()),
                pa.array([np.ascontiguousarray(total[:, i:i + BAND]).tobytes() for i in starts], pa.binary())], names=["band", "lot", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for band, lot, cells in zip(*(x.to_pylist() for x in b.columns), strict=True):
                got = np.frombuffer(cells)
                sums[band, lot] = sums[band, lot] + got if (band, lot) in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()),
                                              pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["band", "lot", "cells"])

    lots = df.mapInArrow(scan, _BANDS).repartition("band", "lot").mapInArrow(add, _BANDS).withColumn("lot", F.lit(0))
    out = np.zeros((kinds, width, width))
    for r in bounded_rows(lots.repartition("band").mapInArrow(add, _BANDS)):  # one row a band
        part = np.frombuffer(bytes(r["cells"])).reshape(kinds, -1, width)
        at = r["band"] * BAND
        out[:, at:at + part.shape[1]] += part
    return out


@dataclass(frozen=True)
class PairMoments:
    """Over the rows that have both columns: how many, the means of the first (``mean[i, j]`` is that of i), population
    variances and covariances.  NaN where there is no such row or an infinite value among them."""
    n: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    cov: np.ndarray

    def correlation(self, i: int, j: int) -> float | None:
        """None without a row or where one side is constant."""
        if not self.n[i, j] or self.var[i, j] == 0 or self.var[j, i] == 0:
            return None
        return float(self.cov[i, j] / np.sqrt(self.var[i, j] * self.var[j, i]))


def _dense(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def pair_moments(df: DataFrame, xs: Sequence[Column], complete: bool = False) -> PairMoments:
    """Moments of every pair of the given numbers, each over its own rows or (``complete``) over those that have all.

    A first scan takes the means, so that the sums of the second are those of small numbers."""
    p = len(xs)
    cells = df.select(*[x.cast("double").alias(f"x{i}") for i, x in enumerate(xs)])
    if complete:
        cells = cells.dropna()
    inf = F.lit(float("inf"))
    from .stats import stats_row

    first = stats_row(cells, {i: F.avg(F.when(F.abs(F.col(f"x{i}")) < inf, F.col(f"x{i}"))) for i in range(p)})
    centre = np.array([first[i] if first[i] is not None else 0.0 for i in range(p)])

    def step(total: np.ndarray, columns: list[pa.Array]) -> None:
        raw = np.column_stack([_dense(c) for c in columns])
        mask = ~np.isnan(raw)  # missing cells arrive as NaN
        wild = np.isinf(raw)
        x = np.where(mask & ~wild, raw - centre, 0.0)
        m = mask.astype(np.float64)
        total[0] += m.T @ m
        total[1] += x.T @ m
        total[2] += (x * x).T @ m
        total[3] += x.T @ x
        total[4] += wild.T.astype(np.float64) @ m

    n, s, q, c, wild = added_matrices(cells, p, step, 5)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = s / n
        var = q / n - mean * mean
        var = np.where(var <= 1e-13 * q / n, 0.0, var)  # what is left of equal numbers by rounding
        cov = c / n - mean * mean.T
    odd = (wild > 0) | (wild.T > 0)
    return PairMoments(n, np.where(wild > 0, np.nan, mean + centre[:, None]), np.where(wild > 0, np.nan, var), np.where(odd, np.nan, cov))


def pair_matches(df: DataFrame, xs: Sequence[Column]) -> tuple[np.ndarray, np.ndarray]:
    """(rows where both columns are there, rows where they are equal) for every pair; values are compared by a 64-bit hash."""
    p = len(xs)
    cells = df.select(*[F.when(x.isNotNull(), F.xxhash64(x)).alias(f"x{i}") for i, x in enumerate(xs)])

    def step(total: np.ndarray, columns: list[pa.Array]) -> None:
        m = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
        h = np.column_stack([c.fill_null(0).to_numpy(zero_copy_only=False) for c in columns])
        there = m.astype(np.float64)
        total[0] += there.T @ there
        for i in range(p):
            total[1, i] += ((h == h[:, i:i + 1]) & m & m[:, i:i + 1]).sum(axis=0)

    return tuple(added_matrices(cells, p, step, 2))
