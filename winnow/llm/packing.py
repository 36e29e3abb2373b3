"""Packing into batches by optimal length buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_of
from .mixing import word_count

MAX_LENGTH = 2048
BUCKETS = 16
TOKEN_BUDGET = 1 << 16
SUBBLOCK_ROWS = 8192


def best_boundaries(counts: dict[int, int], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least padded total: dynamic programming over the histogram
    {length: rows}.  Only lengths that occur can be boundaries of a best solution."""
    lengths = np.array(sorted(counts), dtype=np.int64)
    if not len(lengths):
        return []
    upto = np.concatenate([[0], np.cumsum([counts[x] for x in lengths.tolist()])]).astype(np.float64)
    n, width = len(lengths), np.maximum(lengths, 1)
    best = width * upto[1:]
    back = [np.zeros(n, dtype=np.int64)]
    for _ in range(1, min(buckets, n)):
        # row j: the last bucket holds lengths i..j, the ones before are solved with one bucket less
        cost = np.concatenate([[0.0], best[:-1]])[None, :] + width[:, None] * (upto[1:, None] - upto[None, :-1])
        cost[np.triu_indices(n, 1)] = np.inf
        back.append(cost.argmin(axis=1))
        best = cost.min(axis=1)
    out, j = [], n - 1
    for first in reversed(back):
        out.append(int(width[j]))
        j = int(first[j]) - 1
        if j < 0:
            break
    return sorted(set(out))


def pack(docs: DataFrame, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET,
         key: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """key, piece, n_tokens, bucket, padded_length, batch, slot of every piece of every row.

    A row is ``length`` tokens long (a column; by default the words of its text) and is cut into pieces of at most
    ``max_length``.  The histogram of piece lengths, at most ``max_length`` + 1 numbers, is all the driver sees; dynamic
    programming puts the bucket boundaries where padding is least.  A batch holds as many pieces of one bucket as fit the
    token budget after padding (at least one); within a bucket only the last batch is not full.  Pieces are dealt in hashed
    order, numbered inside sub-blocks of bounded size plus the counts of earlier sub-blocks.

    Null or empty texts and null lengths are one piece of 0 tokens.  Repeated rows are packed each.  An empty table gives
    an empty result.  Batches are numbered inside their bucket."""
    tokens = (word_count(text_of(docs, text)) if length is None else F.coalesce(docs[length], F.lit(0))).cast("bigint")
    whole = docs.select(docs[key].alias("id"), tokens.alias("n"))
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / max_length) - 1, F.lit(0)).cast("int")))
    pieces = whole.withColumn("piece", piece) \
        .withColumn("len", F.least(F.lit(max_length), F.col("n") - F.col("piece") * max_length)) \
        .select("id", "piece", "len", F.monotonically_increasing_id().alias("row"))
    pieces = materialise(pieces, "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("len").count().collect()}  # at most max_length + 1 rows
    bounds = best_boundaries(counts, buckets) or [1]
    subs = max(sum(counts.values()) // SUBBLOCK_ROWS, 1)
    held = F.array(*[F.lit(b) for b in bounds])
    placed = pieces.withColumn("bucket", F.size(F.filter(held, lambda b: b < F.col("len")))) \
        .withColumn("u", F.xxhash64("row")).withColumn("sub", F.pmod("u", F.lit(subs)))
    sums = placed.groupBy("bucket", "sub").agg(F.count(F.lit(1)).alias("k"))
    sums = sums.withColumn("before", F.sum("k").over(Window.partitionBy("bucket").orderBy("sub")) - F.col("k")).drop("k")
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("bucket", "sub").orderBy("u", "row"))) \
        .join(sums, ["bucket", "sub"])
    at = F.col("before") + F.col("nth") - 1
    room = F.greatest(F.floor(F.lit(token_budget) / F.col("padded_length")), F.lit(1))
    return numbered.withColumn("padded_length", F.get(held, F.col("bucket"))).select(
        F.col("id").alias(key), "piece", F.col("len").alias("n_tokens"), "bucket", "padded_length",
        F.floor(at / room).cast("bigint").alias("batch"), F.pmod(at, room).cast("int").alias("slot"))
