"""Exact duplicates by sorting contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import hex_long, materialise, partitions, range_of, sampled_cuts, text_of

RANGES_PER_PARTITION = 4
LEAD_BYTES = 12


def content_sort(docs: DataFrame, keep: str = "smallest", carry: bool = False, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256; with ``carry`` all columns of
    ``docs`` too, in a struct column ``row``.

    Texts are equal when identical; ``keep`` names which key of equal texts stays, the "smallest" or the "largest".

    The sort order is (leading bytes, 64-bit hash, whole text, key).  Sampled splitters cut it into ranges of about
    equal row counts; because the key is part of the splitters, a text that fills a third of the table is spread over
    many ranges.  Each range is sorted externally and every text is compared in full with its neighbour.  A run of
    equal texts that touches a range's edge may go on in the next range: the first and the last run of each range
    (two rows a range, whatever the table holds) are compared in full once more and their counts merged.

    Null texts count as empty.  Rows with equal key and text are one group; one of them is kept.  A null key stays only
    in a group that has no other.  An empty table gives an empty result.  No column of ``docs`` but these two is read
    by name, so other columns may have any name.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark = docs.sparkSession
    body = text_of(docs, text)
    lead = F.rpad(F.lower(F.hex(F.substring(body.cast("binary"), 1, LEAD_BYTES))), 2 * LEAD_BYTES, "0")
    order = F.concat(lead, hex_long(F.xxhash64(body)))
    place = F.concat(order, F.coalesce(hex_long(docs[key]), F.lit("")))
    cuts = sampled_cuts(docs, place, docs[key], RANGES_PER_PARTITION * partitions(spark))
    base = docs.select(docs[key].alias("id"), body.alias("body"), order.alias("ord"), range_of(place, cuts).alias("rng"),
                       *([F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row"),
                          docs[text].isNull().alias("none")] if carry else []))

    sorted_ = Window.partitionBy("rng").orderBy("ord", "body", "id")
    run = Window.partitionBy("rng", "run")
    first, best = (F.asc_nulls_last("id"), F.min("id")) if keep == "smallest" else (F.desc_nulls_last("id"), F.max("id"))
    edge = (F.col("run") == 1) | F.col("last")
    rows = (base
            .withColumn("fresh", ~F.lag("body").over(sorted_).eqNullSafe(F.col("body")))
            .withColumn("last", F.lead(F.lit(1)).over(sorted_).isNull())
            .withColumn("run", F.sum(F.col("fresh").cast("int")).over(sorted_))
            .withColumn("sha", F.sha2("body", 256))
            .withColumn("edge", F.when(edge, F.col("body"))))
    if not carry:
        rows = rows.drop("body")
    rows = (rows.drop("ord", "fresh", "last")
            .withColumn("n", F.count(F.lit(1)).over(run))
            .withColumn("best", best.over(run))
            .withColumn("nth", F.row_number().over(run.orderBy(first))))
    rows = materialise(rows, "content-sort")

    at_edge = (rows.where(F.col("edge").isNotNull()).groupBy("rng", "run")
               .agg(F.first("n").alias("n"), F.first("best").alias("best"), F.max("edge").alias("edge")))
    same = Window.partitionBy("edge")
    have = F.col("best").isNull() if keep == "smallest" else F.col("best").isNotNull()
    pick = F.min if keep == "smallest" else F.max
    merged = at_edge.select("rng", "run", F.sum("n").over(same).alias("all"),
                            pick(F.struct(have, "best", "rng")).over(same).alias("win")) \
        .select("rng", "run", "all", F.col("win.best").alias("win"), F.col("win.rng").alias("home"))
    done = rows.join(F.broadcast(merged), ["rng", "run"], "left")  # two rows a range at most
    keep_id = F.when(F.col("all").isNotNull(), F.col("win")).otherwise(F.col("best"))
    kept = (F.col("nth") == 1) & (F.col("home").isNull() | (F.col("home") == F.col("rng")))
    extra = []
    if carry:
        whole = [(F.when(~F.col("none"), F.col("body")) if c == text else F.col("row").getField(c)).alias(c)
                 for c in docs.columns]
        extra = [F.struct(*whole).alias("row")]
    return done.select(F.col("id").alias(key), keep_id.alias("keep_id"),
                       F.coalesce("all", "n").alias("group_size"), kept.alias("kept"),
                       F.col("sha").alias("text_sha256"), *extra)


def drop_copies(docs: DataFrame, keep: str = "smallest", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``content_sort`` does not keep; all columns unchanged."""
    done = content_sort(docs, keep, True, key, text).where("kept")
    return done.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
