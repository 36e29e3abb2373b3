"""Near duplicates by similarity hash."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hex_long, materialise, small_batches, text_of
from .links import components

SHINGLE = 3
MAX_BITS = 2
PAIR_LIMIT = 64  # a segment shared by more fingerprints is walked by neighbourhood, not by pairs


def fingerprint_of(text: str, words: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles of an A-Z lower-cased text; 0 without a word."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(len(w) - words + 1, 1)
    whole = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]).tolist()
    starts = [0, *ends[:n - 1]]
    stops = ends[min(words, len(w)) - 1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(whole[a:b - 1], 42) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in text], dtype="int64")


def _segments(count: int) -> list[tuple[int, int]]:
    """(offset, width) of ``count`` segments that make up 64 bits, widths as even as can be."""
    widths = [64 // count + (i < 64 % count) for i in range(count)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(segments: list[tuple[int, int]]) -> int:
    return _signed(sum(((1 << w) - 1) << o for o, w in segments))


def _ring(max_bits: int) -> list[tuple[tuple[int, int], int, list[int]]]:
    """(segment, its mask, masks of the chains of 2, 3, ... segments from it) for every start on the ring of max_bits + 1 segments."""
    ring = _segments(max_bits + 1)
    return [(s, _mask([s]), [_mask((ring + ring)[i:i + n]) for n in range(2, max_bits + 1)]) for i, s in enumerate(ring)]


def chains_hold(max_bits: int = MAX_BITS) -> Column:
    """Whether fa and fb stay within the budget of every chain from their segment i, the shortest chain first."""
    differ = F.col("fa").bitwiseXOR(F.col("fb"))
    hold = F.lit(True)
    for n in range(2, max_bits + 1):
        mask = F.element_at(F.array(*[F.lit(chains[n - 2]) for _, _, chains in _ring(max_bits)]), F.col("i") + 1)
        hold = hold & (F.bit_count(differ.bitwiseAND(mask)) <= n * max_bits // (max_bits + 1))
    return hold


def sharing_pairs(keyed: DataFrame) -> DataFrame:
    """(i, a, fa, b, fb): the pairs of fingerprints of (node, fp, i, s) that share a segment."""
    left, right = (keyed.select("i", "s", F.col("node").alias(n), F.col("fp").alias(f)) for n, f in (("a", "fa"), ("b", "fb")))
    return left.join(right, ["i", "s"]).where("a < b").drop("s")


def _flips(max_bits: int) -> list[tuple[int, int, bool]]:
    """(segment, bits to flip, whether few) of the values that a fingerprint names where its segment is crowded: all that differ
    outside it in up to half the limit, rounded up; few if rounded down."""
    out = []
    for i, (o, w) in enumerate(_segments(max_bits + 1)):
        free = [b for b in range(64) if not o <= b < o + w]
        for n in range((max_bits + 1) // 2 + 1):
            out += [(i, _signed(sum(1 << b for b in bits)), n <= max_bits // 2) for bits in itertools.combinations(free, n)]
    return out


def pigeonring_links(nodes: DataFrame, max_bits: int = MAX_BITS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(a, b) links between ``nodes`` (node, fp: distinct fingerprints) that connect all fingerprints within
    ``max_bits`` bits of each other, and no others.

    The 64 bits form a ring of max_bits + 1 segments.  Two fingerprints within the limit have a start on the ring from
    where every chain of consecutive segments stays within its proportional budget: l segments differ in at most
    l * max_bits / (max_bits + 1) bits, so the first one is equal.  Candidates therefore share a segment, and chains of
    2, 3, ... segments prune them before the full comparison.

    Where more than ``pair_limit`` fingerprints share a segment no pairs are formed.  Each fingerprint names every value that differs
    from it, outside the shared segment, in at most half the limit; two within the limit name a common value, one of them in
    at most half of it rounded down.  All who name a value are within the limit of such a one, so each is linked to the
    smallest of those.  A value can be named by no more fingerprints than there are values near it (44 for two bits, 1,300 for four)."""
    spark = nodes.sparkSession
    keyed = nodes.select("node", "fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("s")) for i, (_, m, _) in enumerate(_ring(max_bits))])).alias("k")) \
        .select("node", "fp", "k.i", "k.s")
    hot = materialise(keyed.groupBy("i", "s").count().where(F.col("count") > pair_limit).select("i", "s"), "hot-segments")
    few = keyed.join(hot, ["i", "s"], "left_anti")
    near = chains_hold(max_bits) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= max_bits)
    pairs = sharing_pairs(few).where(near).select("a", "b")
    if hot.isEmpty():
        return pairs
    many = keyed.join(hot, ["i", "s"], "left_semi")
    flips = spark.createDataFrame(_flips(max_bits), "i int, flip bigint, few boolean")  # fixed by the limit, not by the data
    named = many.join(F.broadcast(flips), "i").select("node", "i", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"), "few")
    groups = named.groupBy("i", "value").agg(F.collect_set("node").alias("all"), F.min(F.when(F.col("few"), F.col("node"))).alias("a"))
    stars = groups.where("a is not null and size(all) > 1").select(F.explode("all").alias("b"), "a").where("a <> b").select("a", "b")
    return pairs.union(stars)


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(key, fp, component_id) for every row: the similarity hash and the smallest key reachable over links of at most
    ``max_bits`` differing bits.

    Rows of one fingerprint are one node from the start, so a group of exact copies is one row in every join but the
    last, which Spark splits when it is skewed.  Null and empty texts have fingerprint 0 and link like any other.
    Repeated rows share a component; rows with a null key get the component of their fingerprint; an empty table gives an
    empty result; other columns are not read."""
    small_batches(docs.sparkSession)
    prints = materialise(docs.select(docs[key].cast("bigint").alias("id"), fingerprints(text_of(docs, text)).alias("fp")), "prints")
    nodes = materialise(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    links = pigeonring_links(nodes, max_bits)
    comp = materialise(components(links), "components")
    known = nodes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(known, "fp", "left").select(F.col("id").alias(key), "fp", "component_id")


def with_hex(groups: DataFrame) -> DataFrame:
    return groups.withColumn("fingerprint", hex_long(F.col("fp"))).drop("fp")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest key; columns unchanged.
    A key on several rows stays if any of them stands for its group; rows with a null key stay."""
    g = simhash_groups(docs, key, text)
    gone = g.where(F.col(key).isNotNull()).groupBy(key).agg(F.max((F.col(key) == F.col("component_id")).cast("int")).alias("k")) \
        .where("k = 0").select(F.col(key).alias("gone"))
    gone = materialise(gone, "near-copies")
    return docs.join(gone, docs[key] == gone["gone"], "left_anti")
