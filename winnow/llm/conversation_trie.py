"""Prefix trie of conversations by the Euler-tour technique.

A node is a sequence of turns; its key is a sum of hashes of (position, turn), so the keys of all prefixes of a
conversation are running sums, which blocks of a long conversation compute apart.  Each node gives two arcs, one that enters
its subtree and one that leaves it; each arc names its successor on the tour around the trie.  The tour is ranked by list
contraction: in each round the arcs whose hash is larger than those of both neighbours (a third of all) are spliced
out and their weights go to the arc before, until few enough for one task are left; then the rounds are undone.  The sum of
weights from where a subtree is entered to where it is left is the sum over the subtree."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions
from ..functions.keys import attach
from ..session import shared_dir

SUMS, BITS = 3, 40    # a node's key: three sums modulo 2^40
RUN = 1024            # turns whose hashes one window adds up
LAST = 20_000         # arcs that one task ranks
ROOT = "0" * (SUMS * BITS // 4)
_RANKED = "arc string, leaves bigint, saved bigint"


def _sorted_parts(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` dealt by ranges of ``order`` into even parts; ``lot`` numbers them in that order."""
    return df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("lot", F.spark_partition_id())


def ordered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 1), digest, chars of every turn.  Order: turn, null first, then the digest of role and text.

    A conversation may be longer than a task can hold: turns are numbered inside ranges of (conversation, turn), and the
    numbers of the ranges before are added."""
    who, said = (F.coalesce(turns[x].cast("string"), F.lit("")) for x in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256))
    plain = turns.where(turns[conv].isNotNull()).select(
        turns[conv].cast("bigint").alias("conv"), turns[turn].alias("turn"), digest.alias("digest"), F.length(said).cast("bigint").alias("chars"))
    order = (F.col("turn").asc_nulls_first(), F.col("digest"))
    parts = materialise(_sorted_parts(plain.withColumn("tie", F.monotonically_increasing_id()), F.col("conv"), *order, F.col("tie")).drop("tie"), "turns")
    before = Window.partitionBy("conv").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.groupBy("conv", "lot").agg(F.count(F.lit(1)).alias("n")) \
        .select("conv", "lot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = parts.withColumn("pos", F.row_number().over(Window.partitionBy("conv", "lot").orderBy(*order)))
    return numbered.join(offset, ["conv", "lot"]).select("conv", (F.col("pos") + F.col("offset")).alias("pos"), "digest", "chars")


def rebuilt_turns(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """((conv, d, digest, chars, size), (conv, size)): conversation c is the first h turns of conversation c - c % ``group``, then
    its own turns after the first h; h is crc32(c) % ``most``.  ``size`` is the number of its turns, which may be none."""
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    own = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % group).alias("base"),
                       (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"))
    heads = sizes.select(F.col("conv").alias("base"), F.col("n").alias("there"))
    plan = own.join(heads, "base", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0)))) \
        .withColumn("size", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = materialise(plan.select("conv", "base", "h", "m", "size"), "conversations")
    first = turns.where((F.col("conv") % group == 0) & (F.col("pos") < most)).withColumnRenamed("conv", "base")
    front = plan.join(first, "base").where("pos <= m").select("conv", F.col("pos").alias("d"), "digest", "chars", "size")
    back = turns.join(plan.select("conv", "h", "m", "size"), "conv").where("pos > h") \
        .select("conv", (F.col("m") + F.col("pos") - F.col("h")).alias("d"), "digest", "chars", "size")
    return front.union(back), plan.select("conv", "size")


def prefix_keys(turns: DataFrame) -> DataFrame:
    """conv, d, key, parent, chars, size: ``key`` stands for the first d turns, ``parent`` for the first d - 1."""
    mixed = F.sha2(F.concat(F.col("d").cast("string").cast("binary"), F.lit(b":"), F.col("digest")), 256)
    width = BITS // 4
    lanes = [F.conv(F.substring(mixed, 1 + width * i, width), 16, 10).cast("bigint").alias(f"x{i}") for i in range(SUMS)]
    parts = turns.select("conv", "d", "chars", "size", F.expr(f"(d - 1) div {RUN}").alias("run"), *lanes)
    inside = Window.partitionBy("conv", "run").orderBy("d")
    summed = parts.select("*", *[F.sum(f"x{i}").over(inside).alias(f"s{i}") for i in range(SUMS)])
    before = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    whole = parts.groupBy("conv", "run").agg(*[F.pmod(F.sum(f"x{i}"), F.lit(1 << BITS)).alias(f"t{i}") for i in range(SUMS)])
    whole = whole.select("conv", "run", *[F.coalesce(F.sum(f"t{i}").over(before), F.lit(0)).alias(f"o{i}") for i in range(SUMS)])
    both = summed.join(whole, ["conv", "run"])

    def key(less: bool) -> Column:
        at = [F.col(f"o{i}") + F.col(f"s{i}") - (F.col(f"x{i}") if less else F.lit(0)) for i in range(SUMS)]
        return F.concat(*[F.lpad(F.hex(F.pmod(a, F.lit(1 << BITS))), width, "0") for a in at])

    return both.select("conv", "d", key(False).alias("key"), key(True).alias("parent"), "chars", "size")


def trie_nodes(entries: DataFrame, conversations: DataFrame) -> DataFrame:
    """key, parent, conv_id, depth, n_convs, saved of every node; the root has no parent."""
    nodes = entries.groupBy("key").agg(F.min("parent").alias("parent"), F.min("conv").alias("conv_id"), F.min("d").alias("depth"),
                                       F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"))
    root = conversations.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0") \
        .select(F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"), "conv_id", F.lit(0).cast("bigint").alias("depth"), "n_convs",
                F.lit(0).cast("bigint").alias("chars"))
    return nodes.union(root).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")).drop("chars")


def tour(nodes: DataFrame) -> DataFrame:
    """arc, pred, succ, leaves, saved: the Euler tour of a trie, children in the order of their keys.

    The next sibling is found inside even ranges of (parent, key), so the children of one node need no common task."""
    low = materialise(_sorted_parts(nodes.where("parent is not null").select("parent", "key"), F.col("parent"), F.col("key")), "siblings")
    edges = low.groupBy("lot").agg(F.min(F.struct("parent", "key")).alias("first"))  # one row a range
    edges = edges.select("lot", F.lead("first").over(Window.orderBy("lot")).alias("after"))
    later = F.when(F.col("after.parent") == F.col("parent"), F.col("after.key"))
    after = low.withColumn("next", F.lead("key").over(Window.partitionBy("parent", "lot").orderBy("key"))) \
        .join(F.broadcast(edges), "lot", "left").select("key", "parent", F.coalesce("next", later).alias("next"))
    child = nodes.groupBy("parent").agg(F.min("key").alias("child")).withColumnRenamed("parent", "key")
    enter, leave = F.lit("e"), F.lit("x")
    down = nodes.join(child, "key", "left").select(
        F.concat(enter, "key").alias("arc"), F.coalesce(F.concat(enter, "child"), F.concat(leave, "key")).alias("succ"),
        F.col("child").isNull().cast("bigint").alias("leaves"), "saved")
    zero = F.lit(0).cast("bigint")
    up = after.select(F.concat(leave, "key").alias("arc"), F.coalesce(F.concat(enter, "next"), F.concat(leave, "parent")).alias("succ"),
                      zero.alias("leaves"), zero.alias("saved"))
    end = nodes.where("parent is null").select(F.concat(leave, "key").alias("arc"), F.lit(None).cast("string").alias("succ"), zero.alias("leaves"), zero.alias("saved"))
    links = materialise(down.union(up).union(end), "arcs")
    back = links.where("succ is not null").select(F.col("succ").alias("arc"), F.col("arc").alias("pred"), F.lit(None).cast("string").alias("succ"),
                                                  zero.alias("leaves"), zero.alias("saved"))
    return links.select("arc", F.lit(None).cast("string").alias("pred"), "succ", "leaves", "saved").union(back) \
        .groupBy("arc").agg(F.max("pred").alias("pred"), F.max("succ").alias("succ"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _walk(arcs: pd.DataFrame) -> pd.DataFrame:
    """Sums from each arc to the end of a short list."""
    row = {a: i for i, a in enumerate(arcs["arc"])}
    succ = [row.get(s, -1) for s in arcs["succ"]]
    at = (set(range(len(arcs))) - set(succ)).pop() if len(arcs) else -1
    order = []
    while at >= 0:
        order.append(at)
        at = succ[at]
    back = arcs.iloc[order[::-1]]
    return pd.DataFrame({"arc": back["arc"], "leaves": back["leaves"].cumsum(), "saved": back["saved"].cumsum()})


def _spliced(n: int) -> Column:
    """Whether round n takes an arc out: no two neighbours, and neither end of the list."""
    own, before, after = (F.xxhash64(x, F.lit(n)) for x in ("arc", "pred", "succ"))
    return F.col("pred").isNotNull() & F.col("succ").isNotNull() & (own > before) & (own > after)


def list_sums(arcs: DataFrame, last: int = LAST) -> DataFrame:
    """arc, leaves, saved: the sums from each arc to the end of the list (arc, pred, succ, leaves, saved).

    Each round takes one shuffle of what is left, about two thirds of the round before."""
    spark = arcs.sparkSession
    rounds, left = [materialise(arcs, "list-0")], None
    while left is None or left > last:
        now, n = rounds[-1], len(rounds)
        if left is None:
            left = now.count()
            continue
        out, none, zero = _spliced(n), F.lit(None).cast("string"), F.lit(0).cast("bigint")
        stay = now.where(~out).select("arc", "pred", "succ", none.alias("npred"), none.alias("nsucc"), "leaves", "saved")
        ahead = now.where(out).select(F.col("pred"), none, none, none, F.col("succ"), "leaves", "saved")
        behind = now.where(out).select(F.col("succ"), none, none, F.col("pred"), none, zero, zero)
        step = stay.union(ahead).union(behind).groupBy("arc").agg(
            F.coalesce(F.max("npred"), F.max("pred")).alias("pred"), F.coalesce(F.max("nsucc"), F.max("succ")).alias("succ"),
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        rounds.append(materialise(step, f"list-{n}"))
        left = rounds[-1].count()
    folder = f"{shared_dir(spark)}/winnow-ranked-{uuid.uuid4().hex[:8]}"
    done = spark.read.schema(f"{_RANKED}, round int")
    rounds[-1].groupBy(F.length("arc") * 0).applyInPandas(_walk, _RANKED).write.parquet(f"{folder}/round={len(rounds)}")
    for n in range(len(rounds) - 1, 0, -1):
        known = done.parquet(folder).select(F.col("arc").alias("succ"), F.col("leaves").alias("l"), F.col("saved").alias("s"))
        rounds[n - 1].where(_spliced(n)).join(known, "succ").select("arc", (F.col("leaves") + F.col("l")).alias("leaves"), (F.col("saved") + F.col("s")).alias("saved")) \
            .write.parquet(f"{folder}/round={n}")
    return done.parquet(folder).drop("round")


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the joined texts of each key; rows come sorted by key and part, a key may go on in the next batch."""
    key, h = None, None
    for b in batches:
        done = []
        for k, ids in zip(b["key"], b["ids"], strict=True):
            if k != key:
                if h is not None:
                    done.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])
    if h is not None:
        yield pd.DataFrame([(key, h.hexdigest())], columns=["key", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of (key, conv): the ids of each key in ascending order, comma-joined.

    The ids of a range are joined first, so that a key that ends many conversations is one row a range when its hash,
    which has to read them in order, is taken."""
    n = partitions(ends.sparkSession)
    part = _sorted_parts(ends, F.col("conv")).groupBy("key", "lot").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))
    return part.repartition(n, "key").sortWithinPartitions("key", "lot").select("key", "ids").mapInPandas(_digest, "key string, ends_sha256 string")


def conversation_trie(turns: DataFrame, group: int = 100, most: int = 6, last: int = LAST, conv: str = "conv_id", turn: str = "turn",
                      role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row a node of the trie.

    Turns are ordered by ``turn``, null first, ties by the digest of role and text, and conversations rebuilt as
    ``rebuilt_turns`` says.  conv_id is the smallest conversation through the node, which the depth makes a key; the root has
    depth 0 and no parent; a conversation without turns ends at the root.  Null roles and texts are empty, rows with a null
    conversation belong to none, repeated rows are repeated turns.  An empty table has no node.  Other columns are not read."""
    numbered = materialise(ordered_turns(turns, conv, turn, role, text), "numbered")
    rebuilt, conversations = rebuilt_turns(numbered, group, most)
    entries = materialise(prefix_keys(rebuilt), "prefixes")
    nodes = materialise(trie_nodes(entries, conversations), "trie")
    ends = entries.where("d = size").select("key", "conv").union(conversations.where("size = 0").select(F.lit(ROOT), "conv"))
    digests = ends_digest(ends)
    sums = list_sums(tour(nodes), last)
    sign = F.when(F.col("arc").startswith("e"), F.lit(1)).otherwise(F.lit(-1))
    subtree = sums.groupBy(F.expr("substring(arc, 2)").alias("key")).agg(
        F.sum(F.col("leaves") * sign).alias("n_leaves"), F.sum(F.col("saved") * sign).alias("saved_tokens"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    known = nodes.drop("saved").join(children, "key", "left").join(subtree, "key", "left").join(digests, "key", "left")
    known = materialise(known.fillna(0, ["n_children"]), "trie-sums")
    parents = known.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("held"))
    out = attach(known, parents, ["parent"], "held")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
