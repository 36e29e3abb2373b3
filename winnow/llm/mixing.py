"""Mixing sources to target weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import attach
from .common import SPACES, materialise, text_of

ENTROPY = 0.97        # of the entropy of equal shares
MAX_REPEATS = 3.0     # times a source's tokens may be used
BLOCK_TOKENS = 1 << 20
SUBBLOCK_ROWS = 4096
LOOKUP_BYTES = 16 << 20
PROBES, PASSES = 31, 7  # each pass cuts the bracket of the exponent by 32: 35 halvings in all


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACES), lambda w: w != ""))


def _unit(key: Column, epoch: Column, seed: int) -> Column:
    """Place of a row in the permutation of an epoch: a 63-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), epoch.cast("int")), 1)


def temperature(totals: DataFrame, budget: float, entropy: float, repeats: float) -> float:
    """Exponent in [0, 1] on the token shares: the largest that reaches the entropy, or, where that would use a source
    more than ``repeats`` times, the smallest that does not.

    Entropy and repetition both fall as the exponent rises, so one bracket is halved for both.  A pass over the table
    of sources tries 31 exponents at once."""
    live = totals.where("t > 0")
    one = live.agg(F.sum("t"), F.count(F.lit(1))).first()
    if not one[1]:
        return 1.0
    total, need = float(one[0]), entropy * math.log(one[1])
    p = F.col("t") / F.lit(total)

    def rising(points: list[float]) -> list[bool]:
        got = live.agg(*[x for e in points for x in (
            F.sum(F.pow(p, F.lit(e))), F.sum(F.pow(p, F.lit(e)) * F.log(p)), F.max(F.pow(p, F.lit(e - 1))))]).first()
        out = []
        for i, e in enumerate(points):
            z, zl, top = got[3 * i:3 * i + 3]
            out.append(math.log(z) - e * zl / z >= need - 1e-12 or budget / total * top / z > repeats * (1 + 1e-12))
        return out

    low, high = 0.0, 1.0
    if rising([1.0])[0]:
        return 1.0
    for _ in range(PASSES):
        points = [low + (high - low) * i / (PROBES + 1) for i in range(1, PROBES + 1)]
        ups = rising(points)
        n = ups.index(False) if False in ups else PROBES
        low, high = points[n - 1] if n else low, points[n] if n < PROBES else high
    return high if low else 0.0 if rising([0.0])[0] is False else high


def mixing_plan(docs: DataFrame, budget: float | None = None, entropy: float = ENTROPY, repeats: float = MAX_REPEATS,
                seed: int = 7, key: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(plan, rows).  Plan: src, t (tokens), n (rows), weight, quota, full (whole epochs), cut (rows of the last epoch up
    to this place are used).  Rows: id, src, tok of every document.

    A source's weight is its token share to the power found by ``temperature``, normalised; its quota is weight * budget
    (by default the tokens there are).  The last, partial epoch of a source is cut where its quota ends: token sums of
    sub-blocks of the permutation find the sub-block that holds the end, and only its rows are summed one by one, so no
    task sees all rows of a source.  The quota is never exceeded."""
    src = F.when(docs[source].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), docs[source].cast("string")))
    rows = materialise(docs.select(docs[key].alias("id"), src.alias("src"), word_count(text_of(docs, text)).cast("bigint").alias("tok")), "mix-rows")
    totals = materialise(rows.groupBy("src").agg(F.sum("tok").alias("t"), F.count(F.lit(1)).alias("n")), "mix-sources")
    every = totals.agg(F.sum("t")).first()[0] or 0
    budget = float(every if budget is None else budget)
    e = temperature(totals, budget, entropy, repeats)
    share = F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(float(max(every, 1))), F.lit(e))).otherwise(0.0)
    z = totals.agg(F.sum(share)).first()[0] or 1.0
    weight = share / F.lit(float(z) or 1.0)
    bits = F.greatest(F.ceil(F.log2(F.col("n") / SUBBLOCK_ROWS)), F.lit(0)).cast("int")
    plan = totals.withColumn("weight", weight).withColumn("quota", F.floor(F.col("weight") * F.lit(budget) + F.lit(1e-6))) \
        .withColumn("full", F.when(F.col("t") > 0, F.floor(F.col("quota") / F.col("t"))).otherwise(1).cast("int")) \
        .withColumn("part", F.when(F.col("t") > 0, F.col("quota") - F.col("full") * F.col("t")).otherwise(0).cast("bigint")) \
        .withColumn("width", 63 - bits)
    plan = materialise(plan, "mix-plan")

    last = look_up(rows, plan, ["full", "part", "width"]).where("part > 0") \
        .withColumn("u", _unit(F.col("id"), F.col("full"), seed)) \
        .withColumn("sub", F.expr("shiftright(u, width)"))
    subs = last.groupBy("src", "sub").agg(F.sum("tok").alias("t"), F.first("part").alias("part"), F.first("width").alias("width"))
    run = Window.partitionBy("src").orderBy("sub")
    subs = subs.withColumn("before", F.sum("t").over(run) - F.col("t")).where("before <= part and part < before + t") \
        .select("src", F.col("sub").alias("at"), "before", F.expr("shiftleft(sub, width) - 1").alias("floor"))
    subs = materialise(subs, "mix-cuts")
    inside = look_up(last, subs, ["at", "before"]).where("sub = at")
    upto = inside.withColumn("sum", F.col("before") + F.sum("tok").over(
        Window.partitionBy("src").orderBy("u").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    cut = upto.where("sum <= part").groupBy("src").agg(F.max("u").alias("u"))
    cuts = subs.join(cut, "src", "left").select("src", F.coalesce("u", "floor").alias("cut"))
    done = plan.join(cuts, "src", "left").select("src", "t", "n", "weight", "quota", "full", F.coalesce("cut", F.lit(-1)).alias("cut"))
    return materialise(done, "mix-weights"), rows


def look_up(rows: DataFrame, plan: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the plan for each row's source: sent to all tasks if its measured bytes allow, else by a join that
    spreads the rows of large sources."""
    had = plan.agg(F.sum(F.octet_length("src") + 32)).first()[0] or 0
    small = plan.select("src", *columns)
    if had <= LOOKUP_BYTES:
        return rows.join(F.broadcast(small), "src")
    n = rows.groupBy("src").agg(F.count(F.lit(1)).alias("_n"))
    return attach(rows, small.join(n, "src"), ["src"], "_n").where(F.col(columns[0]).isNotNull())


def _copies(seed: int) -> Column:
    return F.filter(F.sequence(F.lit(0), F.col("full")), lambda e: (e < F.col("full")) | (_unit(F.col("id"), e, seed) <= F.col("cut")))


def mix_documents(docs: DataFrame, budget: float | None = None, entropy: float = ENTROPY, repeats: float = MAX_REPEATS,
                  seed: int = 7, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed rows, columns as in ``docs``: each document once for every copy its source's quota takes.  Texts are not
    shuffled.  Null sources are a source of their own; sources without a word cost nothing and stay once; rows of one key
    in one source stand or fall together; an empty table gives an empty one."""
    plan, _ = mixing_plan(docs, budget, entropy, repeats, seed, key, source, text)
    src = F.when(docs[source].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), docs[source].cast("string")))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("id"), src.alias("src"))
    out = look_up(whole, plan, ["full", "cut"]).withColumn("copy", F.explode(_copies(seed)))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def mix_blocks(docs: DataFrame, budget: float | None = None, entropy: float = ENTROPY, repeats: float = MAX_REPEATS,
               block_tokens: int = BLOCK_TOKENS, seed: int = 7, key: str = "doc_id", source: str = "source",
               text: str = "text") -> DataFrame:
    """key, source, copy, n_tokens, weight, block, place: the mix as blocks of ``block_tokens`` tokens.

    Each block takes the same share of every source's quota, so every block has the target weights up to one document a
    source; ``place`` permutes the rows inside a block.  Positions are sums over sub-blocks plus a window inside one."""
    plan, rows = mixing_plan(docs, budget, entropy, repeats, seed, key, source, text)
    blocks = F.greatest(F.ceil(F.lit(float(plan.agg(F.sum("quota")).first()[0] or 0)) / block_tokens), F.lit(1))
    out = look_up(rows, plan, ["full", "cut", "t", "n", "weight", "quota"]).withColumn("copy", F.explode(_copies(seed)))
    width = 63 - F.greatest(F.ceil(F.log2(F.col("n") / SUBBLOCK_ROWS)), F.lit(0)).cast("int")
    out = out.withColumn("u", _unit(F.col("id"), F.col("copy"), seed)).withColumn("width", width) \
        .withColumn("sub", F.expr("shiftright(u, width)")).drop("width")
    sums = out.groupBy("src", "copy", "sub").agg(F.sum("tok").alias("t"))
    run = Window.partitionBy("src", "copy").orderBy("sub")
    sums = sums.withColumn("before", F.sum("t").over(run) - F.col("t")).drop("t")
    inside = Window.partitionBy("src", "copy", "sub").orderBy("u", "id").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("in", F.coalesce(F.sum("tok").over(inside), F.lit(0))).join(sums, ["src", "copy", "sub"])
    at = F.col("copy") * F.col("t") + F.col("before") + F.col("in")
    block = F.least(F.floor(at / F.greatest("quota", F.lit(1)) * blocks), blocks - 1)
    return out.select(F.col("id").alias(key), F.when(F.col("src") != "", F.expr("substr(src, 2)")).alias(source), "copy",
                      F.col("tok").alias("n_tokens"), "weight", block.cast("bigint").alias("block"), F.col("u").alias("place"))
