"""Near-duplicate category spellings by edit distance, without comparing all pairs.

Two strings within t edits share at least one of t+1 segments of the shorter one, at nearly the
same place.  Segments are the join key; only values that share one are compared.  The method
is exact: every pair above the threshold is found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import c, require, strip
from ..functions.text import title_case

EPS = 1e-9


def fuzzy_categories(df: DataFrame, column: str, threshold: float = 0.82) -> DataFrame:
    """(value, canonical, partners): values with a similar but different spelling and the title-cased
    longest spelling among them (the smallest one on equal lengths).

    Similarity is 1 - edits / length of the longer one, on trimmed lower-case text."""
    require(df, column)
    loss = 1.0 - threshold
    x = strip(c(column).cast("string"))
    v = (df.select(F.lower(x).alias("t"), x.alias("raw")).where("t <> ''")
         .groupBy("t").agg(F.min("raw").alias("raw")))
    n = F.length("t")

    def allowed(length):
        return F.floor(length * loss + EPS).cast("int")

    # segments of the shorter string: one more than the edits its longest possible partner allows
    def parts(length):
        longest = F.floor(length / threshold + EPS)
        return (allowed(longest) + 1).cast("int")

    def start(length, k, i):
        """Even split, the longer segments last."""
        base, extra = F.floor(length / k).cast("int"), (length % k).cast("int")
        return (i * base + F.greatest(F.lit(0), i - (k - extra))).cast("int")

    short = v.withColumns({"l": n, "k": parts(n)}).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    short = short.withColumns({"a": start(F.col("l"), F.col("k"), F.col("i")), "b": start(F.col("l"), F.col("k"), F.col("i") + 1)})
    short = short.select("l", "i", F.expr("substring(t, a + 1, b - a)").alias("seg"), F.col("t").alias("s"),
                         F.col("raw").alias("s_raw"), "k")

    long = v.withColumns({"big": n, "e": allowed(n)}).where("e > 0")
    long = long.withColumn("l", F.explode(F.sequence(F.col("big") - F.col("e"), F.col("big"))))
    long = long.withColumn("k", parts(F.col("l"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    long = long.withColumns({"a": start(F.col("l"), F.col("k"), F.col("i")), "b": start(F.col("l"), F.col("k"), F.col("i") + 1)})
    lo = F.greatest(F.lit(0), F.col("a") - F.col("e"))
    hi = F.least(F.col("big") - (F.col("b") - F.col("a")), F.col("a") + F.col("e"))
    long = long.where(lo <= hi).withColumn("at", F.explode(F.sequence(lo, hi)))
    long = long.select("l", "i", F.expr("substring(t, at + 1, b - a)").alias("seg"), F.col("t").alias("r"),
                       F.col("raw").alias("r_raw"), "big", "e").distinct()

    # a pair is compared once: at the first segment of s that r holds near its place, equal lengths from the smaller text
    def held(j):
        j = j.cast("int")
        a, b = start(F.col("l"), F.col("k"), j), start(F.col("l"), F.col("k"), j + 1)
        lo = F.greatest(F.lit(0), a - F.col("e"))
        hi = F.least(F.col("big"), b + F.col("e"))
        return F.instr(F.substring(F.col("r"), lo + 1, hi - lo), F.substring(F.col("s"), a + 1, b - a)) > 0

    once = (F.col("l") < F.col("big")) | (F.col("s") < F.col("r"))
    earlier = (F.col("i") > 0) & F.exists(F.sequence(F.lit(0), F.greatest(F.col("i") - 1, F.lit(0))), held)
    edits = F.expr("levenshtein(s, r, e)")  # -1 beyond the edits allowed
    close = (edits >= 0) & (1.0 - edits / F.col("big") >= threshold - EPS)
    pairs = short.join(long, ["l", "i", "seg"]).where(once).where(~earlier).where(close)
    # one candidate per side; the best is a partially aggregated minimum, pairs are not kept
    sides = F.array(F.struct(F.col("s").alias("t"), F.col("s_raw").alias("raw"), F.col("r_raw").alias("o_raw")),
                    F.struct(F.col("r").alias("t"), F.col("r_raw").alias("raw"), F.col("s_raw").alias("o_raw")))
    flat = pairs.select(F.inline(sides))
    rank = lambda y: F.struct((-F.length(y)).alias("l"), c(y).alias("v"))
    g = flat.groupBy("t").agg(F.least(F.min(rank("o_raw")), F.min(rank("raw"))).alias("best"), F.min("raw").alias("value"),
                              F.count(F.lit(1)).alias("partners"))
    return g.select("value", title_case(F.col("best.v")).alias("canonical"), "partners")


def apply_categories(df: DataFrame, column: str, suggestions: DataFrame) -> DataFrame:
    """Replace each value by its canonical spelling; a suggestion table is as small as the values it names."""
    from ..functions.keys import attach

    t = suggestions.select(F.lower(F.col("value")).alias("_t"), "canonical", F.lit(1).alias("_rows"))
    d = df.withColumn("_t", F.lower(strip(c(column).cast("string"))))
    return attach(d, t, ["_t"], "_rows").withColumn(column, F.coalesce("canonical", c(column))).drop("_t", "canonical")
