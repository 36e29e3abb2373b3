"""Personal data: base patterns, and terms that reveal them by co-occurrence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

# Kinds in order, the base patterns, and the test that a text can hold a match at all.  The possessive and
# look-behind forms accept the same matches as the plain ones without backtracking over long runs.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]+\."),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
KINDS = (*PATTERNS, "term")
TERM = r"[\p{L}\p{M}\p{N}]{2,}"
CONTEXT = 100          # code points on either side of an entity that tell copies of a passage from other passages
UNSEEN = 2.0           # contexts without the entity a term is taken to have besides those seen: smooths few contexts
GENERALISE, REMOVE = 0.8, 0.95  # of the entity's information that a term gives away
LOOKUP_BYTES = 16 << 20
ENTITIES = "array<struct<entity:string,context:bigint>>"
SPAN = "array<struct<s:int,e:int,v:string>>"


def spans_of(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """(s, e, v) of leftmost non-overlapping matches, in code points: the gaps between matches are matched with them, and
    their lengths added up.  ``keep`` tells from a match whether it is wanted."""
    whole = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    pieces = F.zip_with(F.regexp_extract_all(text, whole, F.lit(1)), F.regexp_extract_all(text, whole, F.lit(2)),
                        lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), hit.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.char_length(x["hit"])
        one = F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("v")))
        return F.struct(e.alias("at"), F.when(x["hit"] != "" if keep is None else (x["hit"] != "") & keep(x["hit"]), F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(pieces, start, step, lambda acc: acc["found"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, v: Column) -> Column:
    if kind == "ip":
        def small(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0+(?=.)", "")
            return (F.char_length(bare) <= 3) & (F.lpad(bare, 3, "0") <= "255")
        return F.forall(F.split(v, r"\."), small)
    if kind == "card":
        return F.char_length(_digits(v)).between(12, 19) & _luhn(_digits(v))
    if kind == "phone":
        return F.char_length(_digits(v)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (s, k, e, v) of all base matches, by start and kind number."""
    def one(k: int, kind: str, pattern: str, hint: str) -> Column:
        hits = F.filter(spans_of(text, pattern), lambda x: _holds(kind, x["v"]))
        rows = F.transform(hits, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["v"].alias("v")))
        return F.when(text.rlike(hint), rows).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,v:string>>"))

    return F.array_sort(F.concat(*[one(k, kind, *p) for k, (kind, p) in enumerate(PATTERNS.items())]))


def _entities(text: Column, base: Column) -> Column:
    """(entity, context) of each entity name among the base matches: a hash of what stands around its first match."""
    def around(b: Column) -> Column:
        low = F.greatest(b["s"] - CONTEXT, F.lit(0))
        return F.struct(F.concat_ws(":", b["k"].cast("string"), F.lower(b["v"])).alias("entity"),
                        F.xxhash64(F.substring(text, low + 1, b["e"] - low + CONTEXT)).alias("context"))

    first = F.struct(F.array().cast(ENTITIES).alias("out"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, x: Column) -> Column:
        new = ~F.array_contains(acc["names"], x["entity"])
        return F.struct(F.when(new, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"),
                        F.when(new, F.concat(acc["names"], F.array(x["entity"]))).otherwise(acc["names"]).alias("names"))

    return F.aggregate(F.transform(base, around), first, step, lambda acc: acc["out"])


def _look_up(rows: DataFrame, table: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with a written table, sent to all tasks if its measured text allows."""
    size = table.agg(F.sum(sum(F.octet_length(c) + 16 for c in on))).first()[0] or 0
    return rows.join(F.broadcast(table) if size <= LOOKUP_BYTES else table, on, how)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _share(total: int) -> Column:
    n = F.lit(float(max(total, 1)))
    gain = F.log2(n * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) - F.log2(1 + UNSEEN / F.col("contexts"))
    return F.when(F.col("n_e") < n, gain / F.log2(n / F.col("n_e"))).otherwise(0.0)


def disclosing_terms(found: DataFrame, docs: DataFrame, text: str = "text", generalise: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """(entity, term, share) of terms that give away at least ``generalise`` of an entity's information, and (row, entity,
    context, term) of the pairs of a whole text that can be such.

    With N documents, n(e), n(t) and n(e, t) holding the entity, the term and both, and c different contexts of the entity in
    the documents with both, share = (log2(N n(e, t) / (n(e) n(t))) - log2((c + 2) / c)) / log2(N / n(e)): near 1 if the term
    is seen nowhere else and often enough.  Few contexts lower the share and never rule a pair out; copies of a passage are
    one context.  Counts are exact and run over all documents."""
    total = found.count()
    near = found.select("row", F.explode("near").alias("x")).select("row", "x.entity", "x.context")
    entity = materialise(near.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")), "entities")
    # the share allows at most this many texts with the term, if n(e, t) = n(e) and all contexts differ
    n = float(max(total, 1))
    most = F.pow("n_e", F.lit(generalise)) * n ** (1 - generalise) * F.col("n_e") / (F.col("n_e") + UNSEEN) * (1 + 1e-9)
    held = _look_up(near, entity, ["entity"], "inner").withColumn("most", most).where("most >= 1") \
        .groupBy("row").agg(F.max("most").alias("top"), F.collect_list(F.struct("entity", "context", "most")).alias("x"))
    top = entity.agg(F.max(most)).first()[0] or 0.0
    # a term is in at least as many texts as it is in texts with an entity, which bounds its share from above
    terms = found.select("row", F.explode("terms").alias("term"))
    rare = materialise(terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_a")).where(F.col("n_a") <= top), "rare-terms")
    pairs = _look_up(terms, rare, ["term"], "inner").join(held, "row").where(F.col("n_a") <= F.col("top"))
    pairs = pairs.select("row", "term", F.explode(F.filter("x", lambda x: x["most"] >= F.col("n_a"))).alias("x"))
    pairs = materialise(pairs.select("row", "x.entity", "x.context", "term"), "row-pairs")
    both = pairs.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("contexts"))
    both = materialise(both.join(entity, "entity"), "term-pairs")
    known = materialise(both.select("term").distinct(), "terms")
    words = docs.select(F.explode(_terms(text_of(docs, text))).alias("term"))
    term = _look_up(words, known, ["term"], "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    share = both.join(term, "term").select("entity", "term", _share(total).alias("share"))
    return share.where(F.col("share") >= generalise), pairs


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base (spans), spans (base and disclosing terms) of every row; with ``carry`` also
    ``body``, the text, and ``src``, the other columns of ``docs``.

    A span is (s, k, e, v): start, kind number, end in code points, value; a term's value says "generalised" or "removed".
    A term is marked wherever it stands outside the base matches in a text that holds an entity it gives away.  Null texts
    count as empty; repeated rows are rows of their own; an empty table gives an empty result; other columns may have any
    name."""
    body = text_of(docs, text)
    held = docs.select(docs[key].alias("id"), body.alias("body"),
                       *([F.struct(*[docs[c] for c in docs.columns]).alias("src")] if carry else []))
    held = held.withColumn("base", base_spans(F.col("body")))
    some = F.size("base") > 0
    held = held.withColumn("near", F.when(some, _entities(F.col("body"), F.col("base"))).otherwise(F.array().cast(ENTITIES)))
    held = held.withColumn("terms", F.when(some, _terms(F.col("body"))).otherwise(F.array().cast("array<string>")))
    held = held.withColumn("row", F.monotonically_increasing_id())
    found = materialise(held if carry else held.withColumn("body", F.when(some, F.col("body"))), "personal")
    hidden, pairs = disclosing_terms(found, docs, text)
    marked = _look_up(pairs, materialise(hidden, "disclosing"), ["entity", "term"], "inner") \
        .groupBy("row", "term").agg(F.max("share").alias("share")) \
        .groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("hide"))
    out = found.join(marked, "row", "left")
    kind = lambda v: F.when(F.try_element_at("hide", F.lower(v)) >= REMOVE, "removed").otherwise("generalised")
    more = F.filter(spans_of(F.col("body"), TERM, lambda v: F.try_element_at("hide", F.lower(v)).isNotNull()),
                    lambda w: ~F.exists("base", lambda x: (x["s"] < w["e"]) & (w["s"] < x["e"])))
    more = F.transform(more, lambda w: F.struct(w["s"].alias("s"), F.lit(len(PATTERNS)).alias("k"), w["e"].alias("e"), kind(w["v"]).alias("v")))
    spans = F.when(F.col("hide").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", more)))
    kinds = F.transform("base", lambda x: x["k"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{n}") for k, n in enumerate(PATTERNS)]
    return out.select(F.col("id").alias(key), *counts, "base", spans.alias("spans"), *(["body", "src"] if carry else []))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with personal data replaced by its kind in brackets, disclosing terms by [TERM] or nothing; other columns and
    null texts unchanged."""
    found = find_personal(docs, key, text, carry=True)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    body = F.col("body")

    def step(acc: Column, x: Column) -> Column:
        put = F.when(x["v"].eqNullSafe("removed") & (x["k"] == len(PATTERNS)), "").otherwise(F.get(names, x["k"]))
        free = x["s"] >= acc["at"]
        out = F.when(free, F.concat(acc["out"], F.substring(body, acc["at"] + 1, x["s"] - acc["at"]), put)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.char_length(body))))
    return found.select(*[(F.when(F.col("src").getField(c).isNotNull(), clean) if c == text else F.col("src").getField(c)).alias(c)
                          for c in docs.columns])
