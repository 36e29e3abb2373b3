"""Phrase collocation mining by dynamic itemset counting.

The texts are dealt to shards, which are scanned in turn, again and again.  Single words are counted from the first scan on; a
longer phrase is activated as soon as both its parts without the last and without the first word have reached the
threshold, in the middle of a cycle, and is then counted in each shard once.  So phrases of all lengths are counted in one
scan, and few scans more than one cycle are needed.

When a phrase was activated must be the same in all tasks and all scans.  A table of ``cells`` bytes says it: a phrase that
reaches the threshold after scan t writes t to its hash cells that are still empty, and a part has been reached when all its
cells are filled, at the largest number in them.  Cells that collide activate a phrase early, never twice, so counts stay
exact; the table has a fixed size, whatever the corpus."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, text_of
from ..session import shared_dir

WORDS = 4            # words of the longest phrase
SHARDS = 2   # fewer shards: fewer merges of the running counts; more: phrases of all lengths sooner
CELLS = 1 << 23      # bytes of the table of reached phrases
BLOCK = 8 << 20      # bytes of text counted at once
NEVER = 255
_CLEAN = bytes(ord(" ") if i == 9 else 10 if bytes([i]) in b".,;:!?\n\v\f\r" else i + 32 if 65 <= i <= 90 else i for i in range(256))
_PARTIAL = "lang string, phrase string, k int, start int, c bigint"


def cell_places(h: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """The three cells of each hash; ``cells`` is a power of two."""
    return np.stack([(h >> np.uint64(s)).astype(np.int64) & (cells - 1) for s in (0, 20, 40)])


def word_hash(words: pa.Array, lang: str) -> np.ndarray:
    seed = zlib.crc32(lang.encode("utf-8", "surrogatepass"))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(words))


def grow_hash(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word behind it."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
        return x ^ (x >> np.uint64(29))


def split_words(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of cleaned bytes, and the number of the piece that each belongs to."""
    raw = np.frombuffer(data, dtype=np.uint8)
    stop = raw == 10
    inside = ~(stop | (raw == 32))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    offsets = np.append(0, np.cumsum(end - begin)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    return words, np.cumsum(stop, dtype=np.int32)[begin]


def blocks_of(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of at most about ``size`` bytes, cut between pieces."""
    at = 0
    while at < len(data):
        to = at + size
        if to < len(data):
            cut = data.rfind(b"\n", at, to) + 1
            to = cut or data.find(b"\n", to) + 1 or len(data)
        yield data[at:to]
        at = to


def count_block(data: bytes, lang: str, reached: np.ndarray, step: int, shards: int, words: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases that are active while the scan ``step`` reads these bytes; k is 0 for the number of all words."""
    text, piece = split_words(data)
    if not len(text):
        return
    coded = text.dictionary_encode()
    ids, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    v = len(known)

    def batch(phrases: pa.Array, k: int, start: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        n = len(phrases)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), phrases.cast(pa.string()), pa.array(np.full(n, k), pa.int32()),
                                           pa.array(start, pa.int32()), pa.array(c, pa.int64())], names=["lang", "phrase", "k", "start", "c"])

    if step < shards:
        yield batch(known, 1, np.zeros(v), np.bincount(ids, minlength=v))
        yield batch(pa.array([""]), 0, np.zeros(1), np.array([len(ids)]))
    if step == 0 or words < 2:
        return
    h = word_hash(known, lang)
    since = reached[cell_places(h, len(reached))].max(axis=0)  # scan after which each word was over the threshold
    # Phrases of k words, by the place of their first word: place, hash, scan reached, exact number of the phrase
    at = np.flatnonzero(since[ids] != NEVER)
    hashes, since, number, distinct = h[ids[at]], since[ids[at]], ids[at], v
    for k in range(2, words + 1):
        nxt = np.flatnonzero((at[1:] == at[:-1] + 1) & (piece[np.minimum(at[1:] + k - 2, len(piece) - 1)] == piece[at[:-1]]))
        start = np.maximum(since[nxt], since[nxt + 1])
        at, last = at[nxt], ids[at[nxt] + k - 1]
        hashes = grow_hash(hashes[nxt], h[last])
        number = number[nxt] * v + last
        keys, first, number, c = np.unique(number, return_index=True, return_inverse=True, return_counts=True)
        open_now = (start[first] <= step) & (step < start[first].astype(np.int64) + shards)
        places = at[first[open_now]]
        if len(places):
            yield batch(pc.binary_join_element_wise(*[known.take(pa.array(ids[places + i])) for i in range(k)], pa.scalar(" ", pa.large_string())), k, start[first[open_now]], c[open_now])
        if k == words or not len(at):
            return
        since = reached[cell_places(hashes, len(reached))].max(axis=0)
        on = since != NEVER
        at, hashes, since, number = at[on], hashes[on], since[on], number[on]
        left, number = np.unique(number, return_inverse=True)  # numbers stay below 2^63: phrases of a block times words of it


def _scan(shard: DataFrame, reached: np.ndarray, step: int, shards: int, words: int, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                for data in blocks_of(b"\n".join(parts).translate(_CLEAN), block):
                    yield from count_block(data, lang, reached, step, shards, words)

        for b in batches:
            if not b.num_rows:
                continue
            langs, texts = b.column(0).dictionary_encode(), b.column(1)
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                some = texts.filter(pc.equal(langs.indices, i)).cast(pa.large_binary())
                held.setdefault(lang, []).append(b"\n".join(some.to_pylist()))
                size += len(held[lang][-1])
            if size > block or len(held) > 1000:
                yield from counted()
                held.clear()
                size = 0
        yield from counted()

    return shard.select("lang", "text").mapInArrow(run, _PARTIAL)


def _bits(phrases: DataFrame, cells: int) -> np.ndarray:
    """The cells of new phrases, as one bit a cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            h = np.zeros(b.num_rows, dtype=np.uint64)
            langs = b.column(0).to_pylist()
            for i, p in enumerate(b.column(1).to_pylist()):
                parts = [xxhash.xxh64_intdigest(w, zlib.crc32(langs[i].encode("utf-8", "surrogatepass"))) for w in p.split(" ")]
                one = np.array(parts[:1], dtype=np.uint64)
                for w in parts[1:]:
                    one = grow_hash(one, np.array([w], dtype=np.uint64))
                h[i] = one[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(cell_places(h, cells)), pa.int64())], names=["cell"])

    rows = phrases.select("lang", "phrase").mapInArrow(run, "cell bigint").groupBy(F.shiftright("cell", 5).alias("i")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 31 as int))")).alias("b")).toPandas()  # at most cells / 32 rows
    out = np.zeros(cells // 32, dtype=np.uint32)
    out[rows["i"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.int64).astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def phrase_counts(docs: DataFrame, least: int = 30, words: int = WORDS, shards: int = SHARDS, cells: int = CELLS, block: int = BLOCK,
                  text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, k, c of all phrases of 1 to ``words`` words that occur ``least`` times or more, and of the number of all
    words (k 0, phrase '').

    Each scan adds to a table of running counts; what has been through its whole cycle leaves it for the folder of results
    or, below the threshold, for good.  The driver sees at most ``cells`` bits a scan."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = f"{shared_dir(spark)}/winnow-phrases-{uuid.uuid4().hex[:8]}"
    docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), text_of(docs, text).alias("text"),
                F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard")) \
        .write.partitionBy("shard").parquet(f"{folder}/shards")
    texts = spark.read.schema("lang string, text string, shard int").parquet(f"{folder}/shards")
    schema = f"{_PARTIAL}, reached int"
    reached = np.full(cells, NEVER, dtype=np.uint8)
    step, latest = 0, 0
    while step < shards or latest > step - shards:  # something reached the threshold within the last cycle
        part = _scan(texts.where(F.col("shard") == step % shards), reached, step, shards, words, block).withColumn("reached", F.lit(None).cast("int"))
        if step:
            part = part.union(spark.read.schema(f"{schema}, done int").parquet(f"{folder}/state-{(step - 1) % 2}").where("done = 0").select(part.columns))
        total = part.groupBy("lang", "phrase", "k", "start").agg(F.sum("c").alias("c"), F.min("reached").alias("reached"))
        over = F.col("c") >= least
        total = total.withColumn("reached", F.coalesce("reached", F.when(over & (F.col("k") > 0), F.lit(step + 1))))
        through = F.col("start") + shards <= step + 1
        # 0: being counted; 1: counted, a result; 2: counted, but too rare (kept until the next scan replaces the table)
        total.withColumn("done", F.when(~through, 0).when(over | (F.col("k") == 0), 1).otherwise(2)) \
            .write.mode("overwrite").partitionBy("done").parquet(f"{folder}/state-{step % 2}")
        now = spark.read.schema(f"{schema}, done int").parquet(f"{folder}/state-{step % 2}")
        now.where("done = 1").select("lang", "phrase", "k", "c").write.parquet(f"{folder}/found/step={step}")
        bits = _bits(now.where((F.col("reached") == step + 1) & F.col("k").between(1, words - 1)), cells)
        step += 1
        if bits.any():
            latest = step
        reached[bits & (reached == NEVER)] = step
        if step == NEVER - 1:
            raise ValueError("too many scans for one byte a cell")
    return spark.read.schema("lang string, phrase string, k int, c bigint, step int").parquet(f"{folder}/found").drop("step")


def _whole(x: str) -> str:
    return f"cast({x} as decimal(20,0))"


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, cover: int = 80, words: int = WORDS, shards: int = SHARDS,
                 cells: int = CELLS, block: int = BLOCK, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``words`` words of each language.

    Texts are A-Z lower-cased and cut at ``.,;:!?`` and line ends into pieces, these at spaces and tabs into words; a phrase
    lies in one piece.  ``a`` counts it, overlaps included, and is ``least`` or more; cut after its first k words, l and r count the two parts and the score is
    floor(2000000 a / (l + r)); the lowest cut counts, ties to the smallest k.  A phrase inside a longer one that has at least ``cover`` per cent
    of its count is dropped.  Order: score and a descending, then the phrase's bytes.  A null lang counts as ``und``, null texts
    as empty; repeated rows count each; an empty table gives an empty result; other columns are not read."""
    found = phrase_counts(docs, least, words, shards, cells, block, text, lang)
    part = F.split("phrase", " ")
    many = found.where("k >= 2")
    inside: Column = F.array(*[F.when(F.col("k") >= i + w, F.array_join(F.slice(part, i + 1, w), " "))
                               for w in range(2, words) for i in range(words - w + 1)]) if words > 2 else F.array(F.lit(None).cast("string"))
    longer = many.where("k >= 3").select("lang", F.col("k").alias("of"), "c", F.explode(inside).alias("phrase")).where("phrase is not null") \
        .where(F.size(F.split("phrase", " ")) < F.col("of")).groupBy("lang", "phrase").agg(F.max("c").alias("most"))
    stay = many.join(longer, ["lang", "phrase"], "left").where(
        F.expr(f"most is null or 100 * {_whole('most')} < {cover} * {_whole('c')}")).select("lang", "phrase", "k", F.col("c").alias("a"))
    cuts = stay.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("left", F.array_join(F.slice(part, F.lit(1), F.col("cut")), " ")) \
        .withColumn("right", F.array_join(F.slice(part, F.col("cut") + 1, F.col("k")), " "))
    counts = found.where("k >= 1").select("lang", "phrase", "c")
    # a very frequent word stands in many phrases: Spark splits these joins where they are skewed
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("c").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("c").alias("r")), ["lang", "right"])
    scored = cuts.withColumn("score", F.expr(f"2000000 * {_whole('a')} div ({_whole('l')} + {_whole('r')})"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    few = best.withColumn("lot", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # two steps, so that no task ranks a whole language
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lot").orderBy(*order))).where(F.col("rank") <= top).drop("lot")
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    total = found.where("k = 0").select("lang", F.col("c").alias("n"))
    return few.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
