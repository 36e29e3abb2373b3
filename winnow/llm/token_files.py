"""Token ids in files: frequency-ranked, byte-aligned variable length, control bytes apart.

A folder holds two tables.  ``ids``: shard, key, n, control, data for every document, ascending by key inside a shard and
from shard to shard; ``ranks``: rank, token.  A document's ids are replaced by their frequency ranks; a rank takes 1 to 4
little-endian bytes in ``data``, and its length minus one is a two-bit code in ``control``, four codes a byte, first code lowest.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hex_long, partitions, range_of, sampled_cuts, small_batches, text_of
from ..session import shared_dir

SHARDS_PER_PARTITION = 2
MEMO = 1_200_000  # remembered words of a worker
LONGEST = 64      # bytes of a word that is remembered
SLICE = 4 << 20   # bytes of text encoded at once
SHARD_IDS = 32 << 20  # ids of a shard, about
AT_ONCE = 128     # new words encoded in one string
_PLACES = np.arange(4)
#: Lengths of the four values whose codes a control byte holds.
LENGTHS = np.stack([((np.arange(256) >> (2 * i)) & 3) + 1 for i in range(4)], axis=1)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers."""
    v = np.ascontiguousarray(ranks, dtype="<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    four[:len(v)] = code
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[_PLACES <= code[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers of ``encode_ranks``: a table gives four lengths for each control byte."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), dtype=np.uint8)
    out[_PLACES < lengths[:, None]] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(-1).view("<u4")


class _Encoder:
    """The tokenizer, asked once for each distinct word.

    Between two characters that are no white space, a space always begins a new piece of the byte-level split and a line
    feed is a piece of its own, so the ids of a word and of the space or line feed before it do not depend on what stands
    around them; nor do those of a full stop or comma after letters.  Texts with other white space, with two such
    characters in a row or with the string of an added token are encoded as a whole.

    A batch is cut into words as one array and each distinct word looked up once; the ids of a word lie in a pool, from where
    those of the whole batch are gathered.  When ``MEMO`` words are known, the half that was met least is forgotten."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added)) if added else "(?!)")  # a text with one is encoded as a whole
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.ends = dict(zip(".,\n", self._raw([".", ",", "\n"]), strict=True))
        vocab = self.tokenizer.get_vocab()
        self.opens = {}
        for mark in " \n":
            first = self.tokenizer.id_to_token(int(np.frombuffer(self._raw([mark + "x"])[0], dtype=self.kind)[0]))[:1]
            self.opens[mark] = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
            self.opens[mark][[i for t, i in vocab.items() if t.startswith(first)]] = True
        self.stops = {c.encode(): np.frombuffer(self.ends[c], dtype=self.kind).tolist() for c in ".,"}
        model, start = self.tokenizer.model, np.frombuffer(self.ends["\n"], dtype=self.kind).tolist()
        lead = self.tokenizer.id_to_token(int(np.frombuffer(self._raw([" x"])[0], dtype=self.kind)[0]))[:1]
        self.bare = {b" ": lambda w: [t.id for t in model.tokenize(lead + w)], b"\n": lambda w: [*start, *(t.id for t in model.tokenize(w))]}
        probes = ["a", "Word", "ofthe", "Q" * 40]
        if any(np.array(f(w), dtype=self.kind).tobytes() != x for m, f in self.bare.items()
               for w, x in zip(probes, self._raw([m.decode() + w for w in probes]), strict=True)):
            self.bare = {}  # a tokenizer with other steps before its model
        self.index: dict[bytes, int] = {}  # words with the mark before them
        self.first, self.size, self.met = (np.zeros(1024, dtype=np.int64) for _ in range(3))
        self.pool, self.used = np.zeros(4096, dtype=self.kind), 0

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, mark: str, new: list[str]) -> dict[str, bytes]:
        """Ids of words after ``mark``, many words in one string: a word begins where a token begins with the mark."""
        out: dict[str, bytes] = {}
        for i in range(0, len(new), AT_ONCE * AT_ONCE):
            groups = [new[j:j + AT_ONCE] for j in range(i, min(i + AT_ONCE * AT_ONCE, len(new)), AT_ONCE)]
            joined = [mark + mark.join(g) for g in groups]
            for words, text, raw in zip(groups, joined, self._raw(joined), strict=True):
                ids = np.frombuffer(raw, dtype=self.kind)
                at = (np.nonzero(self.opens[mark][ids])[0] * ids.itemsize).tolist()
                parts = [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)]
                if len(parts) != len(words) or at[0] or self.added.search(text):
                    parts = self._raw([mark + w for w in words])
                out.update(zip(words, parts, strict=True))
        return out

    def _ids(self, new: list[bytes]) -> list[list[int]]:
        """Ids of new words, given with the mark before them; those that end in one full stop or comma are made of the word without."""
        out: list[list[int] | None] = [None] * len(new)
        rest, ends, stems = [], self.stops, {}
        for i, raw in enumerate(new):
            stop = ends.get(raw[-1:])
            stem = raw if stop is None else raw[:-1]
            if raw[:1] in self.bare and stem[1:].isalpha():  # ASCII letters: one piece, whose ids the model alone says
                ids = stems.get(stem)
                if ids is None:
                    known = self.index.get(stem)
                    ids = stems[stem] = self.bare[raw[:1]](stem[1:].decode()) if known is None else \
                        self.pool[self.first[known]:self.first[known] + self.size[known]].tolist()
                out[i] = ids if stop is None else ids + stop
            else:
                rest.append(i)
        words = [new[i].decode("utf-8", "surrogatepass") for i in rest]
        got = {mark + w: x for mark in " \n" for w, x in self._ask(mark, [w[1:] for w in words if w[0] == mark and len(w) > 1]).items()}
        odd = [w for w in words if w not in got]
        got.update(zip(odd, self._raw(odd), strict=True))
        for i, w in zip(rest, words, strict=True):
            out[i] = np.frombuffer(got[w], dtype=self.kind).tolist()
        return out

    def _add(self, ids: list[list[int]], at: int) -> None:
        """Give words the places from ``at`` on, and put their ids behind those of the pool."""
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        end = np.cumsum(size) + self.used
        while at + len(ids) > len(self.first):
            self.first, self.size, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.met))
        while len(end) and end[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.first[at:at + len(ids)], self.size[at:at + len(ids)], self.met[at:at + len(ids)] = end - size, size, 0
        if len(end):
            self.pool[self.used:end[-1]] = np.fromiter(chain.from_iterable(ids), dtype=self.kind, count=int(size.sum()))

    def _forget(self) -> None:
        keep = np.zeros(len(self.index), dtype=bool)
        keep[np.argsort(-self.met[:len(keep)], kind="stable")[:MEMO // 2]] = True
        words = [w for w, i in self.index.items() if keep[i]]
        ids = [self.pool[self.first[i]:self.first[i] + self.size[i]].tolist() for i in (self.index[w] for w in words)]
        self.index, self.used = {w: i for i, w in enumerate(words)}, 0
        self._add(ids, 0)
        self.used = int(self.size[:len(words)].sum())

    def _plain(self, t: str) -> bool:
        return self.added.search(t) is None and not ("  " in t or " \n" in t or "\n " in t or "\n\n" in t or t[:1] == " " or t[-1:] == " ") and t.replace("\n", "").isprintable()

    def _places(self, words: list[bytes]) -> np.ndarray:
        """Where the ids of each word stand; long ones (texts encoded as a whole among them) are kept for this batch only."""
        if len(self.index) > MEMO:
            self._forget()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(at < 0).tolist()
        ids = dict(zip(new, self._ids([words[i] for i in new]), strict=True))
        stay = [i for i in new if len(words[i]) <= LONGEST]
        once = [i for i in new if len(words[i]) > LONGEST]
        n = len(self.index)
        self._add([ids[i] for i in stay], n)
        self.index.update(zip((words[i] for i in stay), range(n, n + len(stay)), strict=True))
        self.used += sum(len(ids[i]) for i in stay)
        self._add([ids[i] for i in once], n + len(stay))
        at[stay + once] = np.arange(n, n + len(new))
        return at

    def encode_array(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each ends), with the id ``end`` after each text."""
        texts = texts.cast(pa.large_string())
        to = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[to[0]:to[-1]]
        to = to - to[0]
        plain = np.fromiter((self._plain(t) for t in texts.to_pylist()), dtype=bool, count=len(texts))
        marks = np.flatnonzero((data == 0x20) | (data == 0x0A))
        of = np.searchsorted(to, marks, side="right") - 1
        marks = marks[plain[of] & (marks > to[of])]
        begin = np.sort(np.concatenate([to[:-1][np.diff(to) > 0], marks]))
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(np.ascontiguousarray(data))])
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy()
        place = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        met = np.bincount(code, minlength=len(place))
        np.add.at(self.met, place, met)
        size, first = self.size[place][code], self.first[place][code]
        left = np.append(0, np.cumsum(size))
        ids = self.pool[np.repeat(first - left[:-1], size) + np.arange(left[-1])]
        ends = left[np.searchsorted(begin, to[1:])]
        if end is None:
            return ids, ends
        return np.insert(ids, ends, end), ends + np.arange(1, len(ends) + 1)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        ids, ends = self.encode_array(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


_ENCODERS: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def _width(path: str) -> str:
    return encoder(path).kind


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all texts and ``end_id`` after each, ascending by key, to a new ``folder`` that all executors reach.

    Texts are tokenised once, into a table beside the two; ids are counted over the whole table (at most a vocabulary of
    numbers leaves a task or reaches the driver).  Sampled splitters on the key deal the documents to shards; Spark's
    writer commits the files, so a lost executor leaves no half file behind.  Null texts are empty: their end id alone.
    Repeated rows are written each; rows with a null key come first; an empty table gives empty files."""
    spark = docs.sparkSession
    small_batches(spark)

    @F.arrow_udf("binary")
    def tokens(texts: pa.Array) -> pa.Array:
        e = encoder(tokenizer)
        parts = []
        for some in slices(texts):
            ids, ends = e.encode_array(some, end_id)
            at = (np.append(0, ends) * ids.itemsize).astype(np.int64)
            parts.append(pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(at), pa.py_buffer(ids)]).cast(pa.binary()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    docs.select(docs[key].alias("key"), tokens(text_of(docs, text)).alias("ids")).write.option("compression", "zstd").parquet(f"{folder}/raw")
    raw = spark.read.parquet(f"{folder}/raw")
    kind = _width(tokenizer)

    def count(batches):
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            seen = np.bincount(np.frombuffer(b"".join(b["ids"]), dtype=kind))
            total = np.pad(total, (0, max(len(seen) - len(total), 0)))
            total[:len(seen)] += seen
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"token": at, "n": total[at]})

    counts = raw.select("ids").mapInPandas(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    seen = counts.collect()  # at most the vocabulary
    ranked = np.array([r["token"] for r in sorted(seen, key=lambda r: (-r["n"], r["token"]))], dtype="<u4")
    spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(ranked)), "token": ranked.astype(np.int64)}), "rank bigint, token bigint") \
        .coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, dtype="<u4")
    rank[ranked] = np.arange(len(ranked))

    def pack(ids: pd.Series) -> pd.DataFrame:
        got = [(len(v), *encode_ranks(rank[v])) for v in (np.frombuffer(x, dtype=kind) for x in ids)]
        return pd.DataFrame(got, columns=["n", "control", "data"])

    place = F.coalesce(hex_long(raw["key"].cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), F.lit(""))
    n = max(partitions(spark), -(-sum(r["n"] for r in seen) // SHARD_IDS))
    cuts = sampled_cuts(raw, place, raw["key"], SHARDS_PER_PARTITION * n)
    packed = raw.withColumn("p", F.pandas_udf(pack, "n int, control binary, data binary")("ids"))  # coded bytes go through the shuffle
    packed.select(range_of(place, cuts).alias("shard"), "key", "p.n", "p.control", "p.data").repartition(n, "shard") \
        .sortWithinPartitions("shard", "key").write.option("compression", "zstd").parquet(f"{folder}/ids")


def slices(texts: pa.Array) -> list[pa.Array]:
    """Parts of an array with about ``SLICE`` bytes of text each."""
    if not len(texts):
        return []
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _token_of(spark: SparkSession, folder: str) -> np.ndarray:
    got = spark.read.parquet(f"{folder}/ranks").toPandas().sort_values("rank")  # at most the vocabulary
    return got["token"].to_numpy(dtype="<u4")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """key and ids (array) of every document in the files."""
    token = _token_of(spark, folder)

    def run(control: pd.Series, data: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([token[decode_ranks(c, d, k)].astype(np.int64) for c, d, k in zip(control, data, n, strict=True)])

    small_batches(spark)
    files = spark.read.parquet(f"{folder}/ids")
    return files.select("key", F.pandas_udf(run, T.ArrayType(T.LongType()))("control", "data", "n").alias("ids"))


def digest_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every document, from the files alone.

    ``start`` is the sum of the shards before (one number a shard reaches the driver) plus a window inside the shard."""
    token = _token_of(spark, folder)

    def run(control: pd.Series, data: pd.Series, n: pd.Series) -> pd.DataFrame:
        got = [token[decode_ranks(c, d, k)] for c, d, k in zip(control, data, n, strict=True)]
        return pd.DataFrame({"n": [len(v) for v in got], "crc": [zlib.crc32(v.astype("<u4").tobytes()) for v in got]})

    small_batches(spark)
    files = spark.read.parquet(f"{folder}/ids")
    sizes = sorted(files.groupBy("shard").agg(F.sum("n")).collect())  # one row a shard
    starts, total = [], 0
    for shard, n in sizes:
        starts.append((shard, total))
        total += n
    starts = spark.createDataFrame(starts, "shard int, first bigint")
    out = files.select("shard", "key", F.pandas_udf(run, "n bigint, crc bigint")("control", "data", "n").alias("d")).select("shard", "key", "d.*")
    before = Window.partitionBy("shard").orderBy("key", "crc").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("in", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(starts), "shard") \
        .select("key", (F.col("first") + F.col("in")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def fresh_folder(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/winnow-tokens-{uuid.uuid4().hex[:8]}"
