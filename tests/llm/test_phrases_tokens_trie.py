"""Collocations, token counts and the conversation trie against brute force, on rows with all the awkward cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from winnow.llm import conversation_trie, phrases, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, n_tokens int, phrase string, rank int, id string"


def make(spark, rows):
    return spark.createDataFrame([(k, t, g, 1, "x", 2, "y") for k, t, g in rows], SCHEMA).repartition(5)


# Collocations

def plain_collocations(rows, least, top, words):
    by = {}
    for t, g in rows:
        f = by.setdefault("und" if g is None else g, Counter())
        low = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in t or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            f.update(tuple(w[i:i + k]) for k in range(1, words + 1) for i in range(len(w) - k + 1))
    out = []
    for g, f in by.items():
        n = sum(a for p, a in f.items() if len(p) == 1)
        many = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:i + k] for p, a in many.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * f[p[i:i + k]]}
        best = []
        for p, a in many.items():
            if p not in gone:
                score, cut = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(g, r, p.decode(), -a, x, y, n, -s) for r, (s, a, p, x, y) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(4)
    vocabulary = ["a", "B", "é", "the", "The", "x\x1fy", "日本", "\x00", "long" * 30, "q", "of", " "]
    rows = [(None, None, None), (1, "", "en"), (2, " \t\n.,;:!?\x0b\x0c\r", "en"), (3, "the of " * 3000, "en"), (3, "the of " * 3000, "en")]
    rows += [(10 + i, "A fixed passage of, eight words. In pieces", "und" if i % 2 else None) for i in range(60)]
    for i in range(150):
        some = [rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n", "\t", "\r"]) for _ in range(rng.randint(0, 60))]
        rows.append((100 + i, rng.choice([" ", "  ", "\t"]).join(some), rng.choice(["en", "de", "en", None])))
    return rows


@pytest.mark.parametrize(("shards", "cells", "block"), [(4, 1 << 23, 8 << 20), (2, 64, 100), (1, 1 << 12, 8 << 20)])
def test_collocations(spark, phrase_rows, shards, cells, block):
    """Cells that collide (64 of them) activate phrases early; counts and ranks stay exact."""
    got = phrases.collocations(make(spark, phrase_rows), least=7, top=40, shards=shards, cells=cells, block=block).collect()
    assert sorted(map(tuple, got)) == plain_collocations([r[1:] for r in phrase_rows], 7, 40, 4)


def test_active_from_both_parts(spark):
    """A longer phrase is counted from the scan after both its parts have reached the threshold, for one cycle."""
    reached = np.full(phrases.CELLS, phrases.NEVER, dtype=np.uint8)
    text = b"\n".join([b"a b c"] * 4 + [b"a d"] * 9)
    h = phrases.word_hash(pa.array(["a", "b", "c"], pa.large_string()), "en")
    for i, since in ((0, 1), (1, 2), (2, 1)):
        reached[phrases.cell_places(h[i:i + 1])] = since
    seen = {s: {p: (n, first) for b in phrases.count_block(text, "en", reached, s, 2, 3) for p, k, n, first in zip(
        *(b.column(c).to_pylist() for c in ("phrase", "k", "c", "start")), strict=True) if k > 1} for s in range(5)}
    assert seen == {0: {}, 1: {}, 2: {"a b": (4, 2), "b c": (4, 2)}, 3: {"a b": (4, 2), "b c": (4, 2)}, 4: {}}
    pair = phrases.grow_hash(h[:2], h[1:])
    reached[phrases.cell_places(pair[:1])] = 3
    assert not any("a b c" in b.column("phrase").to_pylist() for b in phrases.count_block(text, "en", reached, 4, 2, 3))
    reached[phrases.cell_places(pair[1:])] = 4
    (last,) = [b for b in phrases.count_block(text, "en", reached, 4, 2, 3)]
    assert last.column("phrase").to_pylist() == ["a b c"] and last.column("start").to_pylist() == [4]


def test_collocations_of_nothing(spark, phrase_rows):
    got = phrases.collocations(make(spark, phrase_rows).limit(0))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0


def test_score_beyond_64_bits(spark):
    big = 9 * 10 ** 18
    got = spark.range(1).select(F.expr(f"2000000 * {phrases._whole(f'{big}L')} div ({phrases._whole(f'{big}L')} + {phrases._whole(f'{big}L')})").alias("s"))
    assert got.first()["s"] == 1000000


# Token counts

def awkward_texts():
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "▁", "\t", "\n", "é", "日", "𝔘", "the", "ing", "=", "/", "0", "19", "\0", "<s>", "<0x41>", "ﬁ", " the",
             " " * 17, "#" * 20, "'", "aaaa", "​", "er", "ction", "€", "́", "\U0010ffff"]
    out = ["", " ", "▁", "\x7f", "word " * 30_000]
    out += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12) if i % 3 else rng.randint(100, 900))) for i in range(600)]
    out += [x * n for x in ("a", " ", "=", "日", "ab", "▁", "é") for n in (1, 2, 15, 16, 17, 63, 64, 191, 192, 193, 255, 256, 257, 700)]
    return out + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)) for _ in range(10)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_transducer(library, monkeypatch):
    texts = awkward_texts()
    want = [len(x) for x in library.encode(texts)]
    assert token_counts.count_batch(pa.array(texts), MODEL).tolist() == want
    assert token_counts.count_batch(pa.array(["skipped", *texts]).slice(1), MODEL).tolist() == want
    monkeypatch.setattr(token_counts, "MAX_STATES", 1000)  # states are forgotten between batches
    for i in range(0, len(texts), 200):
        assert token_counts.count_batch(pa.array(texts[i:i + 200]), MODEL).tolist() == want[i:i + 200]


@pytest.mark.parametrize(("chunk", "slack"), [(1, 0), (5, 3), (64, 64)])
def test_chunks_compose(library, monkeypatch, chunk, slack):
    """Cuts inside words and characters: maps from several states, composed along the text."""
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    monkeypatch.setattr(token_counts, "SLACK", slack)
    texts = awkward_texts()[5:200]
    for resets in (True, False):
        monkeypatch.setattr(token_counts.transducer(MODEL).vocabulary, "resets", resets)
        assert token_counts.count_batch(pa.array(texts), MODEL).tolist() == [len(x) for x in library.encode(texts)]


def test_token_counts(spark, library):
    rows = [(None, "null key", "en"), (1, None, None), (2, "", "en"), (3, "word " * 6000, "en"), (3, "word " * 6000, "en"), (4, "é 日", "fr")]
    docs = make(spark, rows)
    got = token_counts.token_counts(docs, MODEL)
    want = [(k, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for k, t, _ in rows]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert token_counts.token_counts(docs.limit(0), MODEL).count() == 0


# Conversation trie

def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(
                f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    members, ends = {}, {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + t[h:])
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(not children[q] for q in below),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q),
                    hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(8)
    rows = [(None, 0, "user", "no conversation"), (7, None, None, None), (7, 2, "user", None), (7, 2, "user", None), (7, 2, "user", "tie"),
            (7, 2, "a", "tie"), (7, -1, "", "é"), (300, 0, "user", "x"), (9_007_199_254_740_993, 0, "user", "far")]
    for c in range(100, 240):  # 100 and 200 lend their turns; 201..239 share first turns
        rows += [(c, i, rng.choice(["user", "bot"]), rng.choice(["same", "other", "é" * 5])) for i in range(rng.choice([1, 1, 2, 5, 8]))]
    rows += [(c, i, "user", f"t{i}") for c in range(1000, 1040) for i in range(7)]
    rows += [(2000, i, "user", "long") for i in range(40)]
    return [r for r in rows if r[0] != 200]


@pytest.fixture(scope="module")
def turns(spark, talk):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in talk], "conv_id bigint, turn bigint, role string, text string, depth int, key string, d string").repartition(4)


@pytest.mark.parametrize(("last", "run"), [(conversation_trie.LAST, 1024), (10, 3)])
def test_trie(turns, talk, monkeypatch, last, run):
    """With ten arcs for the last task the tour is contracted in many rounds; runs of three turns split conversations."""
    monkeypatch.setattr(conversation_trie, "RUN", run)
    got = conversation_trie.conversation_trie(turns, last=last).collect()
    assert Counter(map(tuple, got)) == plain_trie(talk)


def test_trie_of_nothing_and_of_no_turns(spark, turns):
    assert conversation_trie.conversation_trie(turns.limit(0)).count() == 0
    ids = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 6][:9]
    short = spark.createDataFrame([(c, 0, "user", "own turn that is replaced") for c in ids], "conv_id bigint, turn bigint, role string, text string")
    (root,) = conversation_trie.conversation_trie(short).collect()
    assert tuple(root) == (min(ids), 0, None, len(ids), 0, 1, 0, hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest())


def test_list_sums(spark):
    n = 300
    order = np.random.default_rng(2).permutation(n)
    name = [f"n{i}" for i in order]
    frame = pd.DataFrame({"arc": name, "pred": [None, *name[:-1]], "succ": [*name[1:], None], "leaves": 1, "saved": np.arange(n)})
    got = conversation_trie.list_sums(spark.createDataFrame(frame, "arc string, pred string, succ string, leaves bigint, saved bigint"), last=5).collect()
    assert {r["arc"]: (r["leaves"], r["saved"]) for r in got} == {a: (n - i, sum(range(i, n))) for i, a in enumerate(name)}
