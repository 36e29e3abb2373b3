"""Token counts by a tokenizer compiled to a deterministic transducer.

For each prefix of a text the pair-merging tokenizer has one last token, and a sequence of tokens is the tokenizer's own
exactly if each token and each two neighbours tokenise to themselves.  What the future can still change is therefore a finite
state: the places from where the text so far begins some token, each with the last token before it and the number of tokens
up to it.  Reading one more byte leads to the next state and adds a fixed number (which may be negative) to the count.
States are compiled when a text first reaches them, as text search engines do, and forgotten beyond ``MAX_STATES``.

A text is read in chunks, many at a time.  The map of a chunk, from the state before it to the state and the count after it,
is known for the states it has been run from; it is the same for all where a word begins at the chunk.  The maps
along each text are composed by a parallel prefix scan (pointer doubling); states that no run started from are run then."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

SPACE = "▁"     # how the model writes a space
CHUNK, SLACK = 192, 64
LANES = 1 << 14      # chunks read side by side
MAX_STATES = 250_000  # a state is a row of 1 KB
FREE = -1            # no token before, or none that could merge with what follows
PAD = 0xFF           # no byte of UTF-8


class _Vocabulary:
    """Pieces, their merge scores and their trie, from a sentencepiece model of the pair-merging kind."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(" é ﬁ  ") != f"{SPACE}{SPACE}é{SPACE}ﬁ{SPACE}{SPACE}" or sp.encode("\U000f0000", out_type=str)[-1:] != ["<0x80>"]:
            raise ValueError("the model must keep texts as they are, put a space before them and fall back to bytes")
        ids = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
        self.tokens = sorted(set(self.score) | {ch for p in self.score for ch in p})
        self.token_id = {t: i for i, t in enumerate(self.tokens)}
        self.weight = [1 if t in self.score else len(t.encode()) for t in self.tokens]  # a lone character that is no piece falls to bytes
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [FREE]
        self.node: list[int] = []
        for t in self.tokens:
            node = 0
            for ch in t:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append(FREE)
                node = self.children[node][ch]
            self.node.append(node)
            if self.merged(t) == [t]:
                self.ends[node] = self.token_id[t]
        self.resets = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        self._fits: dict[tuple[int, int], bool] = {}
        self._spine: dict[int, list[int]] = {}
        self._short: dict[tuple[int, str], int] = {}

    def merged(self, text: str) -> list[str]:
        """Merge the neighbours with the best score, leftmost first, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: int) -> list[int]:
        """The last part of a token, character first, as its merges make it grow."""
        if token not in self._spine:
            text = self.tokens[token]
            grown, parts = [text[-1]], list(text)
            while len(parts) > 1:
                at = max((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.score),
                         key=lambda i: (self.score[parts[i] + parts[i + 1]], -i))
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
                grown += [parts[-1]] if parts[-1] != grown[-1] else []
            self._spine[token] = [self.token_id[p] for p in grown]
        return self._spine[token]

    def short(self, before: int, ch: str = "") -> int:
        """The part of the token before that decides about merges across its end, where ``ch`` (or anything) follows."""
        if before == FREE:
            return FREE
        if (before, ch) not in self._short:
            grown = self.spine(before)
            open_to = [i for i, t in enumerate(grown) if (ch in self.children[self.node[t]] if ch else self.children[self.node[t]])]
            self._short[before, ch] = grown[min(open_to[-1] + 1, len(grown) - 1)] if open_to else FREE
        return self._short[before, ch]

    def fits(self, before: int, token: int) -> bool:
        """Whether the two tokens, side by side, tokenise to themselves."""
        if before == FREE:
            return True
        if (before, token) not in self._fits:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            u, t = self.tokens[before], self.tokens[token]
            self._fits[before, token] = self.merged(u + t) == [u, t]
        return self._fits[before, token]


class Transducer:
    """States and byte transitions, compiled on demand.  An entry of ``table`` holds next state * 256 + tokens + 128."""

    def __init__(self, path: str) -> None:
        self.vocabulary = _Vocabulary(path)
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.table = np.full((1024, 256), -1, dtype=np.int32)
        self.any = self._state((((0, FREE, 0),), b""))
        step = self.move(self.any, 0x20)  # every text begins with a space
        self.start, self.first = step >> 8, (step & 255) - 128

    def _state(self, key: tuple) -> int:
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append(key)
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.table[self.index[key], PAD] = self.index[key] * 256 + 128
        return self.index[key]

    def move(self, state: int, byte: int) -> int:
        places, part = self.states[state]
        raw = part + bytes([byte])
        lead = raw[0]
        need = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        if len(raw) < need:
            out, more = self._state((places, raw)), 0
        else:
            places, more = self._read(places, SPACE if raw == b" " else raw.decode("utf-8", "replace"), need)
            out = self._state((places, b""))
        self.table[state, byte] = out * 256 + more + 128
        return int(self.table[state, byte])

    def _read(self, places: tuple, ch: str, size: int) -> tuple[tuple, int]:
        """The places after one more character, and the tokens that it adds."""
        v, alive, last, more = self.vocabulary, [], None, 0
        for node, before, count in places:
            child = v.children[node].get(ch)
            if child is None:
                continue
            if node == 0:
                before = v.short(before, ch)
            if last is None and v.ends[child] != FREE and v.fits(before, v.ends[child]):
                last, more = v.ends[child], count + v.weight[v.ends[child]]
            if v.children[child]:
                alive.append((child, before, count))
        if last is None:  # a character outside the vocabulary: its bytes
            return ((0, FREE, 0),), size
        return (*((n, b, c - more) for n, b, c in alive), (0, v.short(last), 0)), more

    def run(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, tokens) after each chunk ``data[at:at + size]`` read from ``state``."""
        width = int(size.max(initial=0))
        place = np.arange(width)
        lanes = np.where(place < size[:, None], data[np.minimum(at[:, None] + place, len(data) - 1)], PAD).T
        lanes, total, state = np.ascontiguousarray(lanes), np.zeros(len(at), dtype=np.int64), state.astype(np.int64)
        for column in lanes:
            where = state * 256 + column
            step = self.table.ravel().take(where)
            while (lost := step < 0).any():
                for s in np.unique(where[lost]).tolist():
                    self.move(s >> 8, s & 255)
                step = self.table.ravel().take(where)
            total += step & 255
            state = (step >> 8).astype(np.int64)
        return state, total - 128 * width

    def count(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of the texts that lie one after the other in ``data``; ``ends`` has one place more than there are texts."""
        if len(self.states) > MAX_STATES:
            self._clear()
        text, at, clean = chunks(data, ends, self.vocabulary.resets)
        if not len(at):
            return np.zeros(len(ends) - 1, dtype=np.int64)
        size = np.append(at[1:], ends[-1]) - at
        first = np.append(True, text[1:] != text[:-1])
        follows = np.append(text[1:] == text[:-1], False)  # chunks that another one of the same text follows
        runs = {"chunk": np.arange(len(at)), "entry": np.where(first, self.start, self.any)}
        out = [np.zeros(0, dtype=np.int64)] * 4  # chunk, entry, exit, tokens
        while len(runs["chunk"]):
            got = [self.run(data, at[c], size[c], e) for c, e in (
                (runs["chunk"][i:i + LANES], runs["entry"][i:i + LANES]) for i in range(0, len(runs["chunk"]), LANES))]
            left, tokens = (np.concatenate(x) for x in zip(*got, strict=True))
            on = follows[runs["chunk"]]
            after = np.where(np.append(clean[1:], False)[runs["chunk"]], self.any, left)
            out = [np.concatenate(x) for x in zip(out, (runs["chunk"], runs["entry"], after, tokens), strict=True)]
            known = out[0] * (1 << 32) + out[1]
            new = np.unique(((runs["chunk"] + 1) * (1 << 32) + after)[on])
            new = new[~np.isin(new, known)]
            runs = {"chunk": new >> 32, "entry": new & ((1 << 32) - 1)}
        total = compose(*out, follows)
        counted = np.zeros(len(ends) - 1, dtype=np.int64)
        head = np.nonzero(first)[0]
        counted[text[head]] = total[head] + self.first  # the first runs are those of all chunks, in order
        return counted


def chunks(data: np.ndarray, ends: np.ndarray, resets: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, whether a word begins there) of chunks that cut the texts at about every 192 bytes: at the next space
    that follows a word, or after 64 bytes more where there is none."""
    size = np.diff(ends)
    n = np.maximum(-(-(size - SLACK) // CHUNK), size > 0)
    text = np.repeat(np.arange(len(size)), n)
    order = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    at = ends[text] + order * CHUNK
    clean = np.zeros(len(at), dtype=bool)
    if resets and len(at):
        words = np.nonzero((data[1:] == 0x20) & (data[:-1] != 0x20) & (data[:-1] != 0x81))[0] + 1
        near = np.append(words, np.iinfo(np.int64).max)[np.searchsorted(words, at)]
        clean = (order > 0) & (near < np.minimum(at + SLACK, ends[text + 1]))
        at = np.where(order == 0, at, np.where(clean, near, np.minimum(at + SLACK, ends[text + 1] - 1)))
    return text, at, clean


def compose(chunk: np.ndarray, entry: np.ndarray, after: np.ndarray, tokens: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Tokens from each run to the end of its text: the maps of the chunks behind it, composed by pointer doubling."""
    known = chunk * (1 << 32) + entry
    order = np.argsort(known)
    want = (chunk + 1) * (1 << 32) + after
    n = len(known)
    link = np.append(np.where(follows[chunk], order[np.minimum(np.searchsorted(known, want, sorter=order), n - 1)], n), n)
    total = np.append(tokens, 0)
    while (link < n).any():
        total = total + total[link]
        link = link[link]
    return total[:n]


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def count_batch(texts: pa.Array, model: str) -> np.ndarray:
    """Tokens of an Arrow array of texts."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]]
    return transducer(model).count(data, ends - ends[0])


def token_counts(docs: DataFrame, model: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for every row: the tokens that the sentencepiece model at ``model`` gives the whole text,
    without begin and end tokens.

    The model must merge pairs, keep texts as they are, put a space before them and fall back to bytes; others raise
    ValueError.  Null texts count as empty and have no token; repeated rows give equal results and null keys stay; an empty
    table gives an empty result; other columns are not read."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(count_batch(texts, model), pa.int64())

    whole = text_of(docs, text)
    out = docs.select(docs[key].alias("id"), F.octet_length(whole).cast("bigint").alias("n_bytes"), counted(whole).alias("n_tokens"))
    return out.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
