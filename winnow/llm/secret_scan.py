"""Secret scans: rules, and a character convolutional network over candidates."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_of

# The base patterns.  They run on A-Z lower-cased bytes (assign) or the bytes themselves.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")

CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
PART = re.compile(rb"[A-Za-z0-9+_=-]{16,}")
BEFORE, INSIDE, AFTER = 24, 40, 16
SIDE = BEFORE + INSIDE + AFTER
FIT_DOCS = 40_000      # most documents whose findings the network learns from
FIT_FINDINGS = 3000    # most findings of either label
RECALL = 0.98
DIM, FILTERS, WIDTH, EPOCHS = 8, 24, 5, 12


def base_findings(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the base rules' matches."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw.lower()) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw)] if b"AKIA" in raw else []
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(raw)]
    return out


def _window(raw: bytes, start: int, end: int) -> bytes:
    """At most 40 bytes of a candidate between their contexts."""
    return raw[max(start - BEFORE, 0):start].rjust(BEFORE, b"\0") + raw[start:end].ljust(INSIDE, b"\0") + raw[end:end + AFTER].ljust(AFTER, b"\0")


def _places(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping windows of at most 40 bytes that cover a whole candidate."""
    last = max(end - INSIDE, start)
    return [(a, min(a + INSIDE, end)) for a in (*range(start, last, INSIDE // 2), last)]


def candidates_of(raw: bytes) -> list[tuple[int, int]]:
    """Runs of token characters, and the long enough parts between the path separators of a run."""
    out = []
    for m in CANDIDATE.finditer(raw):
        out.append(m.span())
        if b"/" in m[0]:
            out += [(m.start() + p.start(), m.start() + p.end()) for p in PART.finditer(m[0])]
    return sorted(set(out))


def labelled_findings(text: str) -> list[tuple[int, bytes]]:
    """(label, window): 1 for windows of what the base rules find, 0 for those of other candidates of the text."""
    raw = text.encode("utf-8", "surrogatepass")
    found = base_findings(raw)
    out = []
    for s, k, e in found:
        if k == 0:
            s = max(raw.rfind(b"=", s, e), raw.rfind(b":", s, e)) + 1 if not CANDIDATE.search(raw, s, e) else CANDIDATE.search(raw, s, e).start()
        out += [(1, _window(raw, a, b)) for a, b in _places(s, e)]
    spans = [(s, e) for s, _, e in found]
    for a, b in candidates_of(raw):
        if not any(s < b and a < e for s, e in spans):
            out += [(0, _window(raw, *w)) for w in _places(a, b)]
    return out


def _codes(windows: list[bytes]) -> np.ndarray:
    return np.minimum(np.frombuffer(b"".join(windows), dtype=np.uint8).reshape(-1, SIDE), 127).astype(np.int64)


class Network:
    """Embedding, one convolution, maximum and mean over positions, a linear output; plain numpy, trained with Adam."""

    def __init__(self, windows: list[bytes], y: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.3, (128, DIM)), "w": rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)), "b": np.zeros(FILTERS),
                  "o": rng.normal(0, 0.2, 2 * FILTERS), "c": np.zeros(1)}
        codes = _codes(windows)
        held = np.arange(len(y)) % 5 == 0
        share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * len(y)
        moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        train, step = np.nonzero(~held)[0], 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(train), max(len(train) // 64, 1)):
                x = codes[part].copy()
                x[rng.random(len(part)) < 0.5, :BEFORE] = 0  # half the time without what stands before: names are no proof
                step += 1
                for k, g in self._gradient(x, y[part], share[part]).items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= 0.004 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.slope, self.shift, self.cut = 1.0, 0.0, 0.5
        if held.sum() and (y[held] == 1).any():
            self._calibrate(self._raw(codes[held]), y[held])

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = self.p["e"][x]
        n = SIDE - WIDTH + 1
        patches = np.concatenate([e[:, i:i + n] for i in range(WIDTH)], axis=2)
        z = np.maximum(patches.reshape(-1, WIDTH * DIM) @ self.p["w"] + self.p["b"], 0).reshape(len(x), n, FILTERS)
        return patches, z, np.concatenate([z.max(axis=1), z.mean(axis=1)], axis=1)

    def _raw(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[i:i + 512])[2] @ self.p["o"] + self.p["c"][0] for i in range(0, len(x), 512)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _gradient(self, x: np.ndarray, y: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
        patches, z, pooled = self._forward(x)
        d = share * (1 / (1 + np.exp(-(pooled @ self.p["o"] + self.p["c"][0]))) - y) / len(x)
        back = d[:, None] * self.p["o"][None, :]
        dz = np.repeat(back[:, None, FILTERS:] / z.shape[1], z.shape[1], axis=1)
        rows, filters = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        dz[rows, z.argmax(axis=1), filters] += back[:, :FILTERS]
        dz = (dz * (z > 0)).reshape(-1, FILTERS)
        dp = (dz @ self.p["w"].T).reshape(len(x), z.shape[1], WIDTH, DIM)
        de = np.zeros((len(x), SIDE, DIM))
        for i in range(WIDTH):
            de[:, i:i + z.shape[1]] += dp[:, :, i]
        e = np.zeros_like(self.p["e"])
        np.add.at(e, x.ravel(), de.reshape(-1, DIM))
        return {"e": e, "w": patches.reshape(-1, WIDTH * DIM).T @ dz, "b": dz.sum(axis=0), "o": pooled.T @ d, "c": np.array([d.sum()])}

    def _calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on held-out findings; then the highest threshold that keeps the recall."""
        a = np.column_stack([raw, np.ones(len(raw))])
        b = np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            v = p * (1 - p) + 1e-6
            b -= np.linalg.solve((a * v[:, None]).T @ a + 0.01 * np.eye(2), a.T @ (p - y) + 0.01 * (b - [1.0, 0.0]))
        self.slope, self.shift = float(b[0]), float(b[1])
        sure = np.sort(self._scaled(raw[y == 1]))
        self.cut = float(sure[int((1 - RECALL) * len(sure))])

    def _scaled(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))

    def score(self, windows: list[bytes]) -> np.ndarray:
        return self._scaled(self._raw(_codes(windows))) if windows else np.zeros(0)


_FINDING = T.ArrayType(T.StructType([T.StructField("y", T.IntegerType()), T.StructField("w", T.BinaryType())]))


@F.pandas_udf(_FINDING)
def findings_of(text: pd.Series) -> pd.Series:
    return pd.Series([[{"y": y, "w": w} for y, w in labelled_findings(t)] for t in text])


def fit_secrets(docs: DataFrame, fit_docs: int = FIT_DOCS, key: str = "doc_id", text: str = "text") -> Network | None:
    """A network learnt from findings in at most about ``fit_docs`` documents, at most 3000 of either label; None without
    findings of both."""
    small_batches(docs.sparkSession)
    share = int(min(1.0, fit_docs / max(docs.count(), 1)) * (1 << 30)) + 1
    some = docs.where(F.pmod(F.xxhash64(docs[key], F.lit(23)), F.lit(1 << 30)) < share)
    found = some.select(F.explode(findings_of(text_of(some, text))).alias("f")).select("f.y", "f.w").distinct()
    got = []
    for label in (1, 0):
        got += [(label, bytes(r[0])) for r in found.where(F.col("y") == label).orderBy(F.xxhash64("w"), "w").limit(FIT_FINDINGS).select("w").collect()]
    y = np.array([g[0] for g in got], dtype=np.int64)
    order = np.random.default_rng(5).permutation(len(y))
    return Network([got[i][1] for i in order], y[order]) if len(set(y.tolist())) == 2 else None


def scan_batch(texts: pd.Series, network: Network | None) -> pd.DataFrame:
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    base = [base_findings(r) for r in raws]
    more: list[tuple[int, int, int, int, int]] = []
    for i, (r, b) in enumerate(zip(raws, base, strict=True)):
        if network is not None:
            for at, to in candidates_of(r):
                if not any(s <= at and to <= e for s, _, e in b):
                    more += [(i, at, to, *w) for w in _places(at, to)]
    score = network.score([_window(raws[i], s, e) for i, _, _, s, e in more]) if network is not None else []
    hits: dict[int, dict[tuple[int, int], list[tuple[int, int]]]] = {}
    for (i, at, to, s, e), p in zip(more, score, strict=True):
        if p >= network.cut:
            hits.setdefault(i, {}).setdefault((at, to), []).append((s, e))
    added: dict[int, list[tuple[int, int, int]]] = {}
    for i, found in hits.items():
        for (at, to), windows in found.items():
            parts = [x for x in found if x != (at, to) and at <= x[0] and x[1] <= to]  # a run's own parts say where it is
            if any(not any(s < q and p < e for p, q in parts) for s, e in windows):
                added.setdefault(i, []).append((at, 3, to))
    rows = []
    for i, (r, b) in enumerate(zip(raws, base, strict=True)):
        place = (lambda p: p) if r.isascii() else (lambda p, r=r: len(r[:p].decode("utf-8", "surrogatepass")))
        line = lambda found: ",".join(f"{KINDS[k]}:{place(s)}:{place(e)}" for s, k, e in sorted(found))
        n = [sum(k == x for _, k, _ in b) for x in range(3)]
        rows.append((*n, hashlib.sha256(line(b).encode()).hexdigest(), line(b + added.get(i, []))))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans for every row, positions in code points.

    The base rules' findings always stay.  Every run of 16 or more token characters that is not wholly inside one is a candidate, and every
    such part between the separators of a path; the network reads all of it in overlapping windows with their contexts, and
    those with a window above the threshold become spans of kind "model", a run only for windows apart from such parts.  The threshold keeps 98 % of
    held-out labelled findings; it is 0.5 if none is held out.  Null texts count as empty; repeated rows give equal results; an empty table gives an
    empty result; other columns are not read."""
    network = fit_secrets(docs, key=key, text=text)
    schema = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

    def run(text: pd.Series) -> pd.DataFrame:
        return scan_batch(text, network)

    out = docs.select(docs[key].alias("id"), F.pandas_udf(run, schema)(text_of(docs, text)).alias("f"))
    return out.select(F.col("id").alias(key), "f.*")
