"""Statistics of one whole text."""

from __future__ import annotations

from collections import Counter

import numpy as np

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_same_next", "n_upper",
         "n_digits", "n_points", "n_wide", "longest_word", "n_chars", "n_control")
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_POINTS = list(b".,;:!?")
_SYMBOLS = list(SYMBOLS)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that occur twice or more, the first occurrence included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * _MIX[0]
        x ^= x >> np.uint64(29)
        h = sum(((x[i:i + n] * _MIX[1 + i % 4]) >> np.uint64(3)) * _MIX[i % 5] for i in range(window))
    order = np.sort(h)
    if not (order[1:] == order[:-1]).any():
        return 0
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    places = np.nonzero(np.isin(h, twice))[0].tolist()
    windows = [tuple(ids[p:p + window].tolist()) for p in places]  # the hash only finds candidates
    seen = Counter(windows)
    mark = np.zeros(len(ids) + 1, dtype=np.int64)
    for p, w in zip(places, windows, strict=True):
        if seen[w] > 1:
            mark[p] += 1
            mark[p + window] -= 1
    return int((np.cumsum(mark) > 0).sum())


def text_stats(text: str | None) -> list[int]:
    """The numbers named in ``STATS``.  Words are runs of anything but space and control spaces; a null text has none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(raw) - int(hist[0x80:0xC0].sum())
    return [len(words), chars - int(hist[32] + hist[9:14].sum()), int(hist[_SYMBOLS].sum()), len(lines) - len(set(lines)),
            repeated_words(ids) if len(index) < len(words) else 0, len(lines), len(index), int((ids[1:] == ids[:-1]).sum()),
            int(hist[65:91].sum()), int(hist[48:58].sum()), int(hist[_POINTS].sum()), int(hist[0xC0:].sum()),
            max(map(len, words), default=0), chars, int(hist[:9].sum() + hist[14:32].sum() + hist[127])]
