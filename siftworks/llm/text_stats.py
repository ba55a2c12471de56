"""Dense statistics of whole texts, shared by the learned and the rule-based operators."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"

#: Characters by class. Everything beyond Latin-1 is told by Python's own tests.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other_punct", "other")
_CLASS_OF = np.full(0x110000, 255, np.uint8)
for _c in range(0x250):
    _ch = chr(_c)
    _CLASS_OF[_c] = (
        3 if _ch.isspace() else 2 if _ch.isdigit() else 1 if _ch.isupper() else 0 if _ch.isalpha() else 4 if _ch in ".,;:'\"-()" else 5 if _ch in SYMBOLS else 6 if _ch.isprintable() else 7
    )


def class_counts(text: str) -> np.ndarray:
    """Code points of the text in each class."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _CLASS_OF[codes]
    if (kinds == 255).any():
        for c in np.unique(codes[kinds == 255]):
            ch = chr(c)
            _CLASS_OF[c] = 3 if ch.isspace() else 2 if ch.isdigit() else 1 if ch.isupper() else 0 if ch.isalpha() else 6 if ch.isprintable() else 7
        kinds = _CLASS_OF[codes]
    return np.bincount(kinds, minlength=len(CLASSES))[: len(CLASSES)]


def split_words(text: str) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return _SPACE.findall(text)


def repeated_words(words: list[str], window: int = 8) -> int:
    """Words that stand in a window found twice or more in the text, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    # Unequal hashes rule repetition out, which is the usual case; equal ones are looked at exactly.
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = h[:n]
    for j in range(1, window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[j : n + j]
    key = np.sort(key)
    if not (key[1:] == key[:-1]).any():
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # Exact window numbers by doubling: 1, 2, 4 ... words.
    keys, size = ids, 1
    while size < window:
        step = min(size, window - size)
        keys = keys[: len(keys) - step] * np.int64(len(words) + 1) + keys[step:]
        keys = np.unique(keys, return_inverse=True)[1].astype(np.int64)
        size += step
    twice = np.bincount(keys)[keys] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((edge.cumsum()[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif _SPACE.search(line):
            seen.add(line)
    return n


STATISTICS = (
    "log_words", "log_chars", "lower", "upper", "digit", "space", "stop", "symbol", "other_punct", "other", "word_length", "word_spread",
    "distinct", "top_word", "repeat", "dup_lines", "short_words", "caps_words", "symbol_ends", "line_words",
)


def statistics(text: str | None) -> list[float]:
    """The numbers named in ``STATISTICS``; a null or empty text gives zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    words = split_words(text)
    n, chars = max(1, len(words)), max(1, len(text))
    classes = class_counts(text) / chars
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    lines = text.count("\n") + 1
    return [
        np.log1p(len(words)),
        np.log1p(len(text)),
        *classes.tolist(),
        min(40.0, float(lengths.mean())),
        min(40.0, float(lengths.std())),
        len(counts) / n**0.8,
        max(counts.values(), default=0) / n,
        repeated_words(words) / n,
        duplicate_lines(text) / lines,
        float((lengths <= 3).mean()),
        sum(w.isupper() and len(w) > 1 for w in words) / n,
        sum(w[-1] in SYMBOLS or w[-1] == "!" for w in words) / n,
        np.log1p(n / lines),
    ]
