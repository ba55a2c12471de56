"""Plain makings that results are held against."""

from __future__ import annotations

from siftworks.llm.common import words_of


def shingle_set(text: str | None, size: int = 5) -> set:
    """Shingles of ``size`` words as tuples; a text of fewer words is one."""
    words = words_of(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def jaccard(x: set, y: set) -> float:
    return len(x & y) / max(1, len(x | y))
