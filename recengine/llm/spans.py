"""Spans of the scanners: leftmost, non-overlapping matches found at their anchors, and how spans are written."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

Span = tuple[int, int, str]


def written(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(set(spans), key=lambda s: (s[0], order[s[2]], s[1])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def anchored(text: str, anchor: str, left: re.Pattern, right: re.Pattern) -> Iterator[tuple[int, int]]:
    """Matches of left+ anchor right, where ``left`` is a class of characters without the anchor (a search for the last
    character outside it) and ``right`` follows the anchor: as a search from the left would find them, but only at the anchors."""
    end, at = 0, text.find(anchor)
    while at >= 0:
        begin = at
        while begin > end and left.match(text, begin - 1):
            begin -= 1
        if begin < at and (m := right.match(text, at + 1)):
            yield begin, m.end()
            end = m.end()
            at = text.find(anchor, end)
        else:
            at = text.find(anchor, at + 1)
