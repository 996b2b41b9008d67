"""Output shared by the two span finders: counts and digest of the base spans, and the list of all spans."""

from __future__ import annotations

import hashlib

Span = tuple[int, int, str]


def listed(spans: list[Span], kinds: tuple[str, ...]) -> str:
    order = sorted(spans, key=lambda s: (s[0], kinds.index(s[2])))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


def digest(base: list[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(listed(base, kinds).encode()).hexdigest()
