"""Spans of text: (start, end, kind) in code points, end exclusive. Shared by the PII and the secret operator."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa

Span = tuple[int, int, str]
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
SPAN_DDL = "array<struct<start: long, end: long, kind: string>>"


def ordered(spans: Iterable[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then kind as listed."""
    return sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1]))


def apart(found: Iterable[Span], base: list[Span]) -> list[Span]:
    """The spans that overlap none of ``base``."""
    return [s for s in found if all(s[1] <= b[0] or s[0] >= b[1] for b in base)]


def uncovered(found: Iterable[Span], base: list[Span]) -> list[Span]:
    """The parts of the spans that no span of ``base`` covers."""
    out = []
    for start, end, kind in found:
        for b in sorted(b for b in base if b[0] < end and b[1] > start):
            if b[0] > start:
                out.append((start, b[0], kind))
            start = max(start, b[1])
        if start < end:
            out.append((start, end, kind))
    return out


def as_structs(spans: list[Span]) -> list[dict]:
    return [{"start": s, "end": e, "kind": k} for s, e, k in spans]


def replaced(text: str, spans: list[Span]) -> str:
    """``text`` with each span as its kind in brackets; overlapping spans become one, named after the first."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
