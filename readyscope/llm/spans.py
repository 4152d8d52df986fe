"""Spans of text: kind, start and end in code points, end exclusive."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

Span = tuple[str, int, int]
SPANS = "array<struct<kind:string,start:int,end:int>>"


def matches(
    kind: str, pattern: re.Pattern, accept: Callable[[re.Match], bool], text: str
) -> Iterator[Span]:
    """Leftmost non-overlapping matches; those not accepted are dropped, not retried."""
    for found in pattern.finditer(text):
        if accept(found):
            yield kind, found.start(), found.end()


def in_order(spans: Iterable[Span], kinds: list[str]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


class Overlaps:
    """The spans that overlap a place, without a look at all of them."""

    def __init__(self, spans: Iterable[Span] = ()):
        self.spans = sorted(spans, key=lambda s: (s[1], s[2]))
        self.starts = [s for _, s, _ in self.spans]
        # the farthest end of a span and all before it
        self.reach = list(accumulate((e for _, _, e in self.spans), max))

    def at(self, start: int, end: int) -> Iterator[Span]:
        i = bisect_left(self.starts, end) - 1
        while i >= 0 and self.reach[i] > start:
            if self.spans[i][2] > start:
                yield self.spans[i]
            i -= 1


class Taken:
    """Places that do not overlap each other, kept in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, start: int, end: int) -> bool:
        """Take a place unless it overlaps a taken one."""
        i = bisect_left(self.starts, end)
        if i and self.ends[i - 1] > start:
            return False
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


def redact(text: str, spans: Iterable[tuple[str, int, int]]) -> str:
    """Replace every span by its kind in brackets; what overlaps is replaced together."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined in their order."""
    parts = F.transform(
        spans,
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(parts, ",")


def digest(spans: Column) -> Column:
    return F.sha2(joined(spans).cast("binary"), 256)


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
