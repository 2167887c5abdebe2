"""Spans of a text that touch others, found by their order."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable
from itertools import accumulate


def touching(spans: Iterable[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a span from a to b has a letter in common with one of the given ones.

    These are sorted once; of those that begin in front of b the furthest end decides.
    """
    ordered = sorted(spans)
    starts = [a for a, _ in ordered]
    furthest = list(accumulate((b for _, b in ordered), max))

    def touches(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i > 0 and furthest[i - 1] > a

    return touches
