"""Specifications and parts of titles as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _largest(title: Column, pattern: str, lo: float, hi: float) -> Column:
    """The largest number a pattern's first group finds within bounds, as an integer."""
    found = F.transform(F.regexp_extract_all(title, F.lit(pattern), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    return F.array_max(F.filter(found, lambda x: (x >= lo) & (x <= hi))).cast("int")


def specs(title: Column) -> dict[str, Column]:
    """memory_gb, refresh_hz, size_in and panel of a title; null where it names none."""
    t = F.lower(title)
    panel = F.regexp_extract(t, r"\b(qd-oled|oled|ips|va|tn|mini-?led)\b", 1)
    return {
        "memory_gb": _largest(t, r"\b([0-9]{1,3}) ?gb?\b", 1, 512),
        "refresh_hz": _largest(t, r"\b([0-9]{2,4}) ?hz\b", 24, 1000),
        "size_in": _largest(t, r"\b([0-9]{2,3})(?:-| )?(?:inch|in\b|\")", 10, 120),
        "panel": F.when(panel != "", panel),
    }


def tags(title: Column) -> Column:
    """The bracketed tags of a title, in order, without repeats."""
    return F.array_distinct(F.transform(F.regexp_extract_all(title, F.lit(r"\[([^\[\]]{1,40})\]"), F.lit(1)), lambda x: F.trim(x)))


def untagged(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(title, r"\[[^\[\]]{1,40}\]", " "), r"\s+", " "))


def histogram_quantile(edges: Column, upto: Column, n: Column, q: float) -> Column:
    """A quantile from cumulative bucket counts, interpolated inside its bucket; what lies beyond the last edge
    counts as the last edge; null without rows. `edges` and `upto` are arrays in ascending order."""
    rank = n * F.lit(q)
    k = F.size(F.filter(upto, lambda c: c < rank))  # buckets that end before the rank
    lo, hi = F.when(k == 0, F.lit(0.0)).otherwise(F.get(edges, k - 1)), F.get(edges, k)
    below, here = F.when(k == 0, F.lit(0)).otherwise(F.get(upto, k - 1)), F.get(upto, k)
    return F.when(n > 0, F.when(k >= F.size(edges), F.element_at(edges, -1)).otherwise(lo + (hi - lo) * (rank - below) / F.greatest(here - below, F.lit(1))))
