"""Expressions on numbers, arrays, maps, JSON and identities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def listing_key(source: Column, source_id: Column) -> Column:
    return F.concat_ws(":", source, source_id)


def fingerprint(key: Column) -> Column:
    """The first 20 hex digits of the SHA-1 of a key."""
    return F.substring(F.sha1(key), 1, 20)


def event_id(*parts: Column) -> Column:
    """A deterministic id, equal when a task is run again."""
    return F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)), 256)


def distinct_urls(c: Column, most: int = 8) -> Column:
    """The first `most` different http(s) URLs in order."""
    return F.slice(F.array_distinct(F.filter(c, lambda x: x.rlike(r"(?i)^https?://[^\s/]+"))), 1, most)


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def price_bucket(price: Column, pct: float) -> Column:
    """Logarithmic buckets of a width of `pct`; prices within pct of each other lie at most one apart."""
    return F.when(price > 0, F.floor(F.ln(price) / F.log1p(F.lit(pct)))).otherwise(F.lit(0)).cast("long")


def noisy_or(ps: Column) -> Column:
    """1 - product of (1 - p) over an array of probabilities."""
    return 1 - F.aggregate(ps, F.lit(1.0), lambda a, p: a * (1 - p))


def merge_maps(primary: Column, other: Column) -> Column:
    """`primary`, with keys it lacks filled from `other`."""
    lacking = F.map_filter(other, lambda k, _: ~F.map_contains_key(primary, k))
    return F.map_concat(primary, lacking)


def bracket_depth(c: Column) -> Column:
    """The deepest nesting of brackets; closing ones without an opening don't count."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(a, ch):
        now = F.when(ch.isin("(", "["), a["now"] + 1).when(ch.isin(")", "]") & (a["now"] > 0), a["now"] - 1).otherwise(a["now"])
        return F.struct(now.alias("now"), F.greatest(a["top"], now).alias("top"))

    return F.aggregate(F.split(c, ""), zero, step, lambda a: a["top"])


_STEP = re.compile(r"([^.\[\]]+)|\[(-?\d+)\]")


def compile_path(path: str) -> list[str | int]:
    """`a.b[0].c` as steps; raises ValueError for what isn't a path. Negative positions count from the end."""
    steps: list[str | int] = []
    at = 0
    for m in _STEP.finditer(path):
        if path[at : m.start()] not in ("", "."):
            break
        steps.append(m.group(1) if m.group(1) is not None else int(m.group(2)))
        at = m.end()
    if at != len(path) or not steps:
        raise ValueError(f"not a path: {path!r}")
    return steps


def json_path(doc: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null where there is none or the text isn't JSON."""
    at, name = doc, "$"
    for s in compile_path(path):
        if isinstance(s, str):
            name += f"['{s}']"
        elif s >= 0:
            name += f"[{s}]"
        else:  # an array from its end, and what follows inside the element
            items = F.from_json(F.get_json_object(at, name), "array<variant>")
            at, name = F.concat(F.lit('{"v":'), F.to_json(F.try_element_at(items, F.lit(s))), F.lit("}")), "$['v']"
    return F.get_json_object(at, name)


def lenient_number(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "[$,]", "").try_cast("double")


def lenient_bool(c: Column) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "yes", "y", "1", "in_stock", "instock", "available"), True).when(t.isin("false", "no", "n", "0", "out_of_stock", "outofstock", "unavailable", "sold"), False)


def near_any(c: Column, marks: tuple[float, ...], within: float = 0.005) -> Column:
    """Whether a value lies within a distance of any of some marks, as placeholder prices do."""
    return F.exists(F.array(*(F.lit(float(m)) for m in marks)), lambda m: F.abs(m - c) <= within)


def dropped(before: Column, now: Column, share: float, least: float, epsilon: float = 1e-6) -> Column:
    """Whether a value fell by at least a share and at least an amount."""
    return (now <= before * (1 - share) + epsilon) & (before - now >= least - epsilon)


def quota_interval(calls: Column, budget: Column, safety: float = 0.85) -> Column:
    """Seconds between rounds of `calls` calls that keep within a share of a day's budget."""
    return F.lit(86400.0) * calls / (budget * safety)
