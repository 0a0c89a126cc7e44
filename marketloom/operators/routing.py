"""Rows to targets by a configured list of routes, and small predicates on times of day.

Routes are configuration, a few dozen at most: each is an expression, so that rows are matched where they lie, without
a join, and what they match comes out in the order of the configuration.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Route(NamedTuple):
    name: str
    when: Column  # which rows it takes
    targets: tuple[str, ...]
    mention: bool = False
    quiet: tuple[str, str] | None = None  # from HH:MM to HH:MM of local time nothing goes out by it
    exempt: Column | None = None  # but these rows


def minute_of(hhmm: str) -> int:
    """Minutes after midnight of HH:MM; ValueError for anything else."""
    h, sep, m = hhmm.strip().partition(":")
    if not (sep and h.isdigit() and m.isdigit() and len(m) == 2 and int(h) < 24 and int(m) < 60):
        raise ValueError(f"not HH:MM: {hhmm!r}")
    return int(h) * 60 + int(m)


def minute_of_day(at: Column, zone: str) -> Column:
    local = F.from_utc_timestamp(at, zone)
    return F.hour(local) * 60 + F.minute(local)


def in_window(minute: Column, start: str, end: str) -> Column:
    """Whether a minute of the day lies from `start` up to `end`, which may be past midnight; never if both are the same."""
    a, b = minute_of(start), minute_of(end)
    if a == b:
        return F.lit(False)
    return (minute >= a) & (minute < b) if a < b else (minute >= a) | (minute < b)


def routed(rows: DataFrame, routes: list[Route], at: Column, zone: str = "UTC") -> DataFrame:
    """`rows` with routes (names of those that take the row and aren't quiet), targets (different ones, in the order of the
    routes), mention, and suppressed: `quiet_hours` or `no_match` where there is no target."""
    minute = minute_of_day(at, zone)
    fits, speaks = [], []
    for r in routes:
        quiet = F.lit(False) if r.quiet is None else in_window(minute, *r.quiet) & ~(F.coalesce(r.exempt, F.lit(False)) if r.exempt is not None else F.lit(False))
        takes = F.coalesce(r.when, F.lit(False))
        fits.append(F.when(takes, r.name))
        speaks.append(F.when(takes & ~quiet, F.struct(F.lit(r.name).alias("name"), F.array(*map(F.lit, r.targets)).alias("targets"), F.lit(r.mention).alias("mention"))))
    some = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    d = rows.withColumns({"_fits": some(fits), "_open": some(speaks)})
    return d.select(
        *rows.columns, F.transform("_open", lambda x: x["name"]).alias("routes"), F.array_distinct(F.flatten(F.transform("_open", lambda x: x["targets"]))).alias("targets"), F.exists("_open", lambda x: x["mention"]).alias("mention"),
        F.when(F.size("_fits") == 0, "no_match").when(F.size("_open") == 0, "quiet_hours").alias("suppressed"),
    )


def deliveries_fold(deliveries: DataFrame, keys: list[str], ok: str) -> DataFrame:
    """Per keys: how many deliveries, whether any arrived, and whether all failed."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return deliveries.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bool_or(good).alias("any_ok"), (~F.bool_or(good)).alias("all_failed"))


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait by a header that gives seconds or a date; 0 for dates that are past, null for anything else."""
    seconds = F.trim(header).try_cast("double")
    when = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(header), r"^[A-Za-z]{3}, ", ""), " GMT$", " +0000"), F.lit("dd MMM yyyy HH:mm:ss Z"))
    left = F.when(seconds.isNotNull(), seconds).otherwise((F.unix_micros(when) - F.unix_micros(now)) / 1e6)
    return F.when(left.isNotNull() & ~F.isnan(left), F.greatest(F.lit(0.0), left))


def record_class(accepted: Column, reject_code: Column, gate: Column, keyed: Column, compatible: tuple[str, ...]) -> Column:
    """(status, usable, code) of a record: unclassified without a decision, rejected, gated after it (usable as an observation
    if the gate is one of `compatible`), or accepted; usable only with a product key."""
    made = lambda status, usable, code: F.struct(F.lit(status).alias("status"), usable.alias("usable"), code.cast("string").alias("code"))
    no, none = F.lit(False), F.lit(None)
    return F.when(accepted.isNull(), made("unclassified", no, none)).when(~accepted, made("rejected", no, F.coalesce(reject_code, F.lit("rejected")))).when(gate.isNotNull(), made("gated", gate.isin(*compatible) & keyed, gate)).otherwise(made("accepted", keyed, none))


def widest_band(bands: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """The band that holds all bands of its keys, turned round if it was the wrong way."""
    lo, hi = F.min(low), F.max(high)
    return bands.groupBy(*keys).agg(F.least(lo, hi).alias("low"), F.greatest(lo, hi).alias("high"))
