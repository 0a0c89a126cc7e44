"""Keyed merges, change detection, retention: tables kept up to date from late, repeated and partial rows.

All merges are order-independent aggregates (max_by, min_by), so they combine before the shuffle, survive hot
keys and give the same table however rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(rows: DataFrame, keys: list[str], order: list[Column], latest: list[str], newest_known: list[str] = (), first: dict[str, str] | None = None, least: dict[str, str] | None = None, seen: str | None = None, count: str | None = None) -> DataFrame:
    """One row per keys: `latest` columns from the last row by `order`, `newest_known` from the last row that has
    them, `first` (new name: column) from the first row, `least` the smallest; with `seen` a first_seen and
    last_seen, with `count` how many rows there were. `rows` is the stored table united with the new batch."""
    at = F.struct(*order)
    out = [F.max_by(c, at).alias(c) for c in latest]
    out += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in newest_known]
    out += [F.min_by(c, at).alias(n) for n, c in (first or {}).items()]
    out += [F.min(c).alias(n) for n, c in (least or {}).items()]
    if seen:
        out += [F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen")]
    if count:
        out.append(F.count(F.lit(1)).alias(count))
    return rows.groupBy(*keys).agg(*out)


def fill_gaps(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str], any_true: list[str] = (), largest: list[str] = ()) -> DataFrame:
    """Repeated rows of one key inside a batch as one: the first non-null value of each column, flags or-ed, scores
    at their largest."""
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(*(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns), *(F.bool_or(c).alias(c) for c in any_true), *(F.max(c).alias(c) for c in largest))


def redelivered(rows: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Rows without repeats of the same content under a new key; the smallest key stays. Only hashes are shuffled
    with the key, not the content."""
    h = F.xxhash64(*(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in content))
    h2 = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in content)), 256)
    return rows.select(F.struct(h, h2).alias("_h"), key).groupBy("_h").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("deliveries")).drop("_h")


def changes(rows: DataFrame, keys: list[str], order: list[Column], signature: list[str], oldest: Column | None = None) -> DataFrame:
    """Rows that are new or whose signature differs from the row before, by `order`; `oldest`: rows for which it
    is false are remembered but not given out (stale ones)."""
    w = W.partitionBy(*keys).orderBy(*order)
    sig = F.struct(*signature)
    d = rows.withColumns({"_sig": sig}).withColumns({"_before": F.lag("_sig").over(w), "_at": F.row_number().over(w)})
    d = d.where((F.col("_at") == 1) | ~F.col("_sig").eqNullSafe(F.col("_before")))
    return (d.where(oldest) if oldest is not None else d).drop("_sig", "_before", "_at")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't in `gone`."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def pruned(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows not older than `days` before `now`."""
    return rows.where(F.col(at) >= now - F.expr(f"interval {days} days"))


def scrubbed(rows: DataFrame, stale: Column, text: list[str], mark: str = "[purged]") -> DataFrame:
    """Text columns blanked where `stale`, numbers kept."""
    return rows.withColumns({c: F.when(stale & F.col(c).isNotNull(), F.lit(mark)).otherwise(F.col(c)) for c in text})


def first_identity(rows: DataFrame, token: str, ident: str, order: list[Column]) -> DataFrame:
    """Each token's first identity, so that one thing keeps one id whatever later rows call it."""
    return rows.groupBy(token).agg(F.min_by(ident, F.struct(*order)).alias(ident))
