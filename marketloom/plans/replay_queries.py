"""Queries of sequential state per key, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions import values
from marketloom.operators import fold
from marketloom.tables import load


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def claim_replay(spark: SparkSession, d: str) -> DataFrame:
    """Listings given out once per three days, and again when a tenth cheaper."""
    i = load(spark, d, "deal_items").where("total_price is not null and not isnan(total_price)")
    i = i.select(values.listing_key(F.col("source"), F.col("source_id")).alias("l"), "item_id", F.col("total_price").alias("v"), (F.unix_micros("received_at") / 1e6).alias("t"))
    step = fold.claim_step("l", "v", "t", 72 * 3600.0, lambda before, now: now <= before * 0.9)
    return fold.keyed_fold(i, ["l"], ["t", "item_id"], step, _schema("item_id long, status string, previous double"))


def history_replay(spark: SparkSession, d: str) -> DataFrame:
    """What each listing's query knew before it: number and median of the newest samples of 60 days, 400 at most."""
    i = load(spark, d, "deal_items").where("query is not null and total_price is not null and not isnan(total_price)")
    i = i.select(F.concat_ws("|", "query", "item_condition").alias("k"), "item_id", values.listing_key(F.col("source"), F.col("source_id")).alias("l"), F.col("total_price").alias("v"), (F.unix_micros("received_at") / 1e6).alias("t"))
    return fold.keyed_fold(i, ["k"], ["t", "item_id"], fold.history_step("l", "v", "t", 60 * 86400.0, 400), _schema("item_id long, n_before long, median_before double"))


def admission_replay(spark: SparkSession, d: str) -> DataFrame:
    """At most 30 rows of a source in any hour."""
    r = load(spark, d, "raw_listings").select("source", "obs_id", (F.unix_micros("received_at") / 1e6).alias("t"))
    return fold.keyed_fold(r, ["source"], ["t", "obs_id"], fold.admission_step("t", 3600.0, 30), _schema("obs_id long, admitted boolean"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (claim_replay, history_replay, admission_replay)}
SQL: dict[str, str] = {
    # One row of every key at a time: what is held, and until when.
    "claim_replay": """
        WITH RECURSIVE b AS (SELECT item_id, concat_ws(':', source, source_id) AS l, total_price AS v, epoch_us(received_at) / 1e6 AS t, row_number() OVER (PARTITION BY source, source_id ORDER BY received_at, item_id) AS k
          FROM deal_items WHERE total_price IS NOT NULL AND NOT isnan(total_price)),
        r(l, k, item_id, status, previous, held, til) AS (
          SELECT l, k, item_id, 'new', NULL::DOUBLE, v, t + 259200 FROM b WHERE k = 1
          UNION ALL
          SELECT b.l, b.k, b.item_id, CASE WHEN til <= t THEN 'new' WHEN v <= held * 0.9 THEN 'again' ELSE 'duplicate' END, CASE WHEN til <= t THEN NULL ELSE held END,
            CASE WHEN til <= t OR v <= held * 0.9 THEN v ELSE held END, CASE WHEN til <= t OR v <= held * 0.9 THEN t + 259200 ELSE til END
          FROM r JOIN b ON b.l = r.l AND b.k = r.k + 1)
        SELECT item_id, status, previous FROM r""",
    # Of the rows before, the last one of each listing counts, if it isn't older than 60 days before the row before; a key has under 400 listings in sf0.01.
    "history_replay": """
        WITH b AS (SELECT item_id, concat_ws('|', query, item_condition) AS k, concat_ws(':', source, source_id) AS l, total_price AS v, epoch_us(received_at) / 1e6 AS t, row_number() OVER (PARTITION BY query, item_condition ORDER BY received_at, item_id) AS n
          FROM deal_items WHERE query IS NOT NULL AND total_price IS NOT NULL AND NOT isnan(total_price)),
        p AS (SELECT x.item_id, y.l, y.v, y.t FROM b x JOIN b y ON x.k = y.k AND y.n < x.n JOIN b z ON z.k = x.k AND z.n = x.n - 1 WHERE isfinite(y.v) AND y.t >= z.t - 5184000 QUALIFY row_number() OVER (PARTITION BY x.item_id, y.l ORDER BY y.n DESC) = 1),
        c AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY t DESC, l DESC) <= 400)
        SELECT b.item_id, count(c.v)::BIGINT AS n_before, median(c.v) AS median_before FROM b LEFT JOIN c USING (item_id) GROUP BY b.item_id""",
    # One row of every source at a time: when the admitted ones of the last hour came.
    "admission_replay": """
        WITH RECURSIVE b AS (SELECT source, obs_id, epoch_us(received_at) / 1e6 AS t, row_number() OVER (PARTITION BY source ORDER BY received_at, obs_id) AS k FROM raw_listings),
        r(source, k, obs_id, admitted, held) AS (
          SELECT source, k, obs_id, true, [t] FROM b WHERE k = 1
          UNION ALL
          SELECT s.source, s.k, s.obs_id, len(s.h) < 30, CASE WHEN len(s.h) < 30 THEN list_append(s.h, s.t) ELSE s.h END
          FROM (SELECT b.source, b.k, b.obs_id, b.t, list_filter(r.held, lambda x: x > b.t - 3600) AS h FROM r JOIN b ON b.source = r.source AND b.k = r.k + 1) s)
        SELECT obs_id, admitted FROM r""",
}
