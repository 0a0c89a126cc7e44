"""Time-decayed sample statistics per key: newest sample per listing, window, cap, weights, weighted quantiles.

Samples are gathered per key only after `capped` has bounded a key's rows, which Spark pushes below the shuffle
(WindowGroupLimit), so a hot key never fills one task; statistics are then JVM expressions on one sorted array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HALF_LIFE_DAYS, WINDOW_DAYS, CAP = 30.0, 60, 400
MAD_SCALE = 1.4826


def newest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per keys, the first by `order`: a window of rank 1, whose limit Spark applies before the shuffle too."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def capped(df: DataFrame, keys: list[str], order: list[Column], most: int = CAP) -> DataFrame:
    """The first `most` rows of each key by `order`."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def windowed(df: DataFrame, keys: list[str], seconds: str, days: float = WINDOW_DAYS) -> DataFrame:
    """Rows not older than `days` before the newest of their key; the newest comes by a small aggregate and an
    equi-join, so that no key is gathered."""
    newest = df.groupBy(*keys).agg(F.max(seconds).alias("_newest"))
    return df.join(newest, keys).where(F.col(seconds) >= F.col("_newest") - days * 86400).drop("_newest")


def decay_weight(seconds: Column, newest: Column, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    return F.exp((seconds - newest) * (math.log(2) / (half_life_days * 86400)))


def samples_of(value: str, weight: str) -> Column:
    """Aggregate: the samples of a key as one array of (v, w), sorted by value, then weight."""
    return F.sort_array(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"))))


def with_positions(samples: Column) -> Column:
    """(p, v, w) of sorted samples, each at its own position (C_i - w_i / 2), equal values too."""
    start = F.struct(F.lit(0.0).alias("c"), F.array().cast("array<struct<p:double,v:double,w:double>>").alias("a"))
    step = lambda acc, x: F.struct((acc["c"] + x["w"]).alias("c"), F.array_append(acc["a"], F.struct((acc["c"] + x["w"] / 2).alias("p"), x["v"].alias("v"), x["w"].alias("w"))).alias("a"))
    return F.aggregate(samples, start, step)["a"]


def total_weight(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + x["w"])


def quantile(positioned: Column, total: Column, q: float) -> Column:
    """The weighted quantile of positioned samples: interpolated between the two positions around q, clamped at the ends;
    null where the total weight isn't positive, unless there is one sample only."""
    j = F.size(F.filter(positioned, lambda x: x["p"] <= total * q))
    lo, hi = F.get(positioned, j - 1), F.get(positioned, j)
    between = lo["v"] + (hi["v"] - lo["v"]) * (total * q - lo["p"]) / (hi["p"] - lo["p"])
    n = F.size(positioned)
    return F.when(n == 1, F.get(positioned, 0)["v"]).when(total <= 0, None).when(j == 0, hi["v"]).when(j == n, lo["v"]).otherwise(between)


def history_stats(samples: DataFrame, keys: list[str], value: str = "v", weight: str = "w") -> DataFrame:
    """n, effective n (Kish), weighted quartiles, their distance, weighted MAD (unscaled), least and largest, per key; one
    shuffle. A key's samples must have been capped before."""
    d = samples.groupBy(*keys).agg(samples_of(value, weight).alias("s"))
    d = d.select(*keys, "s", with_positions(F.col("s")).alias("a"), total_weight(F.col("s")).alias("t"))
    d = d.select("*", *(quantile(F.col("a"), F.col("t"), q).alias(c) for c, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))))
    off = F.sort_array(F.transform("s", lambda x: F.struct(F.abs(x["v"] - F.col("median")).alias("v"), x["w"].alias("w"))))
    d = d.select("*", with_positions(off).alias("b"))
    squares = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"])
    return d.select(
        *keys, F.size("s").cast("long").alias("n"), F.when(squares > 0, F.col("t") * F.col("t") / squares).otherwise(0.0).alias("n_eff"), F.get("s", 0)["v"].alias("least"), F.element_at("s", -1)["v"].alias("largest"),
        "q1", "median", "q3", F.greatest(F.lit(0.0), F.col("q3") - F.col("q1")).alias("iqr"), quantile(F.col("b"), F.col("t"), 0.5).alias("mad"),
    )


def warm_start(snapshots: DataFrame, listings: DataFrame, since: Column, most_risk: float | None = None, most: int = CAP) -> DataFrame:
    """What price history is filled with at the start: the newest accepted snapshot of each listing, observed `since` then and not
    above `most_risk` (null risks pass), the newest `most` of each (product_key, condition_class), with the key of the
    listing; `position` is the order in which they are to be loaded within their key.

    Null product keys are left out; a snapshot without its listing gives no row; ties in time go by id and listing."""
    s = snapshots.where(F.col("accepted") & (F.col("observed_at") >= since) & F.col("product_key").isNotNull())
    if most_risk is not None:
        s = s.where(F.col("risk").isNull() | (F.col("risk") <= most_risk))
    s = s.groupBy("listing_id").agg(F.max_by(F.struct("product_key", "condition_class", "total_price", "observed_at", "source"), F.struct("observed_at", "id")).alias("s")).select("listing_id", "s.*")
    s = capped(s, ["product_key", "condition_class"], [F.col("observed_at").desc(), F.col("listing_id")], most)
    s = s.withColumn("position", F.row_number().over(W.partitionBy("product_key", "condition_class").orderBy("observed_at", "listing_id")))
    return s.join(listings.select("listing_id", "listing_key"), "listing_id")
