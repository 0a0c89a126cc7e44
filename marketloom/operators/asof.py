"""As-of and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_before(rows: DataFrame, key: str, at: str, tie: str, value: str, bucket_seconds: int = 86400) -> DataFrame:
    """Count, sum and least of `value` over strictly earlier rows of the key (by `at` in seconds, then `tie`), for
    every row. Rows are ordered inside (key, bucket) only; what came in earlier buckets is a running sum over
    one aggregate row per bucket, so no task gathers a hot key."""
    d = rows.withColumn("_b", F.floor(F.col(at) / bucket_seconds))
    per = d.groupBy(key, "_b").agg(F.count(value).alias("_n"), F.sum(value).alias("_s"), F.min(value).alias("_m"))
    upto = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(F.col(key), F.col("_b"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(upto), F.lit(0.0)).alias("_s0"), F.min("_m").over(upto).alias("_m0"))
    inside = W.partitionBy(key, "_b").orderBy(at, tie).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumns({"_n1": F.count(value).over(inside), "_s1": F.coalesce(F.sum(value).over(inside), F.lit(0.0)), "_m1": F.min(value).over(inside)})
    d = d.alias("d").join(per.withColumnRenamed(key, "_k").withColumnRenamed("_b", "_c").alias("p"), F.col(f"d.{key}").eqNullSafe(F.col("p._k")) & (F.col("d._b") == F.col("p._c")))
    return d.select("d.*", (F.col("_n0") + F.col("_n1")).alias("n_before"), (F.col("_s0") + F.col("_s1")).alias("sum_before"), F.least("_m0", "_m1").alias("least_before")).drop("_b", "_n1", "_s1", "_m1")


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, columns: list[str], bucket: float = 86400) -> DataFrame:
    """For each row of `left` the columns of the latest row of `right` with the key and right_at <= at (numbers);
    left rows without one keep nulls, a null key meets null keys, ties on the right are settled by the columns.
    Rows are ordered inside (key, bucket) only; the last row of the buckets before comes from one row per bucket."""
    row_type, hit_type = left.select(F.struct(*left.columns)).schema.fields[0].dataType, right.select(F.struct(*columns)).schema.fields[0].dataType
    a = left.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(hit_type).alias("_r"))
    b = right.select(F.col(key).alias("_k"), F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(row_type).alias("_l"), F.struct(*columns).alias("_r"))
    d = a.unionByName(b).withColumn("_b", F.floor(F.col("_t") / bucket))
    inside = W.partitionBy("_k", "_b").orderBy("_t", "_side", "_r").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_here", F.last("_r", ignorenulls=True).over(inside)).where("_side = 1")
    per = b.withColumn("_b", F.floor(F.col("_t") / bucket)).groupBy("_k", "_b").agg(F.max_by("_r", F.struct("_t", "_r")).alias("_last"))
    # Buckets of the right carry their last row on to the buckets of the left that follow.
    marks = per.select("_k", "_b", "_last").unionByName(d.select("_k", "_b", F.lit(None).cast(hit_type).alias("_last")).distinct())
    marks = marks.groupBy("_k", "_b").agg(F.first("_last", ignorenulls=True).alias("_last"))
    upto = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    marks = marks.select(F.col("_k").alias("_k2"), F.col("_b").alias("_b2"), F.last("_last", ignorenulls=True).over(upto).alias("_before"))
    d = d.join(marks, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_b") == F.col("_b2")))
    hit = F.coalesce("_here", "_before")
    return d.select("_l.*", hit.alias("_hit")).select(*left.columns, *(F.col(f"_hit.{c}").alias(c) for c in columns))


def near_pairs(rows: DataFrame, key: list[str], bucket: str, ident: str, at: str, seconds: int) -> DataFrame:
    """Pairs (a, b) of different `ident`, a earlier than b by at most `seconds`, with equal keys and buckets at most
    one apart: an equi-join on the exploded bucket and a slot of time, then the interval test."""
    slot = F.floor(F.col(at) / seconds)
    a = rows.select(
        *(F.col(k).alias(f"k{i}") for i, k in enumerate(key)), F.col(ident).alias("a_id"), F.col(at).alias("a_at"),
        F.explode(F.expr(f"transform(sequence(0, 5), i -> struct({bucket} + i % 3 - 1 as b, floor({at} / {seconds}) + i div 3 as s))")).alias("c"),
    ).select("*", "c.b", "c.s").drop("c")
    b = rows.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(key)), F.col(bucket).alias("b"), slot.alias("s"), F.col(ident).alias("b_id"), F.col(at).alias("b_at"))
    on = [*(f"k{i}" for i in range(len(key))), "b", "s"]
    gap = F.col("b_at") - F.col("a_at")
    return a.join(b, on).where((F.col("a_id") != F.col("b_id")) & (gap >= 0) & (gap <= seconds) & ((gap > 0) | (F.col("a_id") < F.col("b_id")))).select("a_id", "b_id", gap.alias("gap"))
