"""Percentiles per group of very large numeric columns.

`select_percentiles` is exact distributed multi-select. Percentiles of a group share open ranges that hold their
answers; ranges of one group are the same or apart, so that a row lies in one at most. One pass over the rows in
open ranges does two things: it counts them below, at and above the pivot, and tasks propose the local medians
of both sides. The counts discard the side without the answer, and the weighted median of the proposals for the other is the
next pivot. Once few of the rows are still in ranges, these rows alone are written and read from then on, so that all
rounds together read the table a few times at most. Every group goes through a round; ranges that have only
a handful of rows left are then settled by sorting those.

`part_summaries` makes a small summary of every part (such as a day) with a known rank error; summaries of
any parts can be kept and combined later by `combine`. Errors relative to the rows don't grow by merging, only by
thinning; summaries are merged in trees and each thinning spends a share of what is left under a bound of 0.1 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.tables import cut_lineage

PERCENTILES = (50, 90, 95, 99)
#: After a round, a range with at most so many rows is settled by sorting them.
SETTLE = 1024
#: Rows still in ranges are written anew once they are at most this share of the rows read.
NARROW = 0.25
#: Ranges of up to so many groups (some 200 bytes each) are sent to all tasks; beyond, they are joined by key.
FEW_GROUPS = 50_000
#: A task gathers so many rows before it proposes or summarises.
GATHER = 500_000


def usable(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(g, v) of the rows that count: nulls and NaN are left out; a null group is a group."""
    v = F.col(value).cast("double")
    return rows.select(F.col(group).alias("g"), v.alias("v")).where(v.isNotNull() & ~F.isnan(v))


def _offers(rows: DataFrame) -> DataFrame:
    """From rows (g, v, lo, pivot): per group and range, how many rows are below, at and above the pivot (less, same,
    more; all count as above where there is no pivot yet), and the weighted medians of the local medians of
    the two sides (low, high)."""
    schema = T.StructType([rows.schema["g"], T.StructField("lo", T.DoubleType()), T.StructField("side", T.IntegerType()), T.StructField("v", T.DoubleType()), T.StructField("n", T.LongType())])

    def proposed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        g = t.column("g").combine_chunks() if t.column("g").num_chunks != 1 else t.column("g").chunk(0)
        v, lo, pivot = (t.column(c).to_numpy() for c in ("v", "lo", "pivot"))
        code = g.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        side = np.where(np.isnan(pivot) | (v > pivot), 1, np.where(v < pivot, 0, 2))
        order = np.lexsort((v, side, lo, code))
        c, s, low, x = code[order], side[order], lo[order], v[order]
        new = (c[1:] != c[:-1]) | (s[1:] != s[:-1]) | ~((low[1:] == low[:-1]) | (np.isnan(low[1:]) & np.isnan(low[:-1])))
        starts = np.nonzero(np.append(True, new))[0]
        n = np.diff(np.append(starts, len(c)))
        open_ = np.isnan(low[starts])
        return pa.RecordBatch.from_arrays([g.take(pa.array(order[starts])), pa.array(low[starts], mask=open_), pa.array(s[starts], pa.int32()), pa.array(x[starts + (n - 1) // 2]), pa.array(n, pa.int64())], names=["g", "lo", "side", "v", "n"])

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= GATHER:
                yield proposed(held)
                held = []
        if held:
            yield proposed(held)

    w = W.partitionBy("g", "lo", "side")
    o = rows.select("g", "v", "lo", "pivot").mapInArrow(propose, schema).repartition("g", "lo")
    o = o.withColumn("upto", F.sum("n").over(w.orderBy("v").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("side") == k, F.col("n"))), F.lit(0).cast("long"))
    median = lambda k: F.min(F.when((F.col("side") == k) & (F.col("upto") * 2 >= F.col("all")), F.col("v")))
    return o.groupBy("g", "lo").agg(of(0).alias("less"), of(2).alias("same"), of(1).alias("more"), median(0).alias("low"), median(1).alias("high"))


def _inside(base: DataFrame, state: DataFrame, groups: int) -> DataFrame:
    """Rows (g, v, lo, pivot, hi) with the open range that they lie in; others are left out."""
    wide = state.groupBy(F.col("g").alias("g2")).agg(F.collect_set(F.struct("lo", "hi", "pivot")).alias("ranges"))
    wide = F.broadcast(wide) if groups <= FEW_GROUPS else wide.hint("merge")
    d = base.join(wide, F.col("g").eqNullSafe(F.col("g2")))
    mine = F.filter("ranges", lambda r: (r["lo"].isNull() | (F.col("v") > r["lo"])) & (r["hi"].isNull() | (F.col("v") < r["hi"])))
    return d.select("g", "v", F.get(mine, F.lit(0)).alias("r")).where("r is not null").select("g", "v", "r.lo", "r.hi", "r.pivot")


def select_percentiles(rows: DataFrame, group: str, value: str, percentiles: tuple[int, ...] = PERCENTILES, settle: int = SETTLE) -> DataFrame:
    """(group, percentile, n, value, rank_error): the smallest value of the group that at least percentile per
    cent of its n values don't exceed; exact, so rank_error is 0.

    Defined edge cases: null and NaN values are left out and a group with no others gives no row; infinite
    values count; ties count each; a null group is a group of its own; no rows give no rows; further
    columns are ignored.
    """
    base = usable(rows, group, value)
    none = F.lit(None).cast("double")
    first = cut_lineage(_offers(base.select("g", "v", none.alias("lo"), none.alias("pivot"))))
    k = F.greatest(F.floor((F.col("more") * F.col("p") + 99) / 100).cast("long"), F.lit(1).cast("long"))
    state = first.select("g", "more", "high", F.explode(F.array(*(F.lit(p) for p in percentiles))).alias("p"))
    state = state.select("g", "p", F.col("more").alias("n"), k.alias("k"), none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("more").alias("left"), F.col("high").alias("pivot"), none.alias("answer"))
    size, least = None, 0
    while True:
        active = state.where(F.col("answer").isNull() & (F.col("left") > least))
        some = active.groupBy("g", "lo").agg(F.max("left").alias("left")).agg(F.sum("left").alias("rows"), F.count_distinct("g").alias("groups"), F.count(F.lit(1)).alias("ranges")).first()
        if not some.ranges:
            break
        if size is None:
            size = some.rows
        elif some.rows <= size * NARROW:
            unsettled = state.where("answer is null")  # those with few rows left are read once more at the end
            base = cut_lineage(_inside(base, unsettled, _groups(unsettled)).select("g", "v"))
            size = some.rows
        got = _offers(_inside(base, active, some.groups)).withColumnsRenamed({"g": "g2", "lo": "lo2"})
        three = active.join(got.hint("merge"), F.col("g").eqNullSafe(F.col("g2")) & F.col("lo").eqNullSafe(F.col("lo2")))
        under, at = F.col("below") + F.col("less"), F.col("below") + F.col("less") + F.col("same")
        down, up = F.col("k") <= under, F.col("k") > at
        moved = three.select(
            "g", "p", "n", "k",
            F.when(up, F.col("pivot")).otherwise(F.col("lo")).alias("lo"), F.when(down, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
            F.when(up, at).otherwise(F.col("below")).alias("below"),
            F.when(down, F.col("less")).when(up, F.col("more")).otherwise(F.lit(0)).alias("left"),
            F.when(down, F.col("low")).when(up, F.col("high")).alias("pivot"),
            F.when(~down & ~up, F.col("pivot")).alias("answer"),
        )
        state = cut_lineage(moved.unionByName(state.where(F.col("answer").isNotNull() | (F.col("left") <= least))))
        least = settle
    unsettled = state.where("answer is null")
    few = _inside(base, unsettled, _groups(unsettled)).groupBy("g", "lo").agg(F.sort_array(F.collect_list("v")).alias("vs")).withColumnsRenamed({"g": "g2", "lo": "lo2"})
    rest = unsettled.join(few.hint("merge"), F.col("g").eqNullSafe(F.col("g2")) & F.col("lo").eqNullSafe(F.col("lo2"))).withColumn("answer", F.get("vs", (F.col("k") - F.col("below") - 1).cast("int")))
    out = state.where("answer is not null").unionByName(rest.select(*state.columns))
    return out.select(F.col("g").alias(group), F.col("p").alias("percentile"), "n", F.col("answer").alias("value"), F.lit(0).cast("long").alias("rank_error"))


def _groups(state: DataFrame) -> int:
    return state.select("g").distinct().count()


#: A percentile from summaries is at most this share of the group's rows away from its rank, however many batches,
#: parts and merges there were.
BOUND = 0.001
#: Each thinning may spend this share of the error that is left under the bound.
SPEND = 0.25
#: A merge gathers so many points before it thins them.
HELD = 32_768
#: Summaries are merged so many at a time or more, in a tree.
FAN = 16


def _compress(values: np.ndarray, weights: np.ndarray, err: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted distinct values with weights, thinned. A kept value stands also for the values dropped below it, so
    that the rows up to any x are undercounted by `err` at most. Error is spent only from what `BOUND` leaves and
    only where it at least halves the values, so that few rows are kept whole."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    last = np.append(np.nonzero(v[1:] != v[:-1])[0], len(v) - 1)
    v, upto = v[last], np.cumsum(weights[order])[last]
    n = int(upto[-1])
    add = int((2 * BOUND * n - err) * SPEND)  # undercounts are halved where percentiles are read
    if add > 0 and len(v) > 2 * n / add:
        kept, j, top = [], -1, len(v) - 1
        while j < top:
            j = min(max(int(np.searchsorted(upto, (upto[j] if j >= 0 else 0) + add, side="right")), j + 1), top)
            kept.append(j)
        below = np.append(0, upto[kept][:-1])
        before = np.append(0, upto)[kept]
        v, upto, err = v[kept], upto[kept], err + int(np.max(before - below))
    return v, np.diff(upto, prepend=0), err


_SUMMARY = [T.StructField("n", T.LongType()), T.StructField("rank_error", T.LongType()), T.StructField("points", T.ArrayType(T.DoubleType())), T.StructField("weights", T.ArrayType(T.LongType()))]


def _lists(a: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, a)]), pa.int32()), pa.array(np.concatenate(a) if a else [], kind))


def _arrays(a: pa.ListArray) -> list[np.ndarray]:
    flat, at = a.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *a.value_lengths().to_pylist()])
    return [flat[i:j] for i, j in zip(at, at[1:])]


class _Tree:
    """Summaries of one key merged in a balanced tree, so that a value is thinned a logarithmic number of times;
    a few summaries of each level are held at a time however many come."""

    def __init__(self) -> None:
        self.n, self.levels = 0, []

    def add(self, n: int, err: int, v: np.ndarray, w: np.ndarray, level: int = 0) -> None:
        self.n += n
        while True:
            if level == len(self.levels):
                self.levels.append([])
            held = self.levels[level]
            held.append((v, w, err))
            if len(held) < FAN or sum(len(a) for a, *_ in held) <= HELD:
                return
            v, w, err = _together(held)
            self.levels[level] = []
            level += 1

    def settled(self) -> tuple[np.ndarray, np.ndarray, int]:
        held = [x for level in self.levels for x in level]
        return held[0] if len(held) == 1 else _together(held)


def _together(held: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    return _compress(np.concatenate([v for v, *_ in held]), np.concatenate([w for _, w, _ in held]), sum(e for *_, e in held))


def _merged(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """One summary per key: summaries are brought together by key and merged as they stream by, so that a task
    holds a few of them at a time however many a key has."""
    s = summaries.select(*keys, "n", "rank_error", "points", "weights")
    schema = T.StructType([*(s.schema[k] for k in keys), *_SUMMARY])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        out: list[tuple] = []
        size = 0

        def emit() -> pa.RecordBatch:
            *ks, n, e, v, w = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(ks, types, strict=True)), pa.array(n, pa.int64()), pa.array(e, pa.int64()), _lists(v, pa.float64()), _lists(w, pa.int64())], names=schema.names)

        types: list[pa.DataType] = []
        for b in batches:
            types = [b.schema.field(k).type for k in keys]
            m = len(keys)
            for *key, rn, re_, v, w in zip(*(b.column(k).to_pylist() for k in range(m + 2)), _arrays(b.column(m + 2)), _arrays(b.column(m + 3)), strict=True):
                if key != now:
                    if tree:
                        v2, w2, e = tree.settled()
                        out.append((*now, tree.n, e, v2, w2))
                        size += len(v2) + 1
                    now, tree = key, _Tree()
                    if size >= GATHER:
                        yield emit()
                        out, size = [], 0
                tree.add(rn, re_, v, w)
        if tree:
            v2, w2, e = tree.settled()
            out.append((*now, tree.n, e, v2, w2))
            yield emit()

    return s.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def part_summaries(rows: DataFrame, group: str, value: str, part: str) -> DataFrame:
    """(group, part, n, rank_error, points, weights): one summary per group and part, merged from summaries of
    what a task reads, so that rows don't move. Counting weights up to a value gives the rows up to it or at most
    rank_error fewer. Nulls, NaN and empty tables as in `select_percentiles`."""
    v = F.col(value).cast("double")
    d = rows.select(F.col(group).alias("g"), F.col(part).alias("part"), v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    schema = T.StructType([*(T.StructField(a, d.schema[a].dataType) for a in ("g", "part")), *_SUMMARY])

    def summarised(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        gp = pa.Table.from_batches(held).rename_columns(["g", "part", "v"]).group_by(["g", "part"]).aggregate([("v", "list")]).combine_chunks()
        made = [_compress(x, np.ones(len(x), np.int64), 0) for c in gp.column("v_list").chunks for x in _arrays(c)]
        key = [pa.concat_arrays(gp.column(c).chunks) for c in ("g", "part")]
        return pa.RecordBatch.from_arrays([*key, pa.array([int(w.sum()) for _, w, _ in made], pa.int64()), pa.array([e for *_, e in made], pa.int64()), _lists([x for x, *_ in made], pa.float64()), _lists([w for _, w, _ in made], pa.int64())], names=["g", "part", "n", "rank_error", "points", "weights"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= GATHER:
                yield summarised(held)
                held = []
        if held:
            yield summarised(held)

    s = d.mapInArrow(local, schema)
    s = _merged(s, ["g", "part"])
    return s.withColumnsRenamed({"g": group, "part": part})


def read_percentiles(summaries: DataFrame, keys: tuple[str, ...], percentiles: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """(keys, percentile, n, value, rank_error) of every summary: the value's rank is at most rank_error away from the
    percentile's."""
    s = summaries.select(*keys, "n", "rank_error", "points", "weights")
    m = len(keys)
    schema = T.StructType([*(s.schema[k] for k in keys), T.StructField("percentile", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("rank_error", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, ps, ns, vs, es = [], [], [], [], []
            for i, (n, err, v, w) in enumerate(zip(b.column(m).to_pylist(), b.column(m + 1).to_pylist(), _arrays(b.column(m + 2)), _arrays(b.column(m + 3)), strict=True)):
                upto = np.cumsum(w) + err // 2  # the middle of what the true count can be
                for p in percentiles:
                    of.append(i)
                    ps.append(p)
                    ns.append(n)
                    vs.append(float(v[np.searchsorted(upto, max((n * p + 99) // 100, 1))]))
                    es.append(err - err // 2)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(of, pa.int64())) for c in range(m)), pa.array(ps, pa.int32()), pa.array(ns, pa.int64()), pa.array(vs, pa.float64()), pa.array(es, pa.int64())], names=schema.names)

    return s.mapInArrow(read, schema)


def combined(summaries: DataFrame, group: str) -> DataFrame:
    """(group, n, rank_error, points, weights): one summary of each group from those of any of its parts."""
    s = summaries.select(F.col(group).alias("g"), "n", "rank_error", "points", "weights", F.pmod(F.xxhash64("points"), F.lit(16)).alias("lot"))
    return _merged(_merged(s, ["g", "lot"]), ["g"]).withColumnRenamed("g", group)


def combine(summaries: DataFrame, group: str, percentiles: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """(group, percentile, n, value, rank_error) from summaries of any parts of the same groups: the value's
    rank is at most rank_error away from the percentile's, and rank_error at most `BOUND` of n, rounded up."""
    return read_percentiles(combined(summaries, group), (group,), percentiles)


def part_and_total_percentiles(rows: DataFrame, group: str, value: str, part: str) -> DataFrame:
    """(group, scope, part, percentile, n, value, rank_error): percentiles of every part (scope `part`) and of all
    parts of a group together (scope `all`, part null), both read from the parts' summaries, which are written once
    into the shared folder. Errors and edge cases as in `combine`."""
    kept = cut_lineage(part_summaries(rows, group, value, part))
    each = read_percentiles(kept, (group, part))
    total = combine(kept, group).withColumn(part, F.lit(None).cast(rows.schema[part].dataType))
    columns = (group, "scope", part, "percentile", "n", "value", "rank_error")
    return each.withColumn("scope", F.lit("part")).select(*columns).unionByName(total.withColumn("scope", F.lit("all")).select(*columns))
