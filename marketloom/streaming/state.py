"""Streams: stateful steps, splits of bad payloads, keyed sinks, windows with late data."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketloom.operators.fold import Step


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream; `files_per_trigger` is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_fold(stream: DataFrame, keys: list[str], order: list[str], step: Step, schema: T.StructType) -> DataFrame:
    """`keyed_fold` over a stream: rows of a micro-batch are taken in order, state lives in the state store as JSON.
    Rows that come late are judged by their own time, as the step defines it."""
    names = schema.names

    def run(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
        out: list[dict] = []
        for row in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            held, more = step(held, row)
            out += more
        if held is not None:
            state.update((json.dumps(held),))
        yield pd.DataFrame([[r.get(n) for n in names] for r in out], columns=names)

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def split_payloads(raw: DataFrame, payload: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows that fit the schema, dead letters): JSON payloads parsed permissively; what doesn't parse is kept
    with its text instead of being lost."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    d = raw.withColumn("_r", F.from_json(payload, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    good = d.where(~bad).select(*(f"_r.{f.name}" for f in schema.fields))
    return good, d.where(bad).select(F.col(payload).alias("payload"))


def windowed_counts(stream: DataFrame, at: str, by: list[str], window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per window; rows later than the watermark are dropped by it."""
    d = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    w = F.window(at, window, slide) if slide else F.window(at, window)
    return d.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


class KeyedTable:
    """A table kept in versions under one folder and replaced as a whole by each micro-batch: `merge(old united with
    batch)` is written as the next version, then named current. A batch that was written before is skipped, so
    that a replay after a failure changes nothing."""

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], keep: int = 3):
        self.spark, self.path, self.merge, self.keep = spark, path, merge, keep

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        jvm, fs = self._fs()
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def current(self) -> DataFrame | None:
        v = self.versions()
        return self.spark.read.parquet(f"{self.path}/v={v[-1]}") if v else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        done = self.versions()
        if done and done[-1] >= batch_id:
            return
        old = self.current()
        rows = batch if old is None else old.unionByName(batch, allowMissingColumns=True)
        self.merge(rows).write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
        jvm, fs = self._fs()
        for v in self.versions()[: -self.keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={v}"), True)


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Everything that is there now, in micro-batches, to the end."""
    q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()


def latest_only(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """A merge for KeyedTable: the last row of each key."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(*keys, "_r.*")
