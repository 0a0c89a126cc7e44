"""Reading tables and cutting lineage: the two things every plan shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; zone-less timestamps are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast(T.TimestampType()) for c in ntz}) if ntz else df


#: Input of less than so many estimated bytes a core is dealt out anew before work in Python.
SMALL = 1 << 17


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt out over all cores when it is small, as a single file of a few megabytes is: work in Python would
    otherwise keep most of them idle. Larger inputs are left as they lie. Goes by the planner's estimate, which
    for scans is the files' size, and runs nothing."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only where none is named (tests) fall back to an own folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        shared = os.path.join(tempfile.gettempdir(), "marketloom-checkpoints")
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
