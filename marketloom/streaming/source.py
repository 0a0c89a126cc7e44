"""A data source and sink of one's own, on Spark's Python Data Source API: newline-delimited JSON feeds.

`spark.dataSource.register(FeedSource)`, then `spark.read.format("feed").schema(...).load(folder)`: one partition
a file; lines that aren't objects are skipped. It shows where further connectors plug in.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "source string, source_id string, title string, price double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options.get("path", ""), schema.names)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in sorted(glob.glob(os.path.join(self.path, "*.jsonl")))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8") as f:
            for line in f:
                try:
                    o = json.loads(line)
                except ValueError:
                    continue
                if isinstance(o, dict):
                    yield tuple(o.get(n) for n in self.names)
