"""Packing texts of varying token length into containers of several capacities.

Hierarchical: a text belongs to the smallest capacity that holds it (its tier); one larger than the largest
capacity is the only kind that is cut, into full containers and a rest. Tiers are packed from the longest
down, always with the largest text that still fits, and the gaps that a tier's own texts leave are filled
from the shorter tiers before those are packed themselves. Containers of a tier are dealt to step groups
so that the groups' attention costs (squared lengths) are alike.

Texts are dealt at random to lots of a bounded number of texts and every lot is packed by itself, so the work
spreads over all tasks; a lot leaves at most a few containers half full, which its size makes negligible.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.tables import cut_lineage, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Texts per lot, on average, and containers per step group.
LOT, STEP = 50_000, 16

_encoders: dict[tuple, object] = {}


def encoder(path: str, pattern: str | None = None):
    """The tokenizer of a rank file, once per process; `pattern` splits words (default: the one given with the file)."""
    if (path, pattern) not in _encoders:
        import tiktoken

        if pattern is None:
            from public_tokenizers import PATTERN

            pattern_text = PATTERN
        else:
            pattern_text = pattern
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern_text, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """(key, n_tokens) of every row; a null text has none."""
    kind = documents.schema[key].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, pattern)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    return spread(documents.select(key, text)).mapInArrow(count, T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType())]))


class Placed(NamedTuple):
    item: int
    piece: int
    tokens: int
    tier: int  # position in the sorted capacities
    container: int  # number within the tier
    start: int
    group: int


class _Shelf:
    """Items by size; hands out the largest that fits."""

    def __init__(self) -> None:
        self.by_size: dict[int, list] = defaultdict(list)
        self.sizes: list[int] = []

    def fill(self, items: list[tuple[int, int, int]]) -> None:
        for it in items:
            self.by_size[it[2]].append(it)
        self.sizes = sorted(self.by_size)

    def take(self, room: int) -> tuple[int, int, int] | None:
        k = bisect_right(self.sizes, room) - 1
        if k < 0:
            return None
        size = self.sizes[k]
        it = self.by_size[size].pop()
        if not self.by_size[size]:
            del self.by_size[size]
            del self.sizes[k]
        return it


def pack(sizes: list[int], capacities: list[int], step: int = STEP) -> list[Placed]:
    """Place items of the given sizes; `capacities` ascending and positive. Sizes of 0 go anywhere."""
    largest = capacities[-1]
    tiers: list[list[tuple[int, int, int]]] = [[] for _ in capacities]
    for item, size in enumerate(sizes):
        piece = 0
        while size > largest:
            tiers[-1].append((item, piece, largest))
            size -= largest
            piece += 1
        tiers[next(k for k, c in enumerate(capacities) if size <= c)].append((item, piece, size))
    shelves = []
    for t in tiers:
        s = _Shelf()
        s.fill(t)
        shelves.append(s)
    out: list[Placed] = []
    for k in range(len(capacities) - 1, -1, -1):
        containers: list[list[tuple[int, int, int]]] = []
        while shelves[k].sizes:
            room, inside = capacities[k], []
            for shelf in reversed(shelves[: k + 1]):
                while (it := shelf.take(room)) is not None:
                    inside.append(it)
                    room -= it[2]
            containers.append(inside)
        cost = [sum(n * n for *_, n in c) for c in containers]
        n_groups = -(-len(containers) // step) or 1
        group = [0] * len(containers)
        for rank, c in enumerate(sorted(range(len(containers)), key=lambda c: -cost[c])):
            lap, at = divmod(rank, n_groups)
            group[c] = at if lap % 2 == 0 else n_groups - 1 - at
        for c, inside in enumerate(containers):
            start = 0
            for item, piece, n in inside:
                out.append(Placed(item, piece, n, k, c, start, group[c]))
                start += n
    return out


def packed(documents: DataFrame, context_sizes: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, pattern: str | None = None, lot: int = LOT) -> DataFrame:
    """(key, piece, n_tokens, size_id, capacity_tokens, container_id, start_token, step_group): every text, or
    piece of a text over the largest capacity, in exactly one container.

    Defined edge cases: null and empty texts have no tokens and still get a container; repeated rows are
    packed each; capacities that are null or not positive are left out, equal ones count once (the smallest
    size_id), and without any the call raises ValueError; no documents give no rows. Two shuffles, both of
    numbers only: sizes to lots. Sizes are checkpointed, so lots come out the same after a lost executor.
    """
    caps = context_sizes.where("capacity_tokens > 0").groupBy("capacity_tokens").agg(F.min("size_id").alias("size_id")).orderBy("capacity_tokens").limit(1001).collect()
    if not caps or len(caps) > 1000:
        raise ValueError("context_sizes needs 1 to 1000 capacities")
    capacities, ids = [c[0] for c in caps], [c[1] for c in caps]
    sized = cut_lineage(token_counts(documents, key, text, tokenizer, pattern).withColumn("row", F.monotonically_increasing_id()))
    n_lots = max(1, round(sized.count() / lot))
    kind = documents.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("piece", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("size_id", T.LongType()), T.StructField("capacity_tokens", T.LongType()), T.StructField("container_id", T.StringType()), T.StructField("start_token", T.LongType()), T.StructField("step_group", T.StringType())])

    def pack_lot(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        no = t.column("lot")[0].as_py()
        rows = pack(t.column("n_tokens").to_pylist(), capacities)
        long = lambda it: pa.array(it, pa.int64())
        return pa.table(
            [
                t.column(key).take(long([r.item for r in rows])), long([r.piece for r in rows]), long([r.tokens for r in rows]), long([ids[r.tier] for r in rows]), long([capacities[r.tier] for r in rows]),
                pa.array([f"{ids[r.tier]}-{no}-{r.container}" for r in rows], pa.string()), long([r.start for r in rows]), pa.array([f"{ids[r.tier]}-{no}-{r.group}" for r in rows], pa.string()),
            ],
            names=schema.names,
        )

    return sized.withColumn("lot", F.pmod(F.xxhash64("row"), F.lit(n_lots))).groupBy("lot").applyInArrow(pack_lot, schema)
