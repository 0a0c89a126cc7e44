"""Sequential state per key: one step function, run over a table (here) or a stream (marketloom.streaming).

A step takes the key's state (None at first) and a row and gives the new state and the rows to put out. Over a
table, rows are brought together by key and sorted inside the partition, and pass through as a stream of Arrow
batches with the state of one key at a time: a hot key needs no more memory than a cold one.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

Step = Callable[[dict | None, dict], tuple[dict | None, list[dict]]]


def keyed_fold(df: DataFrame, keys: list[str], order: list[str | Column], step: Step, schema: T.StructType) -> DataFrame:
    """The rows `step` puts out, key by key in the given order. Null keys are keys. Deterministic if `order` is total."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for b in batches:
            out: list[dict] = []
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != now:
                    now, state = key, None
                state, rows = step(state, row)
                out += rows
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in out], _arrow(f.dataType)) for f in schema], names=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def claim_step(key: str, value: str, at: str, ttl: float, again: Callable[[float, float], bool]) -> Step:
    """Give each thing out once: `new` when its key isn't held, `again` when `again(previous, value)` says so (which
    holds it anew), else `duplicate`, which changes nothing. A claim ends `ttl` seconds after it was made; late
    rows are judged by their own time."""

    def step(state: dict | None, row: dict) -> tuple[dict | None, list[dict]]:
        v, t = row[value], row[at]
        if state is None or state["until"] <= t:
            status, before, state = "new", None, {"v": v, "until": t + ttl}
        elif again(state["v"], v):
            status, before, state = "again", state["v"], {"v": v, "until": t + ttl}
        else:
            status, before = "duplicate", state["v"]
        return state, [{**row, "status": status, "previous": before}]

    return step


def cluster_claim_step(kind: str, listing: str, price: str, bucket: str, at: str, token: str, listing_ttl: float, cluster_ttl: float, drop_share: float, drop_least: float, epsilon: float = 1e-6) -> Step:
    """Claims of listings that others may offer too, and their undoing; the state is that of one store and product.

    A claim (`kind` claim) of a listing that is held is a `price_drop` if the price fell by the share and the amount asked
    for, which holds it anew, else a `duplicate`, which changes nothing. A listing that isn't held is a
    `cross_source_duplicate` if another listing owns its price bucket or a neighbouring one, else `new`. New and dropped ones own
    their bucket (null: none). A `rollback` with the token of a claim undoes it if no later one has replaced it: what was held
    before comes back with the time it had left. Listings and buckets end after their own times to live."""

    def step(state: dict | None, row: dict) -> tuple[dict | None, list[dict]]:
        s = state or {"held": {}, "owned": {}, "undo": {}}
        held, owned, undo = s["held"], s["owned"], s["undo"]
        t = row[at]
        for table in (held, owned, undo):
            for k in [k for k, v in table.items() if v["until"] <= t]:
                del table[k]
        who, tok = row[listing], row[token]
        if row[kind] == "rollback":
            u, done = undo.pop(tok, None), False
            if u is not None:
                for table, key, before in ((held, u["who"], u["held"]), (owned, u["bucket"], u["owned"])):
                    if key in table and table[key]["token"] == tok:
                        done = True
                        if before is not None and before["left"] > 0:
                            table[key] = {**{k: v for k, v in before.items() if k != "left"}, "until": t + before["left"]}
                        else:
                            del table[key]
            return s, [{**row, "status": "undone" if done else "superseded", "previous": None, "owner": None}]
        p, b = row[price], row[bucket]
        now, previous, owner = held.get(who), None, None
        if now is not None:
            previous = now["price"]
            drop = p <= previous * (1 - drop_share) + epsilon and previous - p >= drop_least - epsilon
            status = "price_drop" if drop else "duplicate"
        else:
            other = next((o for k in (b, b - 1, b + 1) if (o := owned.get(k)) is not None and o["who"] != who), None) if b is not None else None
            status = "new" if other is None else "cross_source_duplicate"
            if other is not None:
                previous, owner = other["price"], other["who"]
        if status in ("new", "price_drop"):
            before = [None if x is None else {**x, "left": x["until"] - t} for x in (now, owned.get(b) if b is not None else None)]
            undo[tok] = {"who": who, "bucket": b, "held": before[0] if status == "price_drop" else None, "owned": before[1], "until": t + max(listing_ttl, cluster_ttl)}
            held[who] = {"price": p, "token": tok, "until": t + listing_ttl}
            if b is not None:
                owned[b] = {"who": who, "price": p, "token": tok, "until": t + cluster_ttl}
        return s, [{**row, "status": status, "previous": previous, "owner": owner}]

    return step


def admission_step(at: str, span: float, most: int) -> Step:
    """Admit at most `most` rows in any `span` seconds; refused rows don't count against later ones."""

    def step(state: dict | None, row: dict) -> tuple[dict | None, list[dict]]:
        t = row[at]
        held = [x for x in (state or {"at": []})["at"] if x > t - span]
        ok = len(held) < most
        return {"at": [*held, t] if ok else held}, [{**row, "admitted": ok}]

    return step


def history_step(listing: str, value: str, at: str, window: float, cap: int) -> Step:
    """Put out, before each row counts itself, what its key's history says: n and the median of the newest sample
    per listing; then let the row in. A sample older than its listing's is ignored; samples leave when
    older than `window` seconds before the newest, or beyond `cap`, oldest first."""

    def step(state: dict | None, row: dict) -> tuple[dict | None, list[dict]]:
        # held: listing -> [value, time]; values and times are kept sorted beside it, so that a row costs little.
        state = state or {"held": {}, "values": [], "times": []}
        held, vs, ts = state["held"], state["values"], state["times"]
        n = len(vs)
        median = None if not n else vs[n // 2] if n % 2 else (vs[n // 2 - 1] + vs[n // 2]) / 2

        def leave(k: str) -> None:
            v0, t0 = held.pop(k)
            del vs[bisect_left(vs, v0)]
            del ts[bisect_left(ts, [t0, k])]

        v, t, who = row[value], row[at], str(row[listing])
        if v is not None and math.isfinite(v) and not (who in held and held[who][1] > t):
            if who in held:
                leave(who)
            held[who] = [v, t]
            insort(vs, v)
            insort(ts, [t, who])
            while len(ts) > cap or ts[0][0] < ts[-1][0] - window:
                leave(ts[0][1])
        return state, [{**row, "n_before": n, "median_before": median}]

    return step
