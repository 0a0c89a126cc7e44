"""Bodies of several JSON documents, and searches through their trees."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def documents_of(text: str) -> Iterator[object]:
    """The JSON documents of a text, in order; a guard prefix such as `for (;;);` and text between is skipped."""
    decoder, i = json.JSONDecoder(), 0
    while i < len(text):
        starts = [k for k in (text.find("{", i), text.find("[", i)) if k >= 0]
        if not starts:
            return
        i = min(starts)
        try:
            doc, i = decoder.raw_decode(text, i)
            yield doc
        except ValueError:
            i += 1
        except RecursionError:
            return


def nodes_with(doc: object, needs: frozenset[str], most_depth: int = 64) -> Iterator[dict]:
    """Objects that have all of the keys `needs`, in document order; nothing below a found one is searched."""
    stack = [(doc, 0)]
    while stack:
        o, depth = stack.pop()
        if isinstance(o, dict) and needs <= o.keys():
            yield o
        elif depth < most_depth and isinstance(o, (dict, list)):
            stack += [(x, depth + 1) for x in reversed(list(o.values() if isinstance(o, dict) else o))]


def tree_rows(pages: DataFrame, needs: tuple[str, ...], key: str = "page_id", body: str = "body") -> DataFrame:
    """(key, pos, node): each found object as JSON text, whatever its depth and however many documents a body has."""
    wanted = frozenset(needs)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, pos, nodes = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = (n for doc in documents_of(t) for n in nodes_with(doc, wanted))
                for i, n in enumerate(found):
                    keys.append(k)
                    pos.append(i)
                    nodes.append(json.dumps(n, ensure_ascii=True))
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(pos, pa.int32()), pa.array(nodes, pa.string())], names=[key, "pos", "node"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, body).where(f"`{body}` is not null").mapInArrow(search, f"`{key}` {kind}, pos int, node string")
