"""Deeply nested records to flat tables that keep parent-child links.

`triples` stream-parses one JSON text with an explicit stack (no recursion, no tree): it yields
path-value-ordinal triples, the path being keys and array positions, as the text is read. `related_rows`
groups the triples by the repeated ancestors an operator asks for (`Anchor`) and pivots each group into
one row of one table, with the key of the row and of the nearest enclosing row. A record is cut up where
it lies; only rows of the tables leave the worker, and nothing has to be shuffled to reunite a record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from json.decoder import JSONDecodeError, scanstring
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.tables import spread

_SPACE = re.compile(r"[ \t\n\r]*").match
#: One value or the start of a container, and a key with its colon, each with the white space behind; texts with escapes,
#: which these leave out, are read by the decoder's own scanner.
_VALUE = re.compile(r'(?:"([^"\\\x00-\x1f]*)"|([{\[])|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false)|(null))[ \t\n\r]*').match
_NAME = re.compile(r'"([^"\\\x00-\x1f]*)"[ \t\n\r]*:[ \t\n\r]*').match
OBJECT, ARRAY = "{", "["


class Triple(NamedTuple):
    path: tuple  # keys (str) and positions (int), in order; the positions are the ordinals
    kind: str  # "{" and "[" open a container, "s" string, "v" other scalar, "0" null
    value: str | None


def triples(text: str) -> Iterator[Triple]:
    """The triples of a JSON text in document order; raises ValueError where it isn't valid JSON."""
    stack: list[tuple[tuple, str | int]] = []  # of each open container, the path and the key or position it is at
    base: tuple = ()
    at: str | int | None = None  # None at the top, else the key or position of the next value in the container at `base`
    i, n = _SPACE(text, 0).end(), len(text)
    while True:
        path = base if at is None else (*base, at)
        m = _VALUE(text, i)
        if m is None:
            if i >= n or text[i] != '"':
                raise ValueError(f"no value at {i}")
            value, i = _escaped(text, i)
            yield Triple(path, "s", value)
        else:
            i = m.end()
            which = m.lastindex
            if which == 1:
                yield Triple(path, "s", m.group(1))
            elif which == 3:
                yield Triple(path, "v", m.group(3))
            elif which == 4:
                yield Triple(path, "0", None)
            else:
                ch = m.group(2)
                yield Triple(path, ch, None)
                if i < n and text[i] == ("}" if ch == "{" else "]"):
                    i = _SPACE(text, i + 1).end()
                else:
                    stack.append((base, at))
                    base = path
                    if ch == "[":
                        at = 0
                    else:
                        at, i = _key(text, i)
                    continue
        # After a value: a comma, or ends of containers.
        while True:
            if at is None:
                if i != n:
                    raise ValueError(f"more text at {i}")
                return
            ch = text[i] if i < n else ""
            if ch == ",":
                i = _SPACE(text, i + 1).end()
                if type(at) is int:
                    at += 1
                else:
                    at, i = _key(text, i)
                break
            if ch != ("]" if type(at) is int else "}"):
                raise ValueError(f"no comma or end at {i}")
            base, at = stack.pop()
            i = _SPACE(text, i + 1).end()


def _escaped(text: str, i: int) -> tuple[str, int]:
    try:
        value, i = scanstring(text, i + 1, True)
    except JSONDecodeError as e:
        raise ValueError(str(e)) from e
    return value, _SPACE(text, i).end()


def _key(text: str, i: int) -> tuple[str, int]:
    m = _NAME(text, i)
    if m is not None:
        return m.group(1), m.end()
    if i >= len(text) or text[i] != '"':
        raise ValueError(f"no key at {i}")
    key, i = _escaped(text, i)
    if i >= len(text) or text[i] != ":":
        raise ValueError(f"no colon at {i}")
    return key, _SPACE(text, i + 1).end()


class Anchor(NamedTuple):
    """A repeated ancestor whose instances become the rows of `table`.

    suffix: how the instance's path ends; `int` stands for a position, `str` for any key.
    columns: leaf columns by name, as paths below the instance; "" is the last key of the path itself.
    within: tables whose nearest enclosing row is the parent; none found makes the row a root.
    tail: if given, the instance's path must be exactly the parent's path plus this (same wildcards).
    needs: a leaf that must hold a value: (steps up from the instance, key, value).
    objects_only: instances that aren't objects give no row.
    """

    table: str
    suffix: tuple
    columns: dict[str, tuple]
    within: tuple[str, ...] = ()
    tail: tuple[tuple, ...] = ()
    needs: tuple | None = None
    objects_only: bool = True


def _ends(path: tuple, suffix: tuple) -> bool:
    return len(path) >= len(suffix) and all(type(p) is s if isinstance(s, type) else p == s for p, s in zip(path[len(path) - len(suffix) :], suffix, strict=True))


class Row(NamedTuple):
    table: str
    path: tuple
    columns: dict[str, str | None]
    parent: Row | None
    leaves: dict[str, str]


def _by_last(anchors: tuple[Anchor, ...]) -> tuple[dict, list[Anchor], frozenset]:
    """Anchors by the last key that their instances' paths can end with (those that end with a position by the key
    before it), those that end with any key, and the keys of all leaves that they read."""
    named: dict[str, list[Anchor]] = {}
    free = []
    for a in anchors:
        name = next((x for x in reversed(a.suffix) if isinstance(x, str)), None)
        if name is None or a.suffix[-1] is str:
            free.append(a)
        else:
            named.setdefault(name, []).append(a)
    return named, free, frozenset(k for a in anchors for at in [*a.columns.values(), (a.needs or (0, None))[1:2]] for k in at[-1:])


def related_rows(text: str, anchors: tuple[Anchor, ...], whole: bool = False, by: tuple | None = None) -> list[Row]:
    """The rows of one record, or ValueError if it isn't valid JSON. `whole`: rows hold, beside the anchor's columns, all their own
    leaves, those below another row or an array excepted. `by`: `_by_last` of the anchors, if at hand."""
    leaves: dict[tuple, str | None] = {}
    found: list[tuple[Anchor, tuple]] = []
    named, free, read = by or _by_last(anchors)
    for path, kind, value in triples(text):
        if kind == "s" or kind == "v":
            if whole or (path and path[-1] in read):
                leaves[path] = value
        if path and (kind == OBJECT or kind != "0"):
            last = path[-1]
            hits = named.get(last if type(last) is str else path[-2] if len(path) > 1 else None, ())
            for a in (*hits, *free) if free else hits:
                if (kind == OBJECT or not a.objects_only) and _ends(path, a.suffix):
                    found.append((a, path))
        elif path and free:
            for a in free:
                if not a.objects_only and _ends(path, a.suffix):
                    found.append((a, path))
    rows: dict[tuple, Row] = {}
    out = []
    for a, path in found:  # document order: parents come before their children
        if a.needs and leaves.get((*path[: len(path) - a.needs[0]], a.needs[1])) != a.needs[2]:
            continue
        columns = {c: (str(path[-1]) if at == () else leaves.get((*path, *at))) for c, at in a.columns.items()}
        parent = None
        for k in range(len(path) - 1, -1, -1):
            r = rows.get(path[:k])
            if r is not None and r.table in a.within:
                parent = r
                break
        if a.tail and not (parent is not None and any(len(path) - len(parent.path) == len(t) and _ends(path, t) for t in a.tail)):
            continue
        rows[path] = row = Row(a.table, path, columns, parent, {})
        out.append(row)
    if whole:
        for path, value in leaves.items():
            k = len(path) - 1
            while k >= 0 and type(path[k]) is str and path[:k] not in rows:
                k -= 1
            if k >= 0 and path[:k] in rows:
                rows[path[:k]].leaves[".".join(path[k:])] = value
    return out


#: The tables of a forum listing: children at any depth, crossposts, preview images and media below them.
FORUM = (
    Anchor("child", ("data", "children", int), {"kind": ("kind",), "key": ("data", "name")}, within=("child",), needs=(3, "kind", "Listing")),
    Anchor("crosspost", ("crosspost_parent_list", int), {"key": ("name",)}, within=("child", "crosspost"), tail=(("data", "crosspost_parent_list", int), ("crosspost_parent_list", int))),
    Anchor("image", ("preview", "images", int), {"key": ("id",)}, within=("child", "crosspost"), tail=(("data", "preview", "images", int), ("preview", "images", int))),
    Anchor("media", ("media_metadata", str), {"key": ()}, within=("child", "crosspost"), tail=(("data", "media_metadata", str), ("media_metadata", str)), objects_only=False),
)
#: The tables of a product page: the item and its parent item, their warranties and image patterns.
PRODUCT = (
    Anchor("item", ("MainItem",), {"key": ("Item",)}),
    Anchor("item", ("ParentItem",), {"key": ("Item",)}, within=("item",), tail=(("ParentItem",),)),
    Anchor("item", ("ParentItem", int), {"key": ("Item",)}, within=("item",), tail=(("ParentItem", int),)),
    Anchor("warranty", ("Warranty",), {"key": ("WarrantyID",)}, within=("item",), tail=(("Warranty",),)),
    Anchor("warranty", ("Warranty", int), {"key": ("WarrantyID",)}, within=("item",), tail=(("Warranty", int),)),
    Anchor("image_path", ("Image", "ImagePathPattern", int), {"key": ("Size",)}, within=("item",), tail=(("Image", "ImagePathPattern", int),)),
)


_FORUM_BY, _PRODUCT_BY = _by_last(FORUM), _by_last(PRODUCT)


def _forum_links(page: str, body: str) -> set[tuple[str, str, str]]:
    linked: dict[tuple, str] = {}  # path of a row that has a link: its name
    posts: set[tuple] = set()  # posts and crossposts with a link
    out = set()
    for r in related_rows(body, FORUM, by=_FORUM_BY):
        key = r.columns["key"]
        if r.table == "child":
            kind = r.columns["kind"]
            held = r.parent is not None and _ends(r.path[len(r.parent.path) :], ("replies", "data", "children", int))
            parent = r.parent.columns["key"] if held else page
        else:
            kind = r.table
            parent = linked.get(r.parent.path) if r.parent.path in posts else None
        if kind is None or key is None:
            continue
        if r.table in ("child", "crosspost") and (r.table == "child" or parent is not None):
            linked[r.path] = key
            if kind != "t1" and kind != "more":
                posts.add(r.path)
        if parent is not None:
            out.add((parent, kind, key))
    return out


def _product_links(page: str, body: str) -> set[tuple[str, str, str]]:
    return {(r.parent.columns["key"], r.table, r.columns["key"]) for r in related_rows(body, PRODUCT, by=_PRODUCT_BY) if r.table != "item" and r.parent is not None and r.parent.columns["key"] is not None and r.columns["key"] is not None}


_SCHEMA = "page_id long, parent_key string, child_kind string, child_key string"


def _links(pages: DataFrame, links) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, parents, kinds, keys = [], [], [], []
            for page, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    for parent, kind, key in links(str(page), body):
                        ids.append(page)
                        parents.append(parent)
                        kinds.append(kind)
                        keys.append(key)
                except ValueError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([_text(x) for x in c], pa.string()) for c in (parents, kinds, keys))], names=["page_id", "parent_key", "child_kind", "child_key"])

    return spread(pages.where("body is not null and page_id is not null").select("page_id", "body")).mapInArrow(cut, _SCHEMA)


_ROWS = "page_id long, child_table string, row_path string, parent_path string, ordinal int, leaves map<string,string>"


def related_tables(pages: DataFrame, anchors: tuple[Anchor, ...]) -> DataFrame:
    """(page_id, child_table, row_path, parent_path, ordinal, leaves) of every instance of the anchors: which table it belongs
    to, where it stands, where the nearest enclosing row of another instance stands (null for none), its position if it
    stands in an array, and its own leaves by path below it. `pivoted` makes a table of it.

    Defined edge cases: as in `page_links`, but that rows without keys are kept and repeated pages give their rows again.
    No shuffle.
    """

    by = _by_last(anchors)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = related_rows(body, anchors, whole=True, by=by)
                except ValueError:
                    continue
                for r in rows:
                    ordinal = r.path[-1] if type(r.path[-1]) is int else None
                    out.append((page, r.table, _where(r.path), None if r.parent is None else _where(r.parent.path), ordinal, [(_text(k), _text(v)) for k, v in r.leaves.items()]))
            cols = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["page_id", "child_table", "row_path", "parent_path", "ordinal", "leaves"])

    return spread(pages.where("body is not null and page_id is not null").select("page_id", "body")).mapInArrow(cut, _ROWS)


def _where(path: tuple) -> str:
    return _text("/" + "/".join(map(str, path)))


def pivoted(rows: DataFrame, table: str, columns: dict[str, str]) -> DataFrame:
    """One table of `related_tables`: its links, and a column for each named leaf path (null where a row lacks it)."""
    return rows.where(F.col("child_table") == table).select("page_id", "row_path", "parent_path", "ordinal", *(F.col("leaves")[path].alias(c) for c, path in columns.items()))


_LONE = re.compile("[\ud800-\udfff]")


def _text(s: str) -> str:
    """Lone surrogates, which JSON escapes may hold and UTF-8 can't, become U+FFFD."""
    return s if s.isascii() else _LONE.sub("\ufffd", s)


def page_links(forum_pages: DataFrame, product_pages: DataFrame) -> DataFrame:
    """Parent-child rows (page_id, parent_key, child_kind, child_key), distinct, of both kinds of page.

    Defined edge cases: null, empty, cut-off and otherwise invalid bodies give no row; elements that aren't
    objects, and null or missing keys, give no row; an empty string is a key; repeated elements and repeated
    pages count once; further columns are ignored. The one shuffle is that of `distinct`, on rows already
    distinct within a page.
    """
    return _links(forum_pages, _forum_links).unionByName(_links(product_pages, _product_links)).groupBy("page_id", "parent_key", "child_kind", "child_key").agg(F.lit(1).alias("one")).drop("one")
