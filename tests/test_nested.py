import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from marketloom.operators import nested

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=20)


def leaves(o, path=()):
    if isinstance(o, dict):
        for k, v in o.items():
            yield from leaves(v, (*path, k))
    elif isinstance(o, list):
        for i, v in enumerate(o):
            yield from leaves(v, (*path, i))
    else:
        yield path, o


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_triples_hold_every_leaf(o):
    got = {t.path: t.value for t in nested.triples(json.dumps(o)) if t.kind in "sv0"}
    want = dict(leaves(o))
    assert got.keys() == want.keys()
    for p, v in want.items():
        assert got[p] == (v if isinstance(v, str) or v is None else json.dumps(v))


@pytest.mark.parametrize("bad", ["", "{", '{"a":1', "[1,]", '{"a" 1}', "01", "nul", '"a', "[1] 2", "{'a':1}", "NaN", "[1 2]", '{"a":1,}'])
def test_invalid(bad):
    with pytest.raises(ValueError):
        list(nested.triples(bad))


def test_deep_text_needs_no_recursion():
    n = 50_000
    assert sum(t.kind == "[" for t in nested.triples("[" * n + "]" * n)) == n


FORUM = {
    "kind": "Listing",
    "data": {
        "children": [
            {"kind": "t3", "data": {"name": "t3_a", "crosspost_parent_list": [{"name": "t3_b", "media_metadata": {"m": {}}}, {"name": None, "preview": {"images": [{"id": "lost"}]}}, 7], "preview": {"images": [{"id": "i"}, {"id": None}, "x"]}}},
            {"kind": "t3", "data": {"name": "t3_a"}},
            {"kind": None, "data": {"name": "t3_n"}},
            {"kind": "t3", "data": {}},
            ["no"],
            {"kind": "t1", "data": {"name": "t1_c", "media_metadata": {"not": {}}, "replies": {"kind": "Listing", "data": {"children": [{"kind": "t1", "data": {"name": "t1_d", "replies": ""}}, {"kind": "more", "data": {"name": "t1__", "children": ["x"]}}]}}}},
        ]
    },
}
ITEM = {"MainItem": {"Item": "A", "Warranty": [{"WarrantyID": 5}, {"WarrantyID": None}, "x"], "Image": {"ImagePathPattern": [{"Size": -1}, {"Size": 60.0}, {}]}, "ParentItem": {"Item": "B", "Warranty": {"WarrantyID": "7"}}}}


def test_links(spark):
    pages = lambda rows: spark.createDataFrame([(i, b, "x", "y") for i, b in rows], "page_id long, body string, parent_key string, child_key string")
    forum = pages([(1, json.dumps(FORUM)), (1, json.dumps(FORUM)), (2, json.dumps(FORUM)[:-3]), (3, None), (4, ""), (5, json.dumps([FORUM, {"kind": "Listing", "data": {"children": None}}]))])
    out = nested.page_links(forum, pages([(9, json.dumps(ITEM)), (10, "{}")]))
    got = sorted(tuple(r) for r in out.collect() if r.page_id in (1, 9))
    assert got == sorted([
        (1, "1", "t3", "t3_a"), (1, "t3_a", "crosspost", "t3_b"), (1, "t3_b", "media", "m"), (1, "t3_a", "image", "i"), (1, "1", "t1", "t1_c"), (1, "t1_c", "t1", "t1_d"), (1, "t1_c", "more", "t1__"),
        (9, "A", "warranty", "5"), (9, "A", "image_path", "-1"), (9, "A", "image_path", "60.0"), (9, "B", "warranty", "7"),
    ])
    assert out.where("page_id = 5").count() == 7
    assert out.where("page_id in (2, 3, 4, 10)").count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, body string")
    assert nested.page_links(none, none).count() == 0


def test_tables(spark):
    df = spark.createDataFrame([(9, json.dumps(ITEM)), (10, "{}"), (11, None), (12, '{"MainItem": {"Item": "C", "Deep": {"a": {"b": "\\ud800 x"}, "list": [1]}}}')], "page_id long, body string")
    rows = nested.related_tables(df, nested.PRODUCT)
    items = sorted(map(tuple, nested.pivoted(rows, "item", {"item": "Item", "deep": "Deep.a.b", "none": "x"}).collect()))
    assert items == [(9, "/MainItem", None, None, "A", None, None), (9, "/MainItem/ParentItem", "/MainItem", None, "B", None, None), (12, "/MainItem", None, None, "C", "\ufffd x", None)]
    warranties = sorted(map(tuple, nested.pivoted(rows, "warranty", {"id": "WarrantyID"}).collect()))
    assert warranties == [(9, "/MainItem/ParentItem/Warranty", "/MainItem/ParentItem", None, "7"), (9, "/MainItem/Warranty/0", "/MainItem", 0, "5"), (9, "/MainItem/Warranty/1", "/MainItem", 1, None)]
    assert nested.related_tables(df.limit(0), nested.FORUM).count() == 0
