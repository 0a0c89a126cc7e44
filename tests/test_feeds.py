import json

import pytest
from marketloom.sources import feeds, trees


def pages(spark, *bodies):
    return spark.createDataFrame([(i, b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)], "page_id long, body string")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


BAD = ("", None, "{", "[]", "7", '{"products": 5, "itemSummaries": {}, "data": null}')


def test_bestbuy(spark):
    p = {"products": [{"sku": 1, "name": "A", "salePrice": 5.5, "regularPrice": 9, "onlineAvailability": False}, {"sku": 2, "name": "B", "regularPrice": "7.25", "orderable": "Available"}, {"name": "no sku"}, "x"]}
    assert rows(feeds.bestbuy(pages(spark, p, *BAD)), "source_id", "price_num", "list_price_num", "in_stock") == [("1", 5.5, 9.0, False), ("2", 7.25, None, True)]


def test_shopify(spark):
    one = {"title": "T", "variants": [{"id": 1, "title": "Default Title", "price": 12345, "compare_at_price": 0, "available": True}, {"id": 2, "title": "Red", "price": 100, "compare_at_price": 200}]}
    assert rows(feeds.shopify(pages(spark, one, *BAD), False), "source_id", "title", "price_num", "list_price_num") == [("1", "T", 123.45, None), ("2", "T - Red", 1.0, 2.0)]
    many = {"products": [{"title": "T", "variants": [{"id": 3, "title": "Blue", "price": "1,234.50"}]}, {"title": "U"}]}
    assert rows(feeds.shopify(pages(spark, many), True), "source_id", "title", "price_num") == [("3", "T - Blue", 1234.5)]


def test_search(spark):
    money = lambda v, c="USD": {"value": v, "currency": c}
    p = {"itemSummaries": [
        {"itemId": "a", "title": "A", "price": money("10.00"), "itemWebUrl": "u", "shippingOptions": [{"shippingCost": money("5.00")}, {"shippingCost": money("1.00", "EUR")}, {"shippingCost": money("4.50")}], "itemCreationDate": "2025-09-01T00:00:00Z", "itemOriginDate": "2025-09-02T00:00:00Z"},
        {"itemId": "b", "buyingOptions": ["AUCTION"], "price": money("1")}, {"itemId": "c", "currentBidPrice": money("1")}, {"itemId": "d"}, {"itemId": "e", "price": money("1")}, "text",
    ]}
    got = rows(feeds.search_items(pages(spark, p, *BAD)), "pos", "skip_reason", "price_num", "shipping_num", "posted_epoch")
    assert got[0] == (0, None, 10.0, 4.5, 1756771200.0)
    assert [g[1] for g in got] == [None, "auction_only", "auction_bid_price", "no_price", "no_url", "malformed"]


def test_positional(spark):
    p = {"data": {"decode": {"minPostingId": 1000, "minPostedDate": 5000}, "items": [[7, 3, 1, 250, "1:2~40.5~-73.5", [4, "x"], "Title A"], [8, 4, 1, -1, "1:2", "Title B"], "bad"]}}
    got = rows(feeds.positional(pages(spark, p, *BAD)), "source_id", "title", "price_num", "posted_epoch", "latitude")
    assert got == [("1007", "Title A", 250.0, 5003.0, 40.5), ("1008", "Title B", None, 5004.0, None)]


def test_mapped_and_embedded(spark):
    html = '<html><script id="__NEXT_DATA__" type="application/json">{"props": {"list": [{"i": 5, "n": {"t": "A"}, "c": 1999}, {"i": 6}]}}</script></html>'
    p = feeds.embedded_json(pages(spark, html, "<html></html>", None))
    got = feeds.mapped(p, "props.list", {"source_id": "i", "title": "n.t", "price_num": "c"}, divisor=100, url_template="https://x/{source_id}")
    assert rows(got, "source_id", "title", "price_num", "url") == [("5", "A", 19.99, "https://x/5")]
    with pytest.raises(ValueError):
        feeds.mapped(p, "a..b[", {"source_id": "i", "title": "t"})


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        """<?xml version="1.0"?><rss><channel>
        <item><title>Card $1,299.99 shipped</title><link>https://x/1</link><guid>thread-77</guid><pubDate>Sun, 31 Aug 2025 19:58:10 GMT</pubDate><content:encoded xmlns:content="c">&lt;img src="https://i/1.jpg"&gt;</content:encoded></item>
        <item><title>No price</title><link>https://x/2</link></item><item><description>no title</description></item></channel></rss>"""
    )
    assert rows(feeds.rss(spark, str(tmp_path)), "source_id", "price_num", "posted_epoch") == [("77", 1299.99, 1756670290.0), ("https://x/2", None, None)]


def test_swap_posts(spark):
    post = lambda name, title, **k: {"kind": "t3", "data": {"name": name, "title": title, **k}}
    p = {"kind": "Listing", "data": {"children": [post("a", "[USA-OH] [H] GPU [W] PayPal"), post("b", "[USA-CA] [H] Cash [W] GPU"), post("c", "[USA] [H] GPU [W] SSD"), post("d", "hello"), post("e", "[X] [H] Y [W] Venmo", stickied=True), post("f", "[X] [H] Y [W] Venmo", removed_by_category="mod")]}}
    d = feeds.swap_intent(feeds.forum(pages(spark, p, *BAD)))
    assert rows(d.select("source_id", feeds.skip_reason().alias("why")), "source_id", "why") == [("a", None), ("b", "not_selling"), ("c", "not_selling"), ("d", "no_swap_title"), ("e", "stickied"), ("f", "removed")]


def test_trees(spark):
    body = 'for (;;);{"a": [{"id": 1, "price": {"id": 9}}]}\n{"b": {"c": {"id": 2, "price": null}}} trailing {"broken'
    got = trees.tree_rows(pages(spark, body, None, ""), ("id", "price"))
    assert [json.loads(r.node)["id"] for r in got.orderBy("pos").collect()] == [1, 2]
    deep = "[" * 90_000 + "]" * 90_000
    assert list(trees.documents_of(deep)) == []
