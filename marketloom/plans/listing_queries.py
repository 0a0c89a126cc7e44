"""Queries of scans, routing, claims, model answers and small predicates, over whole tables.

Scans are tested end to end: every row of `raw_listings` is written into payloads of the shape that a source gives, fifty to a
page, and the scan must give back what the SQL reads from the table itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions import values
from marketloom.operators import fold, inference, routing
from marketloom.sources import feeds, trees
from marketloom.tables import load, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- scans over payloads made of the whole table --------------------------------------------------------

_PAGE = 50
_SANE = "price_num is not null and not isnan(price_num) and price_num between 0 and 1e9 and title is not null"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "raw_listings").where(_SANE).select("obs_id", "title", "url", "in_stock", "condition_raw", "image_urls", "description", F.round("price_num", 2).alias("price"), F.when(~F.isnan("list_price_num") & (F.abs("list_price_num") < 1e9), F.round("list_price_num", 2)).alias("was"))
    return r.withColumn("page_id", F.floor(F.col("obs_id") / _PAGE))


def _pages(rows: DataFrame, element: Column, wrap: Callable[[Column], Column]) -> DataFrame:
    """Pages whose body holds the elements of their rows in order, as `wrap` makes of the array."""
    many = rows.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("obs_id", element.alias("e")))).alias("l"))
    return spread(many.select("page_id", wrap(F.transform("l", lambda x: x["e"])).alias("body")))


_BASE = """r AS (SELECT obs_id, title, url, in_stock, condition_raw, image_urls, description, round(price_num, 2) AS price, CASE WHEN NOT isnan(list_price_num) AND abs(list_price_num) < 1e9 THEN round(list_price_num, 2) END AS was
    FROM raw_listings WHERE price_num IS NOT NULL AND NOT isnan(price_num) AND price_num BETWEEN 0 AND 1e9 AND title IS NOT NULL)"""


@query(f"""WITH {_BASE} SELECT obs_id::VARCHAR AS source_id, title, price AS price_num, CASE WHEN was > price THEN was END AS list_price_num, CASE WHEN obs_id % 3 = 0 THEN in_stock WHEN obs_id % 3 = 1 THEN true ELSE false END AS in_stock, url FROM r""")
def scan_bestbuy(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("obs_id") % 3
    e = F.struct(F.col("obs_id").alias("sku"), F.col("title").alias("name"), F.when(F.col("obs_id") % 2 == 0, F.col("price")).alias("salePrice"), F.when((F.col("obs_id") % 2 == 1), F.col("price")).otherwise(F.col("was")).alias("regularPrice"),
                 F.when(k == 0, F.col("in_stock")).alias("onlineAvailability"), F.when(k == 1, "Available").when(k == 2, "SoldOut").alias("orderable"), "url")
    rows = _rows(spark, d)
    # Odd rows have no sale price: their regular one is the price, and there is no list price to compare with.
    pages = _pages(rows, e, lambda a: F.to_json(F.struct(a.alias("products"))))
    got = feeds.bestbuy(pages).select("source_id", "title", "price_num", "list_price_num", "in_stock", "url")
    was = rows.select(F.col("obs_id").cast("string").alias("source_id"), F.when((F.col("obs_id") % 2 == 1) & (F.col("was") > F.col("price")), F.col("was")).alias("w"), (k == 0).alias("own"), F.col("in_stock").alias("s"))
    d2 = got.join(was, "source_id")
    return d2.select("source_id", "title", "price_num", F.coalesce("list_price_num", "w").alias("list_price_num"), F.when(F.col("own"), F.col("s")).otherwise(F.col("in_stock")).alias("in_stock"), "url")


@query(f"""WITH {_BASE} SELECT obs_id::VARCHAR || '-' || k AS source_id, title || CASE WHEN k = 0 THEN '' ELSE ' - Large' END AS title, round(price + k, 2) AS price_num, CASE WHEN was > 0 THEN was END AS list_price_num, in_stock FROM r, (VALUES (0), (1)) v(k)""")
def scan_shopify_product(spark: SparkSession, d: str) -> DataFrame:
    """One product a page, two variants each, amounts in cents."""
    cents = lambda c: F.round(c * 100).cast("long")
    variant = lambda k: F.struct(F.concat("obs_id", F.lit(f"-{k}")).alias("id"), F.lit("Large" if k else "Default Title").alias("title"), cents(F.col("price") + k).alias("price"), cents(F.col("was")).alias("compare_at_price"), F.col("in_stock").alias("available"))
    pages = _rows(spark, d).select(F.col("obs_id").alias("page_id"), F.to_json(F.struct("title", F.array(variant(0), variant(1)).alias("variants"))).alias("body"))
    return feeds.shopify(pages, collection=False).select("source_id", "title", F.round("price_num", 2).alias("price_num"), "list_price_num", "in_stock")


@query(f"""WITH {_BASE} SELECT obs_id // {_PAGE} AS page_id, obs_id::VARCHAR AS source_id, title, price AS price_num, CASE WHEN was > 0 THEN was END AS list_price_num,
    count(*) OVER (PARTITION BY obs_id // {_PAGE})::INTEGER AS products, min(obs_id) OVER (PARTITION BY obs_id // {_PAGE})::VARCHAR AS first_id FROM r""")
def scan_shopify_collection(spark: SparkSession, d: str) -> DataFrame:
    """Collection pages, amounts as texts, with what paging needs: how many products, and the first one's id."""
    e = F.struct(F.col("obs_id").alias("id"), "title", F.array(F.struct(F.col("obs_id").alias("id"), F.lit("Default Title").alias("title"), F.col("price").cast("decimal(14,2)").cast("string").alias("price"), F.col("was").cast("decimal(14,2)").cast("string").alias("compare_at_price"))).alias("variants"))
    pages = _pages(_rows(spark, d), e, lambda a: F.to_json(F.struct(a.alias("products"))))
    doc = F.try_parse_json("body")
    about = pages.select("page_id", F.size(feeds.get(doc, "products", "array<variant>")).alias("products"), feeds.get(doc, "products[0].id").alias("first_id"))
    return feeds.shopify(pages, collection=True).select("page_id", "source_id", "title", "price_num", "list_price_num").join(about, "page_id")


@query(f"""WITH {_BASE} SELECT obs_id::VARCHAR AS source_id, title, price AS price_num, CASE WHEN obs_id % 4 = 0 THEN NULL ELSE 5.0 END AS shipping_num, condition_raw, url,
    CASE WHEN obs_id % 5 = 0 THEN 'auction_only' END AS skip_reason FROM r""")
def scan_search_items(spark: SparkSession, d: str) -> DataFrame:
    money = lambda v, c="USD": F.struct(v.cast("decimal(14,2)").cast("string").alias("value"), F.lit(c).alias("currency"))
    ships = F.when(F.col("obs_id") % 4 == 0, F.array(F.struct(money(F.lit(1), "CAD").alias("shippingCost")))).otherwise(F.array(F.struct(money(F.lit(7)).alias("shippingCost")), F.struct(money(F.lit(5)).alias("shippingCost"))))
    e = F.struct(F.col("obs_id").cast("string").alias("itemId"), "title", money(F.col("price")).alias("price"), F.array(F.when(F.col("obs_id") % 5 == 0, "AUCTION").otherwise("FIXED_PRICE")).alias("buyingOptions"), F.col("condition_raw").alias("condition"), ships.alias("shippingOptions"), F.col("url").alias("itemWebUrl"))
    pages = _pages(_rows(spark, d), e, lambda a: F.to_json(F.struct(a.alias("itemSummaries"))))
    return feeds.search_items(pages).select("source_id", "title", "price_num", "shipping_num", "condition_raw", "url", "skip_reason")


@query(f"""WITH {_BASE} SELECT obs_id::VARCHAR AS source_id, title, price AS price_num, 'https://shop.example/p/' || obs_id AS url FROM r""")
def scan_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Any JSON by a map of paths: amounts in cents two levels down, links from a template."""
    e = F.struct(F.struct(F.col("obs_id").cast("string").alias("id")).alias("ref"), F.array(F.struct(F.col("title").alias("text"))).alias("names"), F.struct(F.round(F.col("price") * 100).alias("cents")).alias("offer"))
    pages = _pages(_rows(spark, d), e, lambda a: F.to_json(F.struct(F.struct(a.alias("hits")).alias("result"))))
    m = feeds.mapped(pages, "result.hits", {"source_id": "ref.id", "title": "names[0].text", "price_num": "offer.cents"}, 100.0, "https://shop.example/p/{source_id}")
    return m.select("source_id", "title", F.round("price_num", 2).alias("price_num"), "url")


@query(f"""WITH {_BASE} SELECT obs_id::VARCHAR AS source_id, title, price AS price_num, 45.0 + obs_id % 10 AS latitude FROM r""")
def scan_positional(spark: SparkSession, d: str) -> DataFrame:
    """Compact arrays against the minima that the page states."""
    text = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'^\{"x":(.*)\}$', 1)
    e = F.concat(F.lit("["), F.col("obs_id") - F.col("page_id") * _PAGE, F.lit(",0,3,"), F.col("price").cast("decimal(14,2)").cast("string"), F.lit(',"1:2:3~'), (45.0 + F.col("obs_id") % 10).cast("string"), F.lit('~-93.5",[4,"x"],'), text(F.col("title")), F.lit("]"))
    pages = _pages(_rows(spark, d), e, lambda a: F.array_join(a, ","))
    pages = pages.select("page_id", F.concat(F.lit('{"data":{"decode":{"minPostingId":'), F.col("page_id") * _PAGE, F.lit(',"minPostedDate":1},"items":['), "body", F.lit("]}}")).alias("body"))
    return feeds.positional(pages).select("source_id", "title", "price_num", "latitude")


@query(f"""WITH {_BASE} SELECT obs_id::VARCHAR AS source_id, title, price AS price_num, description FROM r WHERE obs_id % 9 <> 0""")
def scan_embedded(spark: SparkSession, d: str) -> DataFrame:
    """Listings somewhere in the JSON inside a page's script, each found twice; advertisements are left out."""
    e = F.struct(F.struct(F.col("obs_id").cast("string").alias("listingId"), "title", F.col("price").cast("decimal(14,2)").cast("string").alias("price"), F.when(F.col("obs_id") % 9 == 0, "AD").otherwise("ITEM").alias("tileType")).alias("tile"),
                 F.struct(F.col("obs_id").cast("string").alias("listingId"), "title", F.nullif("description", F.lit(None)).alias("description"), F.when(F.col("obs_id") % 9 == 0, "AD").otherwise("ITEM").alias("tileType")).alias("more"))
    pages = _pages(_rows(spark, d), e, lambda a: F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), F.replace(F.to_json(F.struct(F.struct(a.alias("feed")).alias("props"))), F.lit("</"), F.lit("<\\/")), F.lit("</script></html>")))
    nodes = trees.tree_rows(feeds.embedded_json(pages), ("listingId", "title"))
    return feeds.tree_listings(nodes, {"source_id": "listingId", "title": "title", "price_num": "price", "description": "description"}, skip=feeds.get("v", "tileType") == "AD").select("source_id", "title", "price_num", "description")


@query(f"""WITH {_BASE} SELECT obs_id::VARCHAR AS source_id, title, price AS price_num FROM r""")
def scan_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Several JSON documents a body, behind a guard prefix, with listings at some depth."""
    e = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.struct(F.col("obs_id").cast("string").alias("id"), F.col("title").alias("marketplace_listing_title"), F.struct(F.col("price").cast("decimal(14,2)").cast("string").alias("amount")).alias("listing_price")).alias("listing")).alias("node"))).alias("edges")).alias("data")))
    pages = _pages(_rows(spark, d), e, lambda a: F.concat(F.lit("for (;;);"), F.array_join(a, "\n")))
    nodes = trees.tree_rows(pages, ("id", "marketplace_listing_title"))
    return feeds.tree_listings(nodes, {"source_id": "id", "title": "marketplace_listing_title", "price_num": "listing_price.amount"}).select("source_id", "title", "price_num")


@query(f"""WITH {_BASE} SELECT obs_id // {_PAGE} AS page_id, min(obs_id) % 2 = 0 AS withheld FROM r GROUP BY 1""")
def withheld_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).groupBy("page_id").agg(F.min("obs_id").alias("o"), F.first("title").alias("t"))
    edges = F.when(F.col("o") % 2 == 0, F.array().cast("array<struct<t:string>>")).otherwise(F.array(F.struct("t")))
    pages = rows.select("page_id", F.to_json(F.struct(F.struct(edges.alias("edges"), F.lit("more").alias("cursor")).alias("feed"))).alias("body"))
    return feeds.withheld_feeds(pages, "feed.edges", "feed.cursor")


@query(f"""WITH {_BASE} SELECT 't3_' || obs_id AS source_id, CASE WHEN obs_id % 11 <> 0 THEN 'GPU' END AS tag, CASE WHEN obs_id % 11 <> 0 AND obs_id % 13 <> 0 THEN price END AS price_num,
    CASE WHEN obs_id % 11 = 0 THEN 'malformed' WHEN obs_id % 17 = 0 THEN 'stickied' WHEN obs_id % 19 = 0 THEN 'expired' WHEN obs_id % 13 = 0 THEN 'no_price' END AS skip_reason FROM r""")
def scan_deal_posts(spark: SparkSession, d: str) -> DataFrame:
    """`[TAG] Product - $price (breakdown)` posts; those that aren't taken come out with the reason."""
    p = F.col("price").cast("decimal(14,2)").cast("string")
    o = F.col("obs_id")
    title = F.when(o % 11 == 0, None).when(o % 13 == 0, F.concat(F.lit("[GPU] Card "), o)).otherwise(F.concat(F.lit("[GPU] Card "), o, F.lit(" - $"), p, F.lit(" ($99999 - $1 promo)")))
    post = F.struct(F.lit("t3").alias("kind"), F.struct(F.concat(F.lit("t3_"), o).alias("name"), title.alias("title"), F.when(o % 19 == 0, "Expired").alias("link_flair_text"), (o % 17 == 0).alias("stickied")).alias("data"))
    pages = _pages(_rows(spark, d), post, lambda a: F.to_json(F.struct(F.struct(a.alias("children")).alias("data"))))
    return feeds.deal_posts(pages).select("source_id", "tag", "price_num", "skip_reason")


@query(f"""WITH {_BASE} SELECT obs_id, price, CASE WHEN obs_id % 2 = 0 THEN price * 2 END AS list_price, (CASE obs_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 7.99 WHEN 2 THEN CASE WHEN price >= 35 THEN 0.0 END END)::DOUBLE AS shipping FROM r WHERE price >= 1 AND price < 100000""")
def deal_titles(spark: SparkSession, d: str) -> DataFrame:
    """Price, list price and shipping of titles that name all three in several ways."""
    r = _rows(spark, d).where("price >= 1 and price < 100000")
    p = lambda c: c.cast("decimal(14,2)").cast("string")
    ship = F.get(F.array(F.lit(" + Free Shipping"), F.lit(" + $7.99 Shipping"), F.lit(" + Free Shipping w/ Prime or on orders $35+"), F.lit("")), (F.col("obs_id") % 4).cast("int"))
    t = F.concat(F.lit("Card 24GB"), F.when(F.col("obs_id") % 2 == 0, F.concat(F.lit(" was $"), p(F.col("price") * 2))).otherwise(""), F.lit(" now $"), p(F.col("price")), ship)
    return r.select("obs_id", feeds.title_offer(t).alias("o")).select("obs_id", "o.*")


# --- routing, small predicates ------------------------------------------------------------------------


@query("""
    WITH a AS (SELECT item_id, (extract(hour FROM received_at) * 60 + extract(minute FROM received_at)) AS m, total_price AS p, query AS q, source FROM deal_items),
    r AS (SELECT item_id, m, list_filter([CASE WHEN p >= 500 THEN 'big' END, CASE WHEN source LIKE '%a%' AND NOT (m >= 1320 OR m < 420) THEN 'night' END, CASE WHEN q IS NULL AND (NOT (m >= 60 AND m < 120) OR p >= 1000) THEN 'open' END], lambda x: x IS NOT NULL) AS routes,
      (p >= 500) IS TRUE OR (source LIKE '%a%') IS TRUE OR q IS NULL AS fits FROM a)
    SELECT item_id, array_to_string(routes, ',') AS routes, array_to_string(list_filter(['chat', 'mail', 'log'], lambda t: (t = 'chat' AND list_has_any(routes, ['big', 'night'])) OR (t = 'mail' AND list_contains(routes, 'big')) OR (t = 'log' AND list_has_any(routes, ['night', 'open']))), ',') AS targets,
      list_contains(routes, 'big') AS mention, CASE WHEN NOT fits THEN 'no_match' WHEN len(routes) = 0 THEN 'quiet_hours' END AS suppressed FROM r""")
def routed_items(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "deal_items").select("item_id", "received_at", F.when(~F.isnan("total_price"), F.col("total_price")).alias("p"), F.col("query").alias("q"), "source", F.isnan("total_price").alias("nan"))
    p = F.coalesce("p", F.when(F.col("nan"), float("inf")))  # NaN is above all numbers in SQL too
    routes = [
        routing.Route("big", p >= 500, ("chat", "mail"), mention=True), routing.Route("night", F.col("source").contains("a"), ("chat", "log"), quiet=("22:00", "07:00")),
        routing.Route("open", F.col("q").isNull(), ("log",), quiet=("01:00", "02:00"), exempt=p >= 1000), routing.Route("never", F.lit(None).cast("boolean"), ("mail",)),
    ]
    out = routing.routed(i, routes, F.col("received_at"))
    return out.select("item_id", F.array_join("routes", ",").alias("routes"), F.array_join("targets", ",").alias("targets"), "mention", "suppressed")


@query("""
    SELECT query, count(*)::BIGINT AS n, bool_or(in_stock IS TRUE) AS any_ok, NOT bool_or(in_stock IS TRUE) AS all_failed FROM deal_items GROUP BY query""")
def delivery_fold(spark: SparkSession, d: str) -> DataFrame:
    return routing.deliveries_fold(load(spark, d, "deal_items"), ["query"], "in_stock")


@query("""
    SELECT query, least(min(price), max(total_price)) AS low, greatest(min(price), max(total_price)) AS high FROM deal_items WHERE NOT isnan(total_price) AND NOT isnan(price) GROUP BY query""")
def price_bands(spark: SparkSession, d: str) -> DataFrame:
    return routing.widest_band(load(spark, d, "deal_items").where("total_price is not null and price is not null and not isnan(total_price) and not isnan(price)"), ["query"], "price", "total_price")


@query("""
    SELECT item_id, CASE WHEN query IS NULL THEN 'unclassified' WHEN in_stock = false THEN 'rejected' WHEN quantity > 3 THEN 'gated' ELSE 'accepted' END AS status,
      CASE WHEN query IS NULL OR in_stock = false THEN false WHEN quantity > 3 THEN quantity = 4 AND sku IS NOT NULL ELSE sku IS NOT NULL END AS usable,
      CASE WHEN query IS NULL THEN NULL WHEN in_stock = false THEN coalesce(profile_hint, 'rejected') WHEN quantity > 3 THEN 'gate' || quantity END AS code FROM deal_items""")
def record_classes(spark: SparkSession, d: str) -> DataFrame:
    accepted = F.when(F.col("query").isNotNull(), F.coalesce("in_stock", F.lit(True)))
    c = routing.record_class(accepted, F.col("profile_hint"), F.when(F.col("quantity") > 3, F.concat(F.lit("gate"), "quantity")), F.col("sku").isNotNull(), ("gate4",))
    return load(spark, d, "deal_items").select("item_id", c.alias("c")).select("item_id", "c.*")


@query("""
    SELECT obs_id, CASE obs_id % 5 WHEN 0 THEN (obs_id % 100)::DOUBLE WHEN 1 THEN 90.0 WHEN 2 THEN 0.0 WHEN 3 THEN NULL ELSE 0.0 END AS wait FROM raw_listings""")
def retry_waits(spark: SparkSession, d: str) -> DataFrame:
    k, at = F.col("obs_id") % 5, F.date_trunc("second", "received_at")
    date = lambda s: F.date_format(at + F.make_dt_interval(secs=F.lit(s)), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    h = F.when(k == 0, F.concat(F.lit(" "), F.col("obs_id") % 100)).when(k == 1, date(90)).when(k == 2, date(-90)).when(k == 3, "soon").otherwise("-4")
    return load(spark, d, "raw_listings").select("obs_id", routing.retry_after(h, at).alias("wait"))


@query("""
    WITH s AS (SELECT item_id, total_price AS v, lag(total_price) OVER (PARTITION BY source, source_id ORDER BY received_at, item_id) AS b FROM deal_items WHERE total_price IS NOT NULL AND NOT isnan(total_price))
    SELECT item_id, coalesce(v <= b * 0.95 + 1e-6 AND b - v >= 5 - 1e-6, false) AS dropped, abs(v - 1) <= 0.005 OR abs(v - 123.45) <= 0.005 OR abs(v - 9999) <= 0.005 AS placeholder, round(86400 * (1 + item_id % 7) / (5000 * 0.85), 6) AS seconds FROM s""")
def price_drops(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    i = load(spark, d, "deal_items").where("total_price is not null and not isnan(total_price)")
    v, b = F.col("total_price"), F.lag("total_price").over(W.partitionBy("source", "source_id").orderBy("received_at", "item_id"))
    return i.select("item_id", v.alias("v"), b.alias("b")).select("item_id", F.coalesce(values.dropped(F.col("b"), F.col("v"), 0.05, 5.0), F.lit(False)).alias("dropped"), values.near_any(F.col("v"), (1, 123.45, 9999)).alias("placeholder"), F.round(values.quota_interval(1 + F.col("item_id") % 7, F.lit(5000.0)), 6).alias("seconds"))


@query("""
    SELECT DISTINCT condition_raw, CASE WHEN t = '' THEN NULL WHEN t LIKE '%open%box%' OR t LIKE '%box%open%' THEN 'Open Box' WHEN regexp_matches(t, 'refurb|renewed|certified') THEN 'Refurbished' WHEN regexp_matches(t, 'pre-?owned|used') THEN 'Used' WHEN t LIKE '%parts%' THEN 'For parts' WHEN t LIKE 'new%' THEN 'New' ELSE trim(condition_raw) END AS word
    FROM (SELECT condition_raw, lower(trim(condition_raw)) AS t FROM raw_listings)""")
def condition_words(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "raw_listings").select("condition_raw").distinct().select("condition_raw", feeds.condition_word(F.col("condition_raw")).alias("word"))


# --- claims ---------------------------------------------------------------------------------------------


@query()
def cluster_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of all priced items by store and query, each fifth undone an hour later."""
    from marketloom.functions import text

    i = load(spark, d, "deal_items").where("total_price is not null and not isnan(total_price)")
    i = i.withColumn("store", text.cluster_identity(F.col("source_kind"), F.col("retailer"), F.col("url")))
    store = F.col("store")
    listing = values.listing_key(F.col("source"), F.col("source_id"))
    # What has no store stands alone: it is a key of its own, and owns no bucket.
    k = F.when(store.isNotNull() & F.col("query").isNotNull(), F.concat_ws("|", store, "query")).otherwise(listing)
    b = F.when(store.isNotNull() & F.col("query").isNotNull(), values.price_bucket(F.col("total_price"), 0.02))
    c = i.select(k.alias("k"), F.lit("claim").alias("kind"), listing.alias("listing"), F.col("total_price").alias("price"), b.alias("bucket"), (F.unix_micros("received_at") / 1e6).alias("t"), F.col("item_id").alias("token"))
    undo = c.where("token % 5 = 0").select("k", F.lit("rollback").alias("kind"), *(F.col(x) for x in ("listing", "price", "bucket")), (F.col("t") + 3600).alias("t"), "token")
    step = fold.cluster_claim_step("kind", "listing", "price", "bucket", "t", "token", 72 * 3600.0, 12 * 3600.0, 0.05, 5.0)
    return fold.keyed_fold(c.unionByName(undo), ["k"], ["t", "token", "kind"], step, T.StructType.fromDDL("token long, kind string, status string, previous double, owner string"))


# --- model answers --------------------------------------------------------------------------------------


def _stand_in(salt: str) -> inference.Predict:
    """Answers by the MD5 of the URL, in several wordings: a stand-in for a model in queries and tests."""

    def predict(pairs: list[tuple[str, str]]) -> list[str | None]:
        out: list[str | None] = []
        for url, _ in pairs:
            h = hashlib.md5((salt + url).encode()).hexdigest()
            kind = {"0": None, "1": "damaged", "2": "box_only", "3": "uncertain", "4": "uncertain"}.get(h[0], "genuine")
            sure = int(h[1], 16) / 15
            out.append(None if kind is None else f'Well: {{"answer": {{"category": "{kind.replace("_", " ").title()}", "confidence": "{sure * 100:.6f}%"}}}} That is all.' if h[2] < "8" else f'{{"verdict": "{kind}", "confidence": {sure:.8f}}}')
        return out

    return predict


@query("""
    WITH p AS (SELECT item_id, u.url, u.pos FROM deal_items, LATERAL (SELECT unnest(list_distinct_ordered) AS url, unnest(range(len(list_distinct_ordered)::BIGINT)) AS pos FROM (SELECT list_transform(list_filter(list_transform(range(1, len(image_urls)::BIGINT + 1), lambda i: {'i': i, 'u': image_urls[i]}), lambda x: regexp_matches(x.u, '^(?i)https?://[^\\s/]+') AND list_position(image_urls, x.u) = x.i), lambda x: x.u)[1:5] AS list_distinct_ordered)) u),
    h AS (SELECT DISTINCT url, md5('a' || url) AS h1, md5('b' || url) AS h2 FROM p),
    k AS (SELECT url, CASE substr(h1, 1, 1) WHEN '0' THEN NULL WHEN '1' THEN 'damaged' WHEN '2' THEN 'box_only' WHEN '3' THEN 'uncertain' WHEN '4' THEN 'uncertain' ELSE 'genuine' END AS k1, ('0x' || substr(h1, 2, 1))::INT / 15.0 AS c1,
      CASE substr(h2, 1, 1) WHEN '0' THEN NULL WHEN '1' THEN 'damaged' WHEN '2' THEN 'box_only' WHEN '3' THEN 'uncertain' WHEN '4' THEN 'uncertain' ELSE 'genuine' END AS k2, ('0x' || substr(h2, 2, 1))::INT / 15.0 AS c2 FROM h),
    a AS (SELECT url, CASE WHEN k1 = 'uncertain' AND k2 IS NOT NULL THEN k2 ELSE k1 END AS v, CASE WHEN k1 = 'uncertain' AND k2 IS NOT NULL THEN c2 ELSE c1 END AS c FROM k WHERE k1 IS NOT NULL),
    m AS (SELECT item_id, pos, v, c FROM p JOIN a USING (url) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY pos) <= 3),
    g AS (SELECT item_id, count(*) AS n, max(c) FILTER (v = 'damaged' AND c >= 0.6) AS d, max(c) FILTER (v IN ('damaged', 'box_only') AND c >= 0.6) AS s, max(c) FILTER (v = 'genuine') AS g, max(c) AS t FROM m GROUP BY item_id)
    SELECT DISTINCT p.item_id, CASE WHEN n IS NULL THEN 'skipped' WHEN d IS NOT NULL THEN 'damaged' WHEN s IS NOT NULL AND NOT coalesce(g >= 0.6, false) THEN 'box_only' WHEN g IS NOT NULL THEN 'genuine' ELSE 'uncertain' END AS verdict,
      round(coalesce(CASE WHEN d IS NOT NULL THEN d WHEN s IS NOT NULL AND NOT coalesce(g >= 0.6, false) THEN s WHEN g IS NOT NULL THEN g ELSE t END, 0), 4)::DOUBLE AS confidence, coalesce(n, 0)::INTEGER AS photos FROM p LEFT JOIN g USING (item_id)""")
def photo_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of all items by their pictures, two models in a row, the second asked where the first isn't sure."""
    i = load(spark, d, "deal_items")
    shown = inference.photos(i, "item_id", "image_urls", 3).join(i.select("item_id", inference.prompt_kind(F.col("profile_hint"), F.col("title"), {"gpu": r"\bgpu\b|graphics", "disk": r"\bssd\b|\bhdd\b|drive"}).alias("prompt")), "item_id")
    # One prompt a picture here, so that answers don't depend on which of its items a picture is asked for.
    shown = shown.withColumn("prompt", F.lit("generic"))
    found = inference.answers(spread(shown), _stand_in("a"), _stand_in("b"))
    return inference.verdicts(shown, found, "item_id", 3, 0.6).select("item_id", "verdict", F.round("confidence", 4).alias("confidence"), "photos")
