"""Scans: payloads of shops, forums, marketplaces and feeds to rows of one listing schema.

Every scan takes a DataFrame with a text column `body` (and a key) and gives rows with the columns of
`LISTING`; a body that isn't valid for the scan gives none. Shapes are navigated as VARIANT, so missing, null
or differently shaped fields are nulls, never errors. Skips are rows of `skipped` with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import money
from marketloom.functions.values import compile_path

LISTING = ("source_id", "title", "price_num", "list_price_num", "shipping_num", "currency", "condition_raw", "in_stock", "url", "image_urls", "description", "posted_epoch")
_TYPES = {"price_num": "double", "list_price_num": "double", "shipping_num": "double", "in_stock": "boolean", "image_urls": "array<string>", "posted_epoch": "double"}


def get(v: Column | str, path: str, kind: str = "string") -> Column:
    """A field of a variant at a dotted path, null if missing or not of the kind."""
    steps = "".join(f"['{s}']" if isinstance(s, str) else f"[{s}]" for s in compile_path(path))
    return F.try_variant_get(v if isinstance(v, Column) else F.col(v), f"${steps}", kind)


def number(v: Column | str, path: str) -> Column:
    """A number, or a text that is one."""
    return F.coalesce(get(v, path, "double"), F.regexp_replace(get(v, path), r"[$,\s]", "").try_cast("double"))


def rows_of(pages: DataFrame, items: str, keep: tuple[str, ...] = ("page_id",), body: str = "body") -> DataFrame:
    """The elements of the array at `items` of every body that is valid JSON, with their positions, as `v`."""
    doc = F.try_parse_json(F.col(body))
    steps = f"{items}" if items else "$"
    many = F.try_variant_get(doc, steps, "array<variant>")
    return pages.select(*keep, F.posexplode(many).alias("pos", "v"))


def listing(df: DataFrame, keep: tuple[str, ...] = ("page_id", "pos"), **columns: Column) -> DataFrame:
    """Project to the listing schema; what isn't given is null."""
    return df.select(*keep, *(columns.get(c, F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in LISTING))


def redsky(pages: DataFrame) -> DataFrame:
    """Product summaries and single products; the price is the current one, else the least, else the formatted."""
    v = F.col("v")
    many = rows_of(pages, "$.data.product_summaries")
    one = pages.select("page_id", F.lit(0).alias("pos"), F.try_variant_get(F.try_parse_json("body"), "$.data.product", "variant").alias("v")).where("v is not null")
    d = many.unionByName(one).where(F.try_variant_get(v, "$.tcin", "string").isNotNull())
    stock = F.coalesce(get(v, "fulfillment.shipping_options.availability_status") == "IN_STOCK", F.lit(False)) | F.exists(F.coalesce(get(v, "fulfillment.store_options", "array<variant>"), F.array().cast("array<variant>")), lambda s: F.coalesce(F.try_variant_get(s, "$.order_pickup.availability_status", "string") == "IN_STOCK", F.lit(False)))
    known = get(v, "fulfillment", "variant").isNotNull()
    price = F.coalesce(number(v, "price.current_retail"), number(v, "price.current_retail_min"), number(v, "price.formatted_current_price"))
    return listing(d, source_id=get(v, "tcin"), title=get(v, "item.product_description.title"), description=get(v, "item.product_description.downstream_description"), price_num=price, list_price_num=F.when(number(v, "price.reg_retail") > price, number(v, "price.reg_retail")), currency=F.lit("USD"), in_stock=F.when(known, stock), url=get(v, "item.enrichment.buy_url"))


def newegg(pages: DataFrame) -> DataFrame:
    """One item per page; the list price only if above the price; flags give the condition; a deactivated item is
    out of stock."""
    v = F.try_parse_json("body")
    d = pages.select("page_id", F.lit(0).alias("pos"), v.alias("v")).where(get("v", "MainItem.Item").isNotNull())
    price = F.coalesce(F.when(number("v", "MainItem.FinalPrice") > 0, number("v", "MainItem.FinalPrice")), number("v", "MainItem.UnitCost"))
    was = number("v", "MainItem.OriginalUnitPrice")
    flag = lambda n: F.coalesce(get("v", f"MainItem.Feature.{n}", "boolean"), F.lit(False))
    condition = F.when(flag("IsOpenBoxed"), "open box").when(flag("IsRefurbished"), "refurbished").when(flag("IsNew"), "new")
    stock = F.coalesce(get("v", "MainItem.Instock", "boolean"), F.lit(False)) & ~F.coalesce(get("v", "IsForceDeactiveItem", "boolean"), F.lit(False))
    return listing(d, source_id=get("v", "MainItem.Item"), title=get("v", "MainItem.Description.Title"), price_num=price, list_price_num=F.when(was > price, was), shipping_num=number("v", "MainItem.ShippingCharge"), currency=F.lit("USD"), condition_raw=condition, in_stock=stock)


_SWAP = r"(?i)^\s*\[([^\]]*)\]\s*\[H\]\s*(.*?)\s*\[W\]\s*(.*)$"


def forum(pages: DataFrame, malformed: bool = False) -> DataFrame:
    """Posts of a forum's newest page, with the parts of `[place] [H] have [W] want` titles. `malformed`: also what isn't a post
    with a name, source_id null."""
    v = F.col("v")
    d = rows_of(pages, "$.data.children")
    good = F.coalesce((get(v, "kind") == "t3") & get(v, "data.name").isNotNull(), F.lit(False))
    d = d.withColumn("v", F.when(good, v)) if malformed else d.where(good)
    title = get(v, "data.title")
    d = d.withColumn("title", title)
    return d.select(
        "page_id", "pos", get(v, "data.name").alias("source_id"), "title", get(v, "data.selftext").alias("description"), get(v, "data.author").alias("author"), get(v, "data.link_flair_text").alias("flair"), get(v, "data.created_utc", "double").alias("posted_epoch"),
        *(F.nullif(F.regexp_extract("title", _SWAP, k), F.lit("")).alias(n) for k, n in ((1, "place"), (2, "have"), (3, "want"))),
        get(v, "data.removed_by_category").alias("removed_by"), F.coalesce(get(v, "data.stickied", "boolean"), F.lit(False)).alias("stickied"),
    )


#: Payments in money; who wants one of these sells.
MONEY = ("paypal", "venmo", "zelle", "cash", "cashapp", "local cash")


def swap_intent(posts: DataFrame) -> DataFrame:
    """`selling`, `buying`, `trading` or null by which side names money."""
    money = lambda c: F.lower(c).rlike(r"\b(?:" + "|".join(MONEY) + r")\b")
    h, w = money(F.col("have")), money(F.col("want"))
    return posts.withColumn("intent", F.when(F.col("have").isNull(), None).when(w & ~h, "selling").when(h & ~w, "buying").when(~h & ~w, "trading"))


def skip_reason() -> Column:
    """Why a forum post isn't taken, in order of evaluation; null if it is."""
    return F.when(F.col("source_id").isNull(), "malformed").when(F.col("stickied"), "stickied").when(F.col("removed_by").isNotNull(), "removed").when(F.col("have").isNull(), "no_swap_title").when(F.col("intent").isNull() | (F.col("intent") != "selling"), "not_selling")


def bestbuy(pages: DataFrame) -> DataFrame:
    v = F.col("v")
    d = rows_of(pages, "$.products").where(get(v, "sku").isNotNull())
    online, orderable = get(v, "onlineAvailability", "boolean"), F.lower(get(v, "orderable"))
    price = F.coalesce(number(v, "salePrice"), number(v, "regularPrice"))
    stock = F.coalesce(online, F.when(orderable.isin("available", "preorder"), True).when(orderable.isin("soldout", "notorderable"), False))
    return listing(d, source_id=get(v, "sku"), title=get(v, "name"), price_num=price, list_price_num=F.when(number(v, "regularPrice") > price, number(v, "regularPrice")), currency=F.lit("USD"), condition_raw=get(v, "condition"), in_stock=stock, url=get(v, "url"), image_urls=F.when(get(v, "image").isNotNull(), F.array(get(v, "image"))))


def shopify(pages: DataFrame, collection: bool) -> DataFrame:
    """A row per variant: of one product with amounts in cents, or of a collection with decimal texts."""
    scale = 1.0 if collection else 100.0
    doc = F.try_parse_json("body")
    products = rows_of(pages, "$.products").withColumnRenamed("v", "p") if collection else pages.select("page_id", F.lit(0).alias("pos"), doc.alias("p"))
    d = products.select("page_id", F.col("pos").alias("product_pos"), "p", F.posexplode(get("p", "variants", "array<variant>")).alias("pos", "v"))
    v = F.col("v")
    name = get(v, "title")
    title = F.concat_ws(" - ", get("p", "title"), F.when(name != "Default Title", name))
    was = number(v, "compare_at_price") / scale
    return listing(d, keep=("page_id", "product_pos", "pos"), source_id=get(v, "id"), title=title, price_num=number(v, "price") / scale, list_price_num=F.when(was > 0, was), in_stock=get(v, "available", "boolean"), url=get("p", "url"))


def search_items(pages: DataFrame) -> DataFrame:
    """A marketplace's item summaries with a skip reason; the cheapest shipping in the item's currency."""
    v = F.col("v")
    d = rows_of(pages, "$.itemSummaries")
    price, currency = number(v, "price.value"), get(v, "price.currency")
    options = F.coalesce(get(v, "buyingOptions", "array<string>"), F.array().cast("array<string>"))
    ships = F.transform(F.filter(F.coalesce(get(v, "shippingOptions", "array<variant>"), F.array().cast("array<variant>")), lambda s: F.coalesce(F.try_variant_get(s, "$.shippingCost.currency", "string"), currency) == currency), lambda s: F.try_variant_get(s, "$.shippingCost.value", "string").try_cast("double"))
    reason = F.when(get(v, "itemId").isNull(), "malformed").when(F.array_contains(options, "AUCTION") & (F.size(options) == 1), "auction_only").when(price.isNull() & number(v, "currentBidPrice.value").isNotNull(), "auction_bid_price").when(price.isNull(), "no_price").when(get(v, "itemWebUrl").isNull(), "no_url")
    images = F.filter(F.array(get(v, "image.imageUrl")), lambda x: x.isNotNull())
    posted = F.greatest(*(F.to_unix_timestamp(F.try_to_timestamp(get(v, c))).cast("double") for c in ("itemCreationDate", "itemOriginDate")))
    was = number(v, "marketingPrice.originalPrice.value")
    return listing(d.withColumn("skip_reason", reason), keep=("page_id", "pos", "skip_reason"), source_id=get(v, "itemId"), title=get(v, "title"), price_num=price, list_price_num=was, shipping_num=F.array_min(ships), currency=currency, condition_raw=F.coalesce(get(v, "conditionId"), get(v, "condition")), url=get(v, "itemWebUrl"), image_urls=images, description=get(v, "shortDescription"), posted_epoch=posted)


def positional(pages: DataFrame) -> DataFrame:
    """Compact rows `[id offset, date offset, category, price, "a:b:c~lat~lon", [tag, ...]..., title]` against the
    payload's `data.decode` minima."""
    doc = F.try_parse_json("body")
    d = pages.select("page_id", get(doc, "data.decode.minPostingId", "long").alias("id0"), get(doc, "data.decode.minPostedDate", "long").alias("at0"), F.posexplode(get(doc, "data.items", "array<variant>")).alias("pos", "v"))
    parts = F.try_variant_get("v", "$", "array<variant>")
    geo = F.split(F.try_variant_get("v", "$[4]", "string"), "~")
    title = F.try_variant_get(F.try_element_at(parts, F.lit(-1)), "$", "string")
    d = d.select("page_id", "pos", "v", (F.col("id0") + F.try_variant_get("v", "$[0]", "long")).cast("string").alias("sid"), (F.col("at0") + F.try_variant_get("v", "$[1]", "long")).cast("double").alias("at"), F.try_variant_get("v", "$[3]", "double").alias("price"), title.alias("t"), F.get(geo, 1).try_cast("double").alias("latitude"), F.get(geo, 2).try_cast("double").alias("longitude"))
    return listing(d.where("sid is not null"), keep=("page_id", "pos", "latitude", "longitude"), source_id=F.col("sid"), title=F.col("t"), price_num=F.when(F.col("price") >= 0, F.col("price")), posted_epoch=F.col("at"))


def mapped(pages: DataFrame, items: str, fields: dict[str, str], divisor: float = 1.0, url_template: str | None = None) -> DataFrame:
    """Any JSON by dotted paths: `items` leads to the array, `fields` name listing columns; amounts are divided."""
    path = "$" + "".join(f"['{s}']" if isinstance(s, str) else f"[{s}]" for s in compile_path(items)) if items else "$"
    d = rows_of(pages, path)
    cols = {c: number("v", p) / divisor if _TYPES.get(c) == "double" else get("v", p, _TYPES.get(c, "string")) for c, p in fields.items()}
    if url_template and "url" not in cols:
        cols["url"] = F.replace(F.lit(url_template), F.lit("{source_id}"), cols["source_id"])
    return listing(d, **cols).where("source_id is not null and title is not null")


def embedded_json(pages: DataFrame, script_id: str = "__NEXT_DATA__") -> DataFrame:
    """The JSON of a script element of an HTML body, as `body`."""
    return pages.withColumn("body", F.nullif(F.regexp_extract("body", rf'(?s)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>', 1), F.lit(""))).where("body is not null")


def rss(spark: SparkSession, path: str) -> DataFrame:
    """Entries of RSS files: rows of the listing schema, identified by guid, else link."""
    d = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "true").schema("title string, link string, description string, encoded string, pubDate string, category string, creator string, guid string").load(path)
    price = F.regexp_extract("title", r"(?:US)?\$\s*([0-9][0-9,]*(?:\.[0-9]{2})?)", 1)
    sid = F.coalesce(F.nullif(F.regexp_extract("guid", r"thread-(\d+)", 1), F.lit("")), "guid", "link")
    images = F.regexp_extract_all("encoded", F.lit(r'<img[^>]*src="([^"]+)"'), F.lit(1))
    when = F.to_unix_timestamp(F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace(F.regexp_replace("pubDate", r"^[A-Za-z]{3}, ", ""), " GMT$", " +0000"), F.lit("dd MMM yyyy HH:mm:ss Z"))))
    return listing(d, keep=(), source_id=sid, title=F.col("title"), price_num=F.replace(price, F.lit(","), F.lit("")).try_cast("double"), url=F.col("link"), description=F.col("description"), image_urls=images, posted_epoch=when).where("source_id is not null and title is not null")


# What retailers call conditions, by what their word holds.
_WORDS_OF_CONDITION = ((r"open.*box|box.*open", "Open Box"), (r"refurb|renewed|certified", "Refurbished"), (r"pre-?owned|used", "Used"), (r"parts", "For parts"), (r"^new", "New"))


def condition_word(c: Column) -> Column:
    """A retailer's condition in the words that conditions are known by; others as they are, null for empty ones."""
    t = F.trim(c)
    out = F.nullif(t, F.lit(""))
    for pattern, word in reversed(_WORDS_OF_CONDITION):
        out = F.when(F.lower(t).rlike(pattern), word).otherwise(out)
    return out


_DEAL = r"^\s*((?:\[[^\]]*\]\s*)+)(.*)$"


def deal_posts(pages: DataFrame, skip_flairs: tuple[str, ...] = ("expired",)) -> DataFrame:
    """Posts `[TAG] Product - $price (breakdown)` of a forum's newest page, all of them, with a skip reason: malformed (no name),
    stickied, removed, expired (by flair), no_price."""
    v = F.col("v")
    d = rows_of(pages, "$.data.children")
    d = d.select("page_id", "pos", get(v, "kind").alias("kind"), get(v, "data.name").alias("source_id"), get(v, "data.title").alias("title"), get(v, "data.link_flair_text").alias("flair"), F.coalesce(get(v, "data.url_overridden_by_dest"), get(v, "data.url")).alias("url"),
                 F.coalesce(get(v, "data.stickied", "boolean"), F.lit(False)).alias("stickied"), get(v, "data.removed_by_category").alias("removed_by"), get(v, "data.created_utc", "double").alias("posted_epoch"))
    d = d.withColumns({"tags": F.regexp_extract_all(F.regexp_extract("title", _DEAL, 1), F.lit(r"\[([^\]]*)\]"), F.lit(1)), "price": money.text_price(F.col("title"))})
    reason = (
        F.when((F.coalesce(F.col("kind"), F.lit("")) != "t3") | F.col("source_id").isNull() | F.col("title").isNull(), "malformed").when(F.col("stickied"), "stickied").when(F.col("removed_by").isNotNull(), "removed")
        .when(F.lower("flair").isin(*skip_flairs), "expired").when(F.col("price.amount").isNull(), "no_price")
    )
    return d.select("page_id", "pos", "source_id", F.get("tags", 0).alias("tag"), "title", F.col("price.amount").alias("price_num"), F.col("price.currency").alias("currency"), "url", "posted_epoch", reason.alias("skip_reason"))


_AMOUNT = r"\$\s?([0-9][0-9,]*(?:\.[0-9]{1,2})?)"


def title_offer(title: Column, most_ratio: float = 5.0) -> Column:
    """(price, list_price, shipping) of a deal's title. The list price stands after `was`, `list`, `reg`, `MSRP` or `orig`, is above
    the price and at most `most_ratio` times it. Shipping is 0 where it is free at this price (`free shipping on $35+` from there on),
    an amount after `+` where it names one, else null."""
    amount = lambda pattern, k=1: F.replace(F.regexp_extract(title, pattern, k), F.lit(",")).try_cast("double")
    was = rf"(?i)\b(?:was|list(?: price)?|reg(?:ular)?\.?(?: price)?|msrp|orig(?:inally)?\.?)[\s:]*{_AMOUNT}"
    price = money.text_price(F.regexp_replace(title, was, ""))["amount"]
    free = title.rlike(r"(?i)\bfree\s+(?:standard\s+)?(?:shipping|delivery|s/h|s&h)|\bf/?s\b")
    least = amount(rf"(?i)\bfree\s+(?:standard\s+)?(?:shipping|delivery|s/h|s&h)[^$]{{0,24}}?(?:on|over|w/|orders?)[^$]{{0,16}}{_AMOUNT}\s*\+?")
    paid = amount(rf"(?i)\+\s*{_AMOUNT}\s*(?:shipping|delivery|s/h|s&h)")
    return F.struct(price.alias("price"), F.when((amount(was) > price) & (amount(was) <= price * most_ratio), amount(was)).alias("list_price"), F.when(free & (least.isNull() | (price >= least)), 0.0).otherwise(paid).alias("shipping"))


def tree_listings(nodes: DataFrame, fields: dict[str, str], skip: Column | None = None) -> DataFrame:
    """Rows of the listing schema from `trees.tree_rows`: `fields` name columns and paths; of nodes of one page that name the same
    item the first counts, filled up from the others; nodes for which `skip` holds (over `v`) aren't taken."""
    d = nodes.select("page_id", "pos", F.try_parse_json("node").alias("v"))
    if skip is not None:
        d = d.where(~F.coalesce(skip, F.lit(False)))
    cols = {c: number("v", p) if _TYPES.get(c) == "double" else get("v", p, _TYPES.get(c, "string")) for c, p in fields.items()}
    d = listing(d, **cols).where("source_id is not null and title is not null")
    return d.groupBy("page_id", "source_id").agg(F.min("pos").alias("pos"), *(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in LISTING if c != "source_id"))


def withheld_feeds(pages: DataFrame, edges: str, cursor: str) -> DataFrame:
    """(page_id, withheld): pages whose list is empty although a cursor says that there is more, the sign of a soft block."""
    doc = F.try_parse_json("body")
    many = get(doc, edges, "array<variant>")
    return pages.select("page_id", ((F.size(F.coalesce(many, F.array().cast("array<variant>"))) == 0) & (F.coalesce(get(doc, cursor), F.lit("")) != "")).alias("withheld"))


def search_rows(pages: DataFrame) -> DataFrame:
    """Rows of a static search page: each `li` of class `cl-static-search-result`, with its title, link, price and place."""
    item = F.explode(F.regexp_extract_all("body", F.lit(r'(?s)<li[^>]*class="cl-static-search-result"[^>]*>.*?</li>'), F.lit(0)))
    d = pages.select("page_id", item.alias("x"))
    part = lambda pattern: F.nullif(F.trim(F.regexp_extract("x", pattern, 1)), F.lit(""))
    d = d.select("page_id", part(r'href="([^"]+)"').alias("url"), part(r'(?s)<div class="title">(.*?)</div>').alias("title"), F.replace(part(r'(?s)<div class="price">\s*\$?([0-9,.]+)'), F.lit(",")).try_cast("double").alias("price_num"), part(r'(?s)<div class="location">(.*?)</div>').alias("place"))
    return d.withColumn("source_id", F.regexp_extract("url", r"([0-9]+)\.html", 1)).where("title is not null and source_id <> ''")
