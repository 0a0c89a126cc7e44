import pytest
from marketloom.functions import money, text
from marketloom.operators.normalise import normalise
from pyspark.sql import functions as F

FIELDS = {
    "1299": (1299.0, None), "1,299": (1299.0, None), "  1299.99  ": (1299.99, None), "$1,299.99": (1299.99, "USD"), "US $1,299.99": (1299.99, "USD"), "1.299,99 €": (1299.99, "EUR"), "€1.299": (1299.0, "EUR"), "1 299,99 €": (1299.99, "EUR"),
    "£849": (849.0, "GBP"), "1\u00a0299,99\u00a0€": (1299.99, "EUR"), "1\u202f299 CHF": (1299.0, "CHF"), "C$1,100": (1100.0, "CAD"), "CAD $1299": (1299.0, "CAD"), "AU$1500": (1500.0, "AUD"), "1'299.50 CHF": (1299.5, "CHF"), "$1.2k": (1200.0, "USD"), "$1,2k": (1200.0, "USD"), "2k": (2000.0, None), "$1,250k": (None, None),
    "$800-$900": (800.0, "USD"), "2 for $50": (50.0, "USD"), "Price: $1,299.99 + $20 shipping": (1299.99, "USD"), "$12,99": (12.99, "USD"), "$1.299": (None, None), "1.299": (None, None), "1.299 EUR": (1299.0, "EUR"), "R$1.299": (1299.0, "BRL"),
    "1.299.999": (1299999.0, None), "$0.999": (0.999, "USD"), "1299.999": (1299.999, None), "Free": (0.0, None), "FREE - pick up only": (0.0, None), "Price: Free": (0.0, None), "": (None, None), "Ask": (None, None), "Contact for price, free delivery": (None, None),
    "-5": (None, None), "99999999": (None, None), "$" + "9" * 300: (None, None), "1299 OBO": (1299.0, None),
}
TITLES = {
    "[GPU] Card - $549.99 ($599.99 - $50 promo code)": 549.99, "Card - $1199 ($1599 - $400)": 1199.0, "Card ($1599 - $400)": 1199.0, "Card ($1599 -$400 instant savings)": 1199.0, "[CPU] Chip ($449 - $50 = $399)": 399.0, "Card (–$100 rebate) $999": 999.0,
    "($800 – $900)": 800.0, "Card 24GB 240Hz 2023 20% off": None, "Screen 49in 240Hz 2024 model $1,099.99": 1099.99, "$296.99 (-$100 rebate)": 296.99, "(-$100 rebate)": None, "Card $50 off at shop": None, "Card, $50 off with code, now $549": 549.0,
    "Save $100 - Card $999": 999.0, "Get A $50 gift card with Card $999": 999.0, "Card ($1599 value) for $1200": 1200.0, "$549 + $20 shipping": 549.0, "for rent $2/hr": 2.0, "4090 USD 1599": 1599.0, "Card 1500 USD shipped": 1500.0, "1500$ shipped card": 1500.0,
    "Card $ shipped later $1500": 1500.0, "Card $$$ cheap $1,299.99!": 1299.99, "Card FE C$2000": 2000.0, "Card for $1.6k": 1600.0, "Free ($0 with bundle)": 0.0, "Price is usdc only": None, "Card $": None, "": None,
}


def test_fields(spark):
    df = spark.createDataFrame([(k,) for k in FIELDS], "x string").select("x", money.money(F.col("x")).alias("m"))
    for r in df.collect():
        assert (r.m.amount, r.m.currency) == FIELDS[r.x], r.x
    assert money.parse_money("-5").negative and money.parse_money("$5").bare_dollar and not money.parse_money("US $5").bare_dollar


def test_titles(spark):
    for r in spark.createDataFrame([(k,) for k in TITLES], "x string").select("x", money.text_price(F.col("x")).alias("m")).collect():
        assert r.m.amount == TITLES[r.x], r.x


CONDITIONS = {
    "Like New": "used", "LIKE_NEW": "used", "New (never used)": "new", "fairly priced": None, "New other (see details)": "open_box", "1600": "open_box", "1100": "new", "2600": "refurbished", "3500": "used", " 3000 ": "used", "7000": "for_parts", "9999": None,
    "300": None, "Certified - Refurbished": "refurbished", "PRE_OWNED_FAIR": "used", "Open-Box Fair": "open_box", "salvage": "for_parts", "": None, "N/A": None, "lightly used": "used", "brand new sealed": "new",
}
TEXTS = [
    (None, "retail", "Card", "new"), (None, "local", "Card", "used"), (None, "local", "Card brand new", "new"), (None, "marketplace", "Card, never used, sealed", "new"), (None, "retail", "Card like new", "used"), ("New", "retail", "Card like new", "used"),
    (None, "local", "new thermal pads", "used"), (None, "local", "not refurbished, brand new", "new"), (None, "retail", "Card open box", "open_box"), (None, "local", "brand new, open box", "open_box"), (None, "retail", "for parts", "for_parts"), ("Used", "retail", "brand new", "used"),
    (None, "local", "can be used with it", "used"), (None, "retail", "can be used with it", "new"), (None, "other", "Card", "unknown"), (None, "other", "renewed", "refurbished"), (None, "local", "re-sealed box", "used"), (None, "local", "new other", "used"),
]


def test_conditions(spark):
    for r in spark.createDataFrame([(k,) for k in CONDITIONS], "x string").select("x", text.condition_of(F.col("x")).alias("c")).collect():
        assert r.c == CONDITIONS[r.x], r.x
    df = spark.createDataFrame(TEXTS, "raw string, kind string, title string, want string")
    for r in df.select("*", text.parse_condition(F.col("raw"), F.col("kind"), F.col("title")).alias("c")).collect():
        assert r.c == r.want, r


URLS = {
    "HTTPS://User:pw@Shop.Example.:443/a?utm_source=x&b=2&GCLID=1#f": "https://shop.example/a?b=2", "https://www.amazon.com/Some-Card/dp/b0abcd1234/ref=sr_1?th=1&tag=x-20&qid=9": "https://www.amazon.com/dp/B0ABCD1234?th=1&tag=x-20",
    "https://www.ebay.com/itm/1?hash=item&var=5&_trksid=p": "https://www.ebay.com/itm/1?var=5", "//x.example/a b?c d": "https://x.example/a%20b?c%20d", "www.x.example": "https://www.x.example/", "http://[2001:DB8::1]:80/x": "http://[2001:db8::1]/x",
    "http://x.example:8080": "http://x.example:8080/", "ftp://x.example": None, "https://": None, "not a url": None, "https://x.example/?ref=1&gclsrc=aw&%75tm_x=1&k": "https://x.example/?k", None: None,
}


def test_urls(spark):
    for r in spark.createDataFrame([(k,) for k in URLS], "x string").select("x", text.canonical_url(F.col("x")).alias("u")).collect():
        assert r.u == URLS[r.x], r.x


STORES = {"B&H": "bhphotovideo", "B&H Photo": "bhphotovideo", "bhphotovideo.com": "bhphotovideo", "Amazon.com": "amazon", "Best Buy .com": "bestbuy", "https://www.shop.example.co.uk/x": "example", "Newegg-com": "newegg", "Volt Mart": "voltmart", " ": None, "": None, None: None, "amzn.to": "amazon"}


def test_stores(spark):
    for r in spark.createDataFrame([(k,) for k in STORES], "x string").select("x", text.store_name(F.col("x")).alias("s")).collect():
        assert r.s == STORES[r.x], r.x
    rows = [("retail", "B&H", None), ("local", "B&H", None), ("aggregator", None, "https://www.ebay.com/itm/1"), ("aggregator", " ", "https://deals.walmart.com/x"), ("retail", None, None)]
    df = spark.createDataFrame(rows, "k string, r string, u string").select(text.cluster_identity(F.col("k"), F.col("r"), F.col("u")).alias("c"))
    assert [r.c for r in df.collect()] == ["bhphotovideo", None, None, "walmart", None]


def test_normalise(spark):
    kind = "obs_id long, title string, description string, url string, outbound_url string, price_raw string, price_num double, currency string, shipping_raw string, shipping_num double, list_price_raw string, list_price_num double, condition_raw string, source_kind string, image_urls array<string>, error string"
    base = ("Card", None, "https://x.example/1", None, "$5", None, "USD", None, None, None, None, None, "retail", ["http://i/1", "x", "http://i/1"], "clash")
    row = lambda k, **c: (k, *[c.get(n.split()[0], v) for n, v in zip(kind.split(", ")[1:], base, strict=True)])
    rows = [
        row(1), row(2, title="<b> </b>", url="x"), row(3, url="x", price_raw="-5"), row(4, price_raw="-5", price_num=-1.0), row(5, price_raw=None), row(6, price_raw="£5"), row(7, price_raw="ask", title="Card $7.05"), row(8, price_raw=None, description="now $9\nbrand new"),
        row(9, price_num=float("nan"), price_raw=None), row(10, currency="cad"), row(11, price_raw="US $5", currency="CAD", shipping_raw="Free shipping", list_price_raw="0"), row(12, price_num=1.0, shipping_num=2.5, list_price_num=4.0, price_raw="9"), row(13, title=None),
    ]
    got = {r.obs_id: r for r in normalise(spark.createDataFrame(rows, kind), allowed=("USD",)).collect()}
    assert {k: r.error for k, r in got.items()} == {1: None, 2: "empty_title", 3: "bad_url", 4: "negative_price", 5: "no_price", 6: "unsupported_currency", 7: None, 8: None, 9: "no_price", 10: "unsupported_currency", 11: None, 12: None, 13: "empty_title"}
    assert (got[7].price_origin, got[8].price_origin, got[8].price, got[1].image_urls) == ("title", "description", 9.0, ["http://i/1"])
    assert (got[11].currency, got[11].shipping, got[11].list_price, got[12].total_price, got[12].list_price, got[1].item_condition) == ("USD", 0.0, None, 3.5, 4.0, "new")
    assert normalise(spark.createDataFrame([], kind)).count() == 0
