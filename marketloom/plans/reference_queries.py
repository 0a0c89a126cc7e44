"""Queries of the listing operators over whole tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions import money, render, specs, text, values
from marketloom.operators import asof, history, merge
from marketloom.operators.normalise import normalise
from marketloom.sources import feeds
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


def _seconds(c: str):
    return F.unix_micros(c) / 1e6


# --- identities, text, URLs ---------------------------------------------------------------------------


@query("""
    SELECT obs_id, concat_ws(':', source, source_id) AS listing_key, substr(sha1(concat_ws(':', source, source_id)), 1, 20) AS fingerprint,
      CASE WHEN description <> '' THEN title || chr(10) || description ELSE title END AS full_text,
      coalesce(nullif(outbound_url, ''), url) AS best_url, image_urls[1] AS primary_image, len(image_urls)::INTEGER AS n_images
    FROM raw_listings""")
def listing_identity(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "raw_listings")
    key = values.listing_key(F.col("source"), F.col("source_id"))
    return r.select(
        "obs_id", key.alias("listing_key"), values.fingerprint(key).alias("fingerprint"), F.when(F.col("description") != "", F.concat_ws("\n", "title", "description")).otherwise(F.col("title")).alias("full_text"),
        F.coalesce(F.nullif("outbound_url", F.lit("")), "url").alias("best_url"), F.get("image_urls", 0).alias("primary_image"), F.size("image_urls").alias("n_images"),
    )


@query("""
    SELECT item_id, trim(regexp_replace(replace(replace(replace(replace(title, '&amp;', '&'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g')) AS title_clean
    FROM deal_items""")
def clean_titles(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "deal_items").select("item_id", text.clean_text(F.col("title")).alias("title_clean"))


#: What trackers do to a feed's URL, by obs_id, and what must be left: host and path, then parameters.
_TRACKED = (
    ("HTTPS://user@", "?utm_source=feed&ref=1&fbclid=1&b=2&gclsrc=x#top", "?b=2"), ("https://", "?utm_source=feed&b=%20x&ref_=2&c", "?b=%20x&c"), ("https://", "?PF_RD_p=1&hsa_x=2&cmpid=3", ""), ("http://", "?%75tm_medium=1&q=a&hue=2#", "?q=a&hue=2"),
)


@query(f"""
    WITH u AS (SELECT obs_id, source_id, obs_id % 6 AS k, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM raw_listings)
    SELECT obs_id, CASE WHEN k = 4 THEN 'https://www.amazon.com/dp/' || upper(lpad(right(source_id, 10), 10, '0')) || '?th=1' WHEN k = 5 THEN 'https://www.ebay.com/itm/1?var=2'
        ELSE (CASE WHEN k = 3 THEN 'http://' ELSE 'https://' END) || lower(host) || (CASE WHEN path = '' THEN '/' ELSE path END) || (CASE k {" ".join(f"WHEN {i} THEN '{t[2]}'" for i, t in enumerate(_TRACKED))} END) END AS canonical,
      CASE WHEN k = 4 THEN 'amazon.com' WHEN k = 5 THEN 'ebay.com' ELSE regexp_replace(lower(host), '^www\\.', '') END AS host
    FROM u WHERE NOT (k = 4 AND NOT regexp_matches(source_id, '^[A-Za-z0-9]+$'))""")
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    """The feeds' URLs, decorated as trackers do; a sixth as product and listing pages of two shops with rules of their own."""
    r = load(spark, d, "raw_listings").withColumn("k", F.col("obs_id") % 6).where((F.col("k") != 4) | F.col("source_id").rlike("^[A-Za-z0-9]+$"))
    rest = F.regexp_extract("url", r"^https?://([^?#]*)", 1)
    u = F.when(F.col("k") == 4, F.concat(F.lit("https://www.amazon.com/x/gp/product/"), F.lpad(F.expr("right(source_id, 10)"), 10, "0"), F.lit("/ref=a?th=1&tag2=x&pf_rd_p=3"))).when(F.col("k") == 5, F.lit("https://www.ebay.com/itm/1?hash=item&var=2&_trksid=p1&_from=R40"))
    for i, (scheme, decoration, _) in enumerate(_TRACKED):
        u = u.when(F.col("k") == i, F.concat(F.lit(scheme), rest, F.lit(decoration)))
    parts = spread(r.select("obs_id", u.alias("u"))).select("obs_id", text.url_parts(F.col("u")).alias("p"))
    return parts.select("obs_id", text.canonical_of(F.col("p")).alias("canonical"), text.bare_host(F.col("p")).alias("host"))


#: Other spellings of stores, and the store each stands for.
_SPELLINGS = (("B&H", "bhphotovideo"), ("B&H Photo", "bhphotovideo"), ("Amazon.com", "amazon"), ("https://www.bestbuy.com/site", "bestbuy"), ("Best Buy .com", "bestbuy"), ("Dell Technologies", "dell"), ("shop.example.co.uk", "example"))


@query(f"""
    WITH r AS (SELECT CASE WHEN obs_id % 3 = 0 THEN list_value({", ".join(f"'{a}'" for a, _ in _SPELLINGS)})[(obs_id // 3 % {len(_SPELLINGS)}) + 1] ELSE retailer END AS retailer,
        CASE WHEN obs_id % 3 = 0 THEN list_value({", ".join(f"'{b}'" for _, b in _SPELLINGS)})[(obs_id // 3 % {len(_SPELLINGS)}) + 1] ELSE regexp_replace(lower(trim(retailer)), '[^a-z0-9]+', '', 'g') END AS store FROM raw_listings)
    SELECT store, count(*)::BIGINT AS n, count(DISTINCT retailer)::BIGINT AS spellings FROM r WHERE retailer IS NOT NULL AND store <> '' GROUP BY 1""")
def store_identity(spark: SparkSession, d: str) -> DataFrame:
    """Stores of the retailers' names; a third of the rows carry other spellings of known stores."""
    spelt = F.get(F.array(*(F.lit(a) for a, _ in _SPELLINGS)), (F.floor(F.col("obs_id") / 3) % len(_SPELLINGS)).cast("int"))
    r = load(spark, d, "raw_listings").select(F.when(F.col("obs_id") % 3 == 0, spelt).otherwise(F.col("retailer")).alias("retailer")).where("retailer is not null")
    # Spellings are few: counting them first leaves little to count distinct.
    r = r.groupBy("retailer").agg(F.count(F.lit(1)).alias("n")).withColumn("store", text.store_name(F.col("retailer"))).where("store is not null")
    return r.groupBy("store").agg(F.sum("n").alias("n"), F.count("retailer").alias("spellings"))


#: Structured conditions as sources write them, with their classes.
_CONDITIONS = (
    ("Like New", "used"), ("New (never used)", "new"), ("New other (see details)", "open_box"), ("Certified - Refurbished", "refurbished"), ("1600", "open_box"), ("2750", "used"), ("7000", "for_parts"), ("9999", None), ("Open-Box Fair", "open_box"), ("Very Good - Refurbished", "refurbished"),
    ("fairly priced", None), ("PRE_OWNED_FAIR", "used"), ("FOR_PARTS_OR_NOT_WORKING", "for_parts"), ("factory sealed", "new"), ("unused", None),
)
#: Free texts, the kind of the source, and the class that comes of both.
_HINTS = (
    ("brand new, never opened", "local", "new"), ("like new", "retail", "used"), ("not refurbished. sealed", "marketplace", "new"), ("open box, tested", "aggregator", "open_box"), ("for parts only", "retail", "for_parts"), ("works well", "local", "used"), ("works well", "retail", "new"),
    ("can be used outdoors", "aggregator", "new"), ("brand new in an open box", "marketplace", "open_box"), ("with new thermal pads", "local", "used"), ("re-sealed", "local", "used"), ("was never used, BNIB", "local", "new"), ("new other", "local", "used"), ("nothing said", "other", "unknown"),
)


def _q(x: str | None) -> str:
    return "NULL" if x is None else f"'{x}'"


@query(f"""
    SELECT obs_id, coalesce(c, 'none') AS condition FROM (SELECT obs_id, CASE WHEN obs_id % 2 = 0 THEN list_value({", ".join(_q(b) for _, b in _CONDITIONS)})[(obs_id // 2 % {len(_CONDITIONS)}) + 1]
        WHEN regexp_matches(t, '^\\d{{4}}$') THEN CASE WHEN t::INT BETWEEN 1000 AND 1499 THEN 'new' WHEN t::INT BETWEEN 1500 AND 1999 THEN 'open_box' WHEN t::INT BETWEEN 2000 AND 2749 THEN 'refurbished' WHEN t::INT BETWEEN 2750 AND 6999 THEN 'used' WHEN t::INT = 7000 THEN 'for_parts' END
        WHEN regexp_matches(t, 'parts|not working|salvage') THEN 'for_parts' WHEN regexp_matches(t, 'refurb|renewed|recondition|certified') THEN 'refurbished' WHEN regexp_matches(t, 'open.?box|new.other|defects') THEN 'open_box'
        WHEN regexp_matches(t, '(^|[^r]\\s|[^a-z\\s])used|^used|pre.?owned|like.new') AND NOT regexp_matches(t, 'never used') THEN 'used' WHEN regexp_matches(t, '\\b(new|sealed|bnib|nib)\\b') THEN 'new' WHEN regexp_matches(t, '\\b(good|fair|excellent|acceptable|poor|mint|worn)\\b') THEN 'used' END AS c
      FROM (SELECT obs_id, lower(trim(condition_raw)) AS t FROM raw_listings))""")
def condition_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of structured conditions; every second row carries one of a list of cases."""
    case = F.get(F.array(*(F.lit(a) for a, _ in _CONDITIONS)), (F.floor(F.col("obs_id") / 2) % len(_CONDITIONS)).cast("int"))
    r = load(spark, d, "raw_listings").select("obs_id", F.when(F.col("obs_id") % 2 == 0, case).otherwise(F.col("condition_raw")).alias("c"))
    return r.select("obs_id", F.coalesce(text.condition_of(F.col("c")), F.lit("none")).alias("condition"))


@query(f"SELECT item_id, list_value({', '.join(_q(c) for *_, c in _HINTS)})[(item_id % {len(_HINTS)}) + 1] AS condition FROM deal_items")
def condition_text(spark: SparkSession, d: str) -> DataFrame:
    """Classes of listings without a structured condition, of what their texts say and where they are from: each item's number
    with one of a list of cases."""
    at = (F.col("item_id") % len(_HINTS)).cast("int")
    said, kind = (F.get(F.array(*(F.lit(x[k]) for x in _HINTS)), at) for k in (0, 1))
    i = load(spark, d, "deal_items").select("item_id", F.concat(F.lit("Item "), "item_id", F.lit(", "), said).alias("t"), kind.alias("k"))
    return i.select("item_id", text.parse_condition(F.lit(None).cast("string"), F.col("k"), F.col("t")).alias("condition"))


#: Ways in which titles name a price, P, beside other amounts.
_PRICED = ("{t} - $P", "{t} $50 off, now $P shipped", "{t} ($P - $0.00)", "Save $100 - {t} $P + $20 shipping", "[DEAL] {t} (-$30 rebate) P USD", "{t} ($9999 value) for US $P", "{t} 240Hz 2024 20% off", "C$P {t}")


@query(f"""
    WITH p AS (SELECT item_id, item_id % {len(_PRICED)} AS k, printf('%.2f', round(1 + abs(hash(item_id)) % 0 + item_id % 8999 + (item_id % 100) / 100.0, 2))::DOUBLE AS p FROM deal_items)
    SELECT item_id, CASE WHEN k = 6 THEN NULL ELSE p END AS price, CASE WHEN k = 6 THEN NULL WHEN k = 7 THEN 'CAD' ELSE 'USD' END AS currency FROM p""".replace("abs(hash(item_id)) % 0 + ", ""))
def title_price(spark: SparkSession, d: str) -> DataFrame:
    """Prices named in titles: the items' numbers as prices, written in one of several ways beside reductions and charges."""
    i = load(spark, d, "deal_items").select("item_id", (F.col("item_id") % len(_PRICED)).alias("k"), F.printf(F.lit("%.2f"), 1 + F.col("item_id") % 8999 + (F.col("item_id") % 100) / 100).alias("p"))
    t = F.get(F.array(*(F.lit(x) for x in _PRICED)), F.col("k").cast("int"))
    m = i.select("item_id", money.text_price(F.replace(F.replace(t, F.lit("{t}"), F.concat(F.lit("Card "), "item_id")), F.lit("P"), F.col("p"))).alias("m"))
    return m.select("item_id", F.col("m.amount").alias("price"), F.col("m.currency").alias("currency"))


@query("""
    WITH r AS (SELECT *, obs_id % 7 AS k FROM raw_listings WHERE price_num IS NOT NULL AND price_raw IS NULL AND NOT isnan(price_num) AND abs(price_num) <= 10000000)
    SELECT obs_id, CASE WHEN k = 0 THEN 'empty_title' WHEN k = 1 THEN 'bad_url' WHEN price_num < 0 THEN 'negative_price' WHEN upper(coalesce(nullif(trim(currency), ''), 'USD')) <> 'USD' THEN 'unsupported_currency' END AS error,
      CASE WHEN price_num >= 0 THEN round(price_num, 2) END AS price, CASE WHEN price_num >= 0 THEN round(round(price_num, 2) + CASE WHEN shipping_num >= 0 AND shipping_num <= 10000000 THEN round(shipping_num, 2) ELSE 0 END, 2) END AS total_price,
      CASE WHEN list_price_num > 0 AND list_price_num <= 10000000 THEN round(list_price_num, 2) END AS list_price
    FROM r""")
def normalise_listings(spark: SparkSession, d: str) -> DataFrame:
    """The master projection over all observations priced by number, a seventh each without a title and with a bad URL; shipping
    and list prices count by their numbers."""
    r = load(spark, d, "raw_listings").where("price_num is not null and price_raw is null and not isnan(price_num) and abs(price_num) <= 10000000").withColumn("k", F.col("obs_id") % 7)
    none = F.lit(None).cast("string")
    r = r.withColumns({"title": F.when(F.col("k") == 0, F.lit(" <b>!</b> ")).otherwise(F.col("title")), "url": F.when(F.col("k") == 1, F.lit("ftp://x")).otherwise(F.col("url")), "shipping_raw": none, "list_price_raw": none})
    return normalise(r, ("obs_id",), ("USD",)).select("obs_id", "error", "price", "total_price", "list_price")


@query()
def normalised(spark: SparkSession, d: str) -> DataFrame:
    """The master projection over all observations as they are."""
    return normalise(load(spark, d, "raw_listings"))


@query("""
    SELECT item_id, len(regexp_replace(title, '[^\\(\\[]', '', 'g')) > 0 AS has_brackets, (len(title) + len(regexp_replace(title, '[^\\x{10000}-\\x{10ffff}]', '', 'g')))::INTEGER AS utf16 FROM deal_items""")
def title_shapes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return load(spark, d, "deal_items").select("item_id", ((values.bracket_depth(t) > 0) | t.rlike(r"[\(\[]")).alias("has_brackets"), text.utf16_length(t).alias("utf16"))


@query("""
    SELECT obs_id, json_extract_string(extra, '$.specs.size') AS spec_size, json_extract_string(extra, '$.specs.tags[0]') AS first_tag,
      json_extract_string(extra, '$.specs.tags[#-1]') AS last_tag, json_extract_string(extra, '$.flair') AS flair
    FROM raw_listings""")
def json_path_extract(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "raw_listings")
    return r.select("obs_id", *(values.json_path(F.col("extra"), p).alias(n) for n, p in (("spec_size", "specs.size"), ("first_tag", "specs.tags[0]"), ("last_tag", "specs.tags[-1]"), ("flair", "flair"))))


# --- keyed merges, changes, retention -----------------------------------------------------------------


@query("""
    SELECT source, source_id, arg_max(title, (received_at, obs_id)) AS title, arg_max(url, (received_at, obs_id)) AS url,
      arg_max(condition_raw, (received_at, obs_id)) FILTER (condition_raw IS NOT NULL) AS condition_raw,
      arg_max(retailer, (received_at, obs_id)) FILTER (retailer IS NOT NULL) AS retailer,
      arg_min(obs_id, (received_at, obs_id)) AS first_obs, min(price_num) FILTER (NOT isnan(price_num)) AS least_price,
      epoch_us(min(received_at))::BIGINT AS first_us, epoch_us(max(received_at))::BIGINT AS last_us, count(*)::BIGINT AS n
    FROM raw_listings GROUP BY source, source_id""")
def listing_upsert(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "raw_listings").withColumn("price", F.when(~F.isnan("price_num"), F.col("price_num")))
    u = merge.upsert(r, ["source", "source_id"], [F.col("received_at"), F.col("obs_id")], ["title", "url"], ["condition_raw", "retailer"], {"first_obs": "obs_id"}, {"least_price": "price"}, "received_at", count="n")
    return u.select("source", "source_id", "title", "url", "condition_raw", "retailer", "first_obs", "least_price", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "n")


_CONTENT = ("source", "source_id", "url", "title", "description", "price_raw", "price_num", "currency", "shipping_raw", "shipping_num", "posted_at", "received_at")


@query(f"""
    SELECT min(obs_id) AS obs_id, count(*)::BIGINT AS deliveries FROM raw_listings GROUP BY {", ".join(_CONTENT)}""")
def snapshot_append_dedup(spark: SparkSession, d: str) -> DataFrame:
    return merge.redelivered(load(spark, d, "raw_listings"), "obs_id", list(_CONTENT))


@query("""
    SELECT source, source_id, arg_min(retailer, item_id) FILTER (retailer IS NOT NULL) AS retailer, arg_min(sku, item_id) FILTER (sku IS NOT NULL) AS sku,
      arg_min(description, item_id) FILTER (description IS NOT NULL) AS description, bool_or(in_stock) AS in_stock, max(quantity)::DOUBLE AS quantity
    FROM deal_items GROUP BY source, source_id""")
def gap_filling_merge(spark: SparkSession, d: str) -> DataFrame:
    return merge.fill_gaps(load(spark, d, "deal_items"), ["source", "source_id"], [F.col("item_id")], ["retailer", "sku", "description"], ["in_stock"], ["quantity"]).withColumn("quantity", F.col("quantity").cast("double"))


@query("""
    WITH s AS (SELECT obs_id, price_raw, price_num, in_stock, row_number() OVER w AS k, lag(price_raw) OVER w AS a, lag(price_num) OVER w AS b, lag(in_stock) OVER w AS c
      FROM raw_listings WINDOW w AS (PARTITION BY source, source_id ORDER BY received_at, obs_id))
    SELECT obs_id FROM s WHERE k = 1 OR price_raw IS DISTINCT FROM a OR price_num IS DISTINCT FROM b OR in_stock IS DISTINCT FROM c""")
def change_detection(spark: SparkSession, d: str) -> DataFrame:
    return merge.changes(load(spark, d, "raw_listings"), ["source", "source_id"], [F.col("received_at"), F.col("obs_id")], ["price_raw", "price_num", "in_stock"]).select("obs_id")


@query("""
    SELECT obs_id FROM raw_listings WHERE posted_at IS NULL OR epoch_us(posted_at) >= epoch_us(received_at) - 86400000000""")
def stale_guard(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "raw_listings")
    return r.where(F.col("posted_at").isNull() | (F.col("posted_at") >= F.col("received_at") - F.expr("interval 1 day"))).select("obs_id")


@query("""
    WITH m AS (SELECT max(epoch_us(received_at)) - 30 * 86400000000 AS t FROM raw_listings)
    SELECT obs_id, CASE WHEN epoch_us(received_at) < m.t AND title IS NOT NULL THEN '[purged]' ELSE title END AS title,
      CASE WHEN epoch_us(received_at) < m.t AND description IS NOT NULL THEN '[purged]' ELSE description END AS description, price_num
    FROM raw_listings, m WHERE epoch_us(received_at) >= m.t - 60 * 86400000000 AND NOT coalesce(isnan(price_num), false)""")
def prune_and_scrub(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "raw_listings")
    top = r.agg(F.max(F.unix_micros("received_at"))).scalar()
    day = 86_400_000_000
    at = F.unix_micros("received_at")
    r = r.where(~F.coalesce(F.isnan("price_num"), F.lit(False)) & (at >= top - 90 * day))
    return merge.scrubbed(r, at < top - 30 * day, ["title", "description"]).select("obs_id", "title", "description", "price_num")


@query("""
    SELECT obs_id FROM raw_listings r WHERE NOT EXISTS (SELECT 1 FROM raw_listings g WHERE g.in_stock = false AND g.source = r.source AND g.source_id = r.source_id)""")
def gone_excluded(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "raw_listings")
    return merge.without(r.select("obs_id", "source", "source_id"), r.where("in_stock = false"), ["source", "source_id"]).select("obs_id")


@query("""
    SELECT obs_id FROM raw_listings r WHERE EXISTS (SELECT 1 FROM deal_items i WHERE i.sku = r.sku AND i.query = r.query)""")
def known_listings(spark: SparkSession, d: str) -> DataFrame:
    r, i = load(spark, d, "raw_listings"), load(spark, d, "deal_items")
    return r.join(i.select("sku", "query").distinct(), ["sku", "query"], "left_semi").select("obs_id")


@query("""
    SELECT url, arg_min(source_id, (received_at, obs_id)) AS source_id FROM raw_listings GROUP BY url""")
def first_identity(spark: SparkSession, d: str) -> DataFrame:
    return merge.first_identity(load(spark, d, "raw_listings"), "url", "source_id", [F.col("received_at"), F.col("obs_id")])


# --- history ------------------------------------------------------------------------------------------

_SAMPLES_SQL = """
    base AS (SELECT coalesce(query, '') || '|' || item_condition AS k, concat_ws(':', source, source_id) AS l, total_price AS v, epoch_us(received_at) / 1e6 AS t, item_id
      FROM deal_items WHERE total_price IS NOT NULL AND NOT isnan(total_price)),
    one AS (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY k, l ORDER BY t DESC, item_id DESC) = 1),
    win AS (SELECT one.*, m FROM one JOIN (SELECT k, max(t) AS m FROM one GROUP BY k) USING (k) WHERE t >= m - 60 * 86400),
    s AS (SELECT k, l, v, t, item_id, exp((t - m) * (ln(2) / (30 * 86400.0))) AS w FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC, item_id DESC) <= 400)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    """One weighted sample per listing and key: the newest, in the window, capped."""
    b = load(spark, d, "deal_items").where(F.col("total_price").isNotNull() & ~F.isnan("total_price"))
    b = b.select(F.concat(F.coalesce("query", F.lit("")), F.lit("|"), "item_condition").alias("k"), values.listing_key(F.col("source"), F.col("source_id")).alias("l"), F.col("total_price").alias("v"), _seconds("received_at").alias("t"), "item_id")
    newest = [F.col("t").desc(), F.col("item_id").desc()]
    one = history.newest_per(b, ["k", "l"], newest)
    top = one.groupBy("k").agg(F.max("t").alias("m"))
    win = one.join(top, "k").where(F.col("t") >= F.col("m") - history.WINDOW_DAYS * 86400)
    return history.capped(win, ["k"], newest).withColumn("w", history.decay_weight(F.col("t"), F.col("m"))).drop("m")


@query(f"WITH {_SAMPLES_SQL} SELECT k, l, v, round(w, 9) AS w FROM s")
def history_weights(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("k", "l", "v", F.round("w", 9).alias("w"))


def _wq(table: str, x: str, q: float) -> str:
    """Every sample at its own position, equal values too."""
    return f"""SELECT k, max(CASE WHEN f AND {q} < p THEN {x} WHEN p2 IS NULL AND {q} >= p THEN {x} WHEN p <= {q} AND {q} < p2 THEN {x} + (x2 - {x}) * ({q} - p) / (p2 - p) END) AS r FROM (
        SELECT k, {x}, p, lead(p) OVER o AS p2, lead({x}) OVER o AS x2, row_number() OVER o = 1 AS f FROM (
          SELECT k, {x}, w, (sum(w) OVER (PARTITION BY k ORDER BY {x}, w ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY k) AS p FROM {table}) WINDOW o AS (PARTITION BY k ORDER BY {x}, w)) GROUP BY k"""


@query(f"""
    WITH {_SAMPLES_SQL}, q1 AS ({_wq("s", "v", 0.25)}), q2 AS ({_wq("s", "v", 0.5)}), q3 AS ({_wq("s", "v", 0.75)}),
    dev AS (SELECT s.k, abs(v - r) AS e, w FROM s JOIN q2 USING (k)), mad AS ({_wq("dev", "e", 0.5)})
    SELECT k, count(*)::BIGINT AS n, round(pow(sum(w), 2) / sum(w * w), 4) AS n_eff, min(v) AS least, max(v) AS largest,
      round(any_value(q1.r), 4) AS q1, round(any_value(q2.r), 4) AS median, round(any_value(q3.r), 4) AS q3, round(any_value(mad.r), 4) AS mad,
      round(greatest(any_value(q3.r) - any_value(q1.r), 0), 4) AS iqr
    FROM s JOIN q1 USING (k) JOIN q2 USING (k) JOIN q3 USING (k) JOIN mad USING (k) GROUP BY k""")
def history_stats(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    h = history.history_stats(s, ["k"])
    return h.select("k", "n", F.round("n_eff", 4).alias("n_eff"), "least", "largest", *(F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "mad", "iqr")))


_SNAPSHOTS = """
    l AS (SELECT source, source_id, min(item_id) AS listing_id, concat_ws(':', source, source_id) AS listing_key FROM deal_items GROUP BY source, source_id),
    s AS (SELECT item_id AS id, l.listing_id, query AS product_key, item_condition AS condition_class, total_price, epoch_us(received_at) AS t, d.source, coalesce(in_stock, true) AS accepted, (item_id % 100) / 100.0 AS risk
      FROM deal_items d JOIN l USING (source, source_id) WHERE total_price IS NOT NULL AND NOT isnan(total_price))"""


@query(f"""
    WITH {_SNAPSHOTS}, since AS (SELECT max(t) - 90 * 86400000000 AS t0 FROM s),
    a AS (SELECT s.* FROM s, since WHERE accepted AND t >= t0 AND product_key IS NOT NULL AND (risk IS NULL OR risk <= 0.8) QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY t DESC, id DESC) = 1),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY product_key, condition_class ORDER BY t DESC, listing_id) <= 400)
    SELECT product_key, condition_class, l.listing_key, total_price, t::BIGINT AS observed_us, b.source, row_number() OVER (PARTITION BY product_key, condition_class ORDER BY t, b.listing_id)::INTEGER AS position FROM b JOIN l USING (listing_id)""")
def warm_start_history(spark: SparkSession, d: str) -> DataFrame:
    """The accepted, recent and not too risky snapshots that price history starts from: the newest of each listing, the newest
    `history.CAP` of each key, with the listing's key joined on, in order of time."""
    i = load(spark, d, "deal_items")
    listings = i.groupBy("source", "source_id").agg(F.min("item_id").alias("listing_id")).select("listing_id", "source", "source_id", values.listing_key(F.col("source"), F.col("source_id")).alias("listing_key"))
    snapshots = i.where("total_price is not null and not isnan(total_price)").join(listings.select("listing_id", "source", "source_id"), ["source", "source_id"])
    snapshots = snapshots.select(F.col("item_id").alias("id"), "listing_id", F.col("query").alias("product_key"), F.col("item_condition").alias("condition_class"), "total_price", F.col("received_at").alias("observed_at"), "source", F.coalesce("in_stock", F.lit(True)).alias("accepted"), (F.col("item_id") % 100 / 100.0).alias("risk"))
    since = snapshots.agg(F.max("observed_at")).scalar() - F.expr("interval 90 days")
    h = history.warm_start(snapshots, listings, since, most_risk=0.8)
    return h.select("product_key", "condition_class", "listing_key", "total_price", F.unix_micros("observed_at").alias("observed_us"), "source", "position")


@query("""
    SELECT item_id, count(v) OVER w AS n_before, round(coalesce(sum(v) OVER w, 0), 2) AS sum_before, min(v) OVER w AS least_before
    FROM (SELECT item_id, query, received_at, CASE WHEN NOT isnan(total_price) THEN total_price END AS v FROM deal_items)
    WINDOW w AS (PARTITION BY query ORDER BY received_at, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def asof_history(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "deal_items").select("item_id", "query", _seconds("received_at").alias("t"), F.when(~F.isnan("total_price"), F.col("total_price")).alias("v"))
    return asof.running_before(i, "query", "t", "item_id", "v").select("item_id", "n_before", F.round("sum_before", 2).alias("sum_before"), "least_before")


@query("""
    WITH u AS (SELECT query, epoch_us(received_at) AS t, 1 AS side, item_id, NULL::BIGINT AS obs FROM deal_items WHERE query IS NOT NULL
      UNION ALL SELECT query, epoch_us(received_at), 0, NULL, obs_id FROM raw_listings WHERE query IS NOT NULL)
    SELECT item_id, obs::DOUBLE AS obs_id FROM (SELECT side, item_id, last_value(obs IGNORE NULLS) OVER (PARTITION BY query ORDER BY t, side, obs ROWS UNBOUNDED PRECEDING) AS obs FROM u) WHERE side = 1""")
def asof_observation(spark: SparkSession, d: str) -> DataFrame:
    """For every deal the latest observation of its query by then."""
    r = load(spark, d, "raw_listings").where("query is not null").select("query", F.unix_micros("received_at").alias("t"), "obs_id")
    i = load(spark, d, "deal_items").where("query is not null").select("item_id", "query", F.unix_micros("received_at").alias("at"))
    return asof.asof_join(i, r, "query", "at", "t", ["obs_id"], 86_400_000_000).select("item_id", F.col("obs_id").cast("double").alias("obs_id"))


@query("""
    WITH c AS (SELECT regexp_replace(lower(trim(retailer)), '[^a-z0-9]+', '', 'g') AS store, query, item_id, epoch_us(received_at) / 1e6 AS t,
        floor(ln(total_price) / ln(1 + 0.02))::BIGINT AS b FROM deal_items WHERE retailer IS NOT NULL AND query IS NOT NULL AND total_price > 0 AND NOT isnan(total_price))
    SELECT x.item_id AS a_id, y.item_id AS b_id FROM c x JOIN c y ON x.store = y.store AND x.query = y.query AND abs(x.b - y.b) <= 1 AND x.item_id <> y.item_id
      AND y.t - x.t BETWEEN 0 AND 43200 AND (y.t > x.t OR x.item_id < y.item_id)""")
def cluster_pairs(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "deal_items").where("retailer is not null and query is not null and total_price > 0 and not isnan(total_price)")
    i = i.select(text.store_name(F.col("retailer")).alias("store"), "query", "item_id", _seconds("received_at").alias("t"), values.price_bucket(F.col("total_price"), 0.02).alias("bucket"))
    return asof.near_pairs(i, ["store", "query"], "bucket", "item_id", "t", 43200).select("a_id", "b_id")


@query("""
    SELECT item_id, query, total_price FROM deal_items WHERE query IS NOT NULL AND total_price IS NOT NULL AND NOT isnan(total_price) QUALIFY row_number() OVER (PARTITION BY query ORDER BY total_price, item_id) <= 3""")
def topk_per_key(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "deal_items").where("query is not null and total_price is not null and not isnan(total_price)")
    return history.capped(i, ["query"], [F.col("total_price"), F.col("item_id")], 3).select("item_id", "query", "total_price")


@query("""
    SELECT obs_id, epoch_us(received_at)::BIGINT AS received_us FROM raw_listings ORDER BY received_at DESC, obs_id LIMIT 50""")
def recent_observations(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "raw_listings")
    return r.orderBy(F.col("received_at").desc(), "obs_id").limit(50).select("obs_id", F.unix_micros("received_at").alias("received_us"))


# --- counters, histograms, windows in time ------------------------------------------------------------


@query("""
    SELECT source, CASE WHEN isnan(price_num) THEN 'nan' WHEN price_num < 0 THEN 'negative' WHEN price_num IS NOT NULL THEN 'number' WHEN trim(price_raw) <> '' THEN 'text' ELSE 'none' END AS outcome, count(*)::BIGINT AS n
    FROM raw_listings GROUP BY ALL""")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("price_num")
    outcome = F.when(F.isnan(p), "nan").when(p < 0, "negative").when(p.isNotNull(), "number").when(F.trim("price_raw") != "", "text").otherwise("none")
    return load(spark, d, "raw_listings").groupBy("source", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT 'raw_listings' AS name, count(*)::BIGINT AS n FROM raw_listings UNION ALL SELECT 'deal_items', count(*) FROM deal_items UNION ALL SELECT 'documents', count(*) FROM documents""")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = [load(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("raw_listings", "deal_items", "documents")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_EDGES = (60.0, 300.0, 1800.0, 3600.0, 21600.0, 86400.0)


@query(f"""
    WITH x AS (SELECT source, (epoch_us(received_at) - epoch_us(posted_at)) / 1e6 AS lag FROM raw_listings WHERE posted_at IS NOT NULL AND received_at >= posted_at)
    SELECT source, edge, count(*) FILTER (lag <= edge)::BIGINT AS upto, count(*)::BIGINT AS n FROM x, (VALUES {", ".join(f"({e})" for e in _EDGES)}) v(edge) GROUP BY ALL""")
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "raw_listings").where("posted_at is not null and received_at >= posted_at").select("source", ((F.unix_micros("received_at") - F.unix_micros("posted_at")) / 1e6).alias("lag"))
    h = r.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.struct(F.lit(e).alias("edge"), F.count_if(F.col("lag") <= e).alias("upto")) for e in _EDGES)).alias("h"))
    return h.select("source", "n", F.inline("h")).select("source", F.col("edge").cast("double").alias("edge"), "upto", "n")


@query("""
    SELECT source, strftime(timezone('America/Los_Angeles', received_at), '%Y-%m-%d') AS pacific_day, count(*)::BIGINT AS calls FROM raw_listings GROUP BY ALL""")
def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format(F.from_utc_timestamp("received_at", "America/Los_Angeles"), "yyyy-MM-dd")
    return load(spark, d, "raw_listings").groupBy("source", day.alias("pacific_day")).agg(F.count(F.lit(1)).alias("calls"))


@query("""
    SELECT obs_id, count(*) OVER (PARTITION BY source ORDER BY epoch_us(received_at) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)::BIGINT AS last_hour FROM raw_listings""")
def sliding_count(spark: SparkSession, d: str) -> DataFrame:
    # A source is a hot key: rows are counted inside (source, hour) and against the hour before only.
    r = load(spark, d, "raw_listings").select("obs_id", "source", F.unix_micros("received_at").alias("t"))
    span = 3_600_000_000
    r = r.withColumn("slot", F.floor(F.col("t") / span))
    both = r.select("*", F.lit(True).alias("own")).unionByName(r.select(F.col("obs_id"), F.col("source"), F.col("t"), (F.col("slot") + 1).alias("slot"), F.lit(False).alias("own")))
    w = W.partitionBy("source", "slot").orderBy("t").rangeBetween(-span, 0)
    return both.withColumn("last_hour", F.count(F.lit(1)).over(w)).where("own").select("obs_id", "last_hour")


@query("""
    SELECT event_type, epoch_us(time_bucket(INTERVAL 1 hour, ts))::BIGINT AS hour_us, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def tumbling_events(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return e.select("event_type", F.unix_micros("w.start").alias("hour_us"), "n", "total")


@query("""
    WITH g AS (SELECT user_id, ts, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS s FROM events),
    i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts))::BIGINT AS first_us, epoch_us(max(ts))::BIGINT AS last_us, count(*)::BIGINT AS n FROM i GROUP BY user_id, k""")
def session_events(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.unix_micros("a").alias("first_us"), F.unix_micros("b").alias("last_us"), "n")


# --- scans --------------------------------------------------------------------------------------------


@query("""
    WITH p AS (SELECT page_id, json(body) AS j FROM redsky_pages WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
    v AS (SELECT page_id, (i - 1)::INTEGER AS pos, json_extract(j, '$.data.product_summaries[' || (i - 1) || ']') AS v FROM p, range(1, coalesce(json_array_length(j, '$.data.product_summaries'), 0)::BIGINT + 1) t(i)
      UNION ALL SELECT page_id, 0, json_extract(j, '$.data.product') FROM p)
    SELECT page_id, pos, v->>'$.tcin' AS source_id, v->>'$.item.product_description.title' AS title, (v->>'$.price.current_retail')::DOUBLE AS price_num,
      CASE WHEN (v->>'$.price.reg_retail')::DOUBLE > (v->>'$.price.current_retail')::DOUBLE THEN (v->>'$.price.reg_retail')::DOUBLE END AS list_price_num, v->>'$.item.enrichment.buy_url' AS url
    FROM v WHERE v->>'$.tcin' IS NOT NULL""")
def scan_redsky(spark: SparkSession, d: str) -> DataFrame:
    return feeds.redsky(load(spark, d, "redsky_pages")).select("page_id", "pos", "source_id", "title", "price_num", "list_price_num", "url")


@query("""
    WITH p AS (SELECT page_id, json(body) AS v FROM newegg_pages WHERE json_valid(body))
    SELECT page_id, v->>'$.MainItem.Item' AS source_id, v->>'$.MainItem.Description.Title' AS title, (v->>'$.MainItem.FinalPrice')::DOUBLE AS price_num, (v->>'$.MainItem.ShippingCharge')::DOUBLE AS shipping_num,
      CASE WHEN (v->>'$.MainItem.Feature.IsOpenBoxed')::BOOLEAN THEN 'open box' WHEN (v->>'$.MainItem.Feature.IsRefurbished')::BOOLEAN THEN 'refurbished' WHEN (v->>'$.MainItem.Feature.IsNew')::BOOLEAN THEN 'new' END AS condition_raw,
      coalesce((v->>'$.MainItem.Instock')::BOOLEAN, false) AND NOT coalesce((v->>'$.IsForceDeactiveItem')::BOOLEAN, false) AS in_stock
    FROM p WHERE v->>'$.MainItem.Item' IS NOT NULL""")
def scan_newegg(spark: SparkSession, d: str) -> DataFrame:
    return feeds.newegg(load(spark, d, "newegg_pages")).select("page_id", "source_id", "title", "price_num", "shipping_num", "condition_raw", "in_stock")


@query("""
    WITH p AS (SELECT page_id, json(body) AS j FROM hardwareswap_pages WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
    v AS (SELECT page_id, (i - 1)::INTEGER AS pos, json_extract(j, '$.data.children[' || (i - 1) || ']') AS v FROM p, range(1, coalesce(json_array_length(j, '$.data.children'), 0)::BIGINT + 1) t(i))
    SELECT page_id, pos, v->>'$.data.name' AS source_id, v->>'$.data.title' AS title, v->>'$.data.author' AS author,
      nullif(regexp_extract(v->>'$.data.title', '(?i)^\\s*\\[([^\\]]*)\\]\\s*\\[H\\]\\s*(.*?)\\s*\\[W\\]\\s*(.*)$', 3), '') AS want
    FROM v WHERE v->>'$.kind' = 't3' AND v->>'$.data.name' IS NOT NULL""")
def scan_forum(spark: SparkSession, d: str) -> DataFrame:
    return feeds.forum(load(spark, d, "hardwareswap_pages")).select("page_id", "pos", "source_id", "title", "author", "want")


@query("""
    WITH p AS (SELECT page_id, json(body) AS j FROM hardwareswap_pages WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
    v AS (SELECT json_extract(j, '$.data.children[' || (i - 1) || ']') AS v FROM p, range(1, coalesce(json_array_length(j, '$.data.children'), 0)::BIGINT + 1) t(i)),
    s AS (SELECT v->>'$.kind' AS kind, v->>'$.data.name' AS name, coalesce((v->>'$.data.stickied')::BOOLEAN, false) AS stickied, v->>'$.data.removed_by_category' AS removed,
      lower(nullif(regexp_extract(v->>'$.data.title', '(?i)^\\s*\\[([^\\]]*)\\]\\s*\\[H\\]\\s*(.*?)\\s*\\[W\\]\\s*(.*)$', 2), '')) AS h, lower(nullif(regexp_extract(v->>'$.data.title', '(?i)^\\s*\\[([^\\]]*)\\]\\s*\\[H\\]\\s*(.*?)\\s*\\[W\\]\\s*(.*)$', 3), '')) AS w FROM v),
    m AS (SELECT *, regexp_matches(h, '\\b(paypal|venmo|zelle|cash|cashapp|local cash)\\b') AS mh, regexp_matches(w, '\\b(paypal|venmo|zelle|cash|cashapp|local cash)\\b') AS mw FROM s)
    SELECT CASE WHEN kind IS DISTINCT FROM 't3' OR name IS NULL THEN 'malformed' WHEN stickied THEN 'stickied' WHEN removed IS NOT NULL THEN 'removed' WHEN h IS NULL THEN 'no_swap_title' WHEN NOT coalesce(mw AND NOT mh, false) THEN 'not_selling' ELSE 'taken' END AS reason, count(*)::BIGINT AS n FROM m GROUP BY 1""")
def forum_skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why posts aren't taken; malformed ones are counted too."""
    posts = feeds.swap_intent(feeds.forum(load(spark, d, "hardwareswap_pages"), malformed=True))
    return posts.groupBy(F.coalesce(feeds.skip_reason(), F.lit("taken")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# --- generic operators on the star schema -------------------------------------------------------------


@query("""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-30' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-06-30").cast("timestamp"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""
    SELECT r_name, n_name, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY ROLLUP (r_name, n_name)""")
def rollup_sales(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
    (SELECT query, retailer FROM raw_listings INTERSECT SELECT query, retailer FROM deal_items) UNION (SELECT query, retailer FROM raw_listings WHERE in_stock = false EXCEPT SELECT query, retailer FROM deal_items)""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    r, i = (load(spark, d, t).select("query", "retailer", "in_stock") for t in ("raw_listings", "deal_items"))
    keys = lambda x: x.select("query", "retailer")
    return keys(r).intersect(keys(i)).union(keys(r.where("in_stock = false")).subtract(keys(i))).distinct()


@query("""
    SELECT item_id, list_max(list_filter(list_transform(regexp_extract_all(lower(title), '\\b([0-9]{1,3}) ?gb?\\b', 1), lambda x: x::INTEGER), lambda x: x BETWEEN 1 AND 512))::DOUBLE AS memory_gb,
      list_max(list_filter(list_transform(regexp_extract_all(lower(title), '\\b([0-9]{2,4}) ?hz\\b', 1), lambda x: x::INTEGER), lambda x: x BETWEEN 24 AND 1000))::DOUBLE AS refresh_hz,
      nullif(regexp_extract(lower(title), '\\b(qd-oled|oled|ips|va|tn|mini-?led)\\b', 1), '') AS panel
    FROM deal_items""")
def title_specs(spark: SparkSession, d: str) -> DataFrame:
    s = specs.specs(F.col("title"))
    return load(spark, d, "deal_items").select("item_id", *(s[c].cast("double").alias(c) for c in ("memory_gb", "refresh_hz")), s["panel"].alias("panel"))


@query(f"""
    WITH x AS (SELECT source, (epoch_us(received_at) - epoch_us(posted_at)) / 1e6 AS lag FROM raw_listings WHERE posted_at IS NOT NULL AND received_at >= posted_at),
    e AS (SELECT i, edge FROM (VALUES {", ".join(f"({k}, {e})" for k, e in enumerate(_EDGES))}) v(i, edge)),
    c AS (SELECT source, i, edge, count(*) FILTER (lag <= edge) AS u, count(*) AS n FROM x, e GROUP BY ALL),
    k AS (SELECT source, n, count(*) FILTER (u < 0.95 * n) AS k FROM c GROUP BY ALL)
    SELECT k.source, round(CASE WHEN k.k >= {len(_EDGES)} THEN {_EDGES[-1]} ELSE coalesce(a.edge, 0) + (b.edge - coalesce(a.edge, 0)) * (0.95 * k.n - coalesce(a.u, 0)) / greatest(b.u - coalesce(a.u, 0), 1) END, 3) AS p95
    FROM k LEFT JOIN c a ON a.source = k.source AND a.i = k.k - 1 LEFT JOIN c b ON b.source = k.source AND b.i = k.k""")
def latency_quantile(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "raw_listings").where("posted_at is not null and received_at >= posted_at").select("source", ((F.unix_micros("received_at") - F.unix_micros("posted_at")) / 1e6).alias("lag"))
    h = r.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.count_if(F.col("lag") <= e) for e in _EDGES)).alias("upto"))
    return h.select("source", F.round(specs.histogram_quantile(F.array(*(F.lit(e) for e in _EDGES)), F.col("upto"), F.col("n"), 0.95), 3).alias("p95"))


@query()
def listing_messages(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "deal_items")
    facts = [(3, F.format_string("%s %.2f", "currency", "total_price")), (2, F.col("item_condition")), (1, F.col("description"))]
    return i.select("item_id", render.html_message(F.col("title"), F.col("url"), facts, 500).alias("message"), render.embed(F.col("title"), F.col("url"), F.col("description"), {"Price": F.col("total_price"), "Condition": F.col("item_condition"), "Store": F.col("retailer")}).alias("payload"))


@query("""
    WITH v AS (SELECT user_id, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY ALL)
    SELECT user_id, CASE WHEN max(top) FILTER (event_type = 'error') >= 50 THEN 'error' WHEN bool_or(event_type = 'purchase') THEN 'purchase' WHEN bool_or(event_type = 'click') THEN 'click' ELSE 'other' END AS verdict FROM v GROUP BY user_id""")
def verdict_aggregate(spark: SparkSession, d: str) -> DataFrame:
    # Several answers to one verdict: a strong negative wins, else the best positive kind.
    e = load(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("strongest"), *(F.bool_or(F.col("event_type") == k).alias(k) for k in ("purchase", "click")))
    return e.select("user_id", F.when(F.col("strongest") >= 50, "error").when(F.col("purchase"), "purchase").when(F.col("click"), "click").otherwise("other").alias("verdict"))
