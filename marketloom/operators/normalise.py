"""The master projection: raw listings to normalised items, or to the first reason why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import money, text, values
from marketloom.tables import spread

MOST_TITLE, MOST_DESCRIPTION, MOST_IMAGES = 300, 5000, 8
#: Reasons in the order in which they are looked for.
ERRORS = ("empty_title", "bad_url", "negative_price", "no_price", "unsupported_currency")


def currency(mark: Column, bare: Column, listed: Column) -> Column:
    """The currency of an amount: its own mark, but the listing's where there is none or only a dollar sign and the listing's is a
    dollar too; the listing's is USD if it isn't a code."""
    code = F.upper(F.trim(listed))
    own = F.when(code.rlike("^[A-Z]{3}$"), code).otherwise("USD")
    return F.when(mark.isNull() | (bare & own.isin(*money.DOLLAR_CODES)), own).otherwise(mark)


def normalise(raw: DataFrame, keep: tuple[str, ...] = ("obs_id",), allowed: tuple[str, ...] = ("USD",)) -> DataFrame:
    """`keep`, then error (null for usable rows) and title, url, outbound_url, description, price, currency, shipping, total_price,
    list_price, item_condition, image_urls, price_origin (field, title or description).

    Evaluated in the order of `ERRORS`; the first that holds is the error. A price that its field doesn't give is looked for in the
    title, then in the description. Defined edge cases: null texts count as empty; a null or invalid outbound URL is null; NaN
    and infinite amounts aren't amounts; shipping unknown counts as 0 in the total; list prices of 0 or less are null;
    repeated rows each give theirs; other columns are ignored. One pass, no shuffle.
    """
    text_of = lambda c: F.coalesce(F.col(c), F.lit(""))
    needed = ["currency", "condition_raw", "source_kind", "image_urls", "title", "description", "url", "outbound_url", "price_raw", "price_num", "shipping_raw", "shipping_num", "list_price_raw", "list_price_num"]
    d = spread(raw.select(*dict.fromkeys([*keep, *needed]))).select(
        *keep, "currency", "condition_raw", "source_kind", "image_urls",
        text.clean_text(text_of("title"), MOST_TITLE).alias("title"), text.clean_text(text_of("description"), MOST_DESCRIPTION, keep_newlines=True).alias("description"),
        text.url_parts(F.col("url")).alias("u"), text.url_parts(F.col("outbound_url")).alias("o"),
        money.money(F.col("price_raw"), F.col("price_num")).alias("m"), money.shipping(F.col("shipping_raw"), F.col("shipping_num")).alias("shipping"), money.money(F.col("list_price_raw"), F.col("list_price_num"))["amount"].alias("was"),
    )
    open_ = F.col("m.amount").isNull() & ~F.col("m.negative")
    d = d.withColumn("t", money.text_price(F.when(open_, F.col("title")))).withColumn("e", money.text_price(F.when(open_ & F.col("t.amount").isNull(), F.col("description"))))
    origin = F.when(F.col("m.amount").isNotNull(), "field").when(F.col("t.amount").isNotNull(), "title").when(F.col("e.amount").isNotNull(), "description")
    pick = lambda c: F.when(F.col("m.amount").isNotNull(), F.col(f"m.{c}")).when(F.col("t.amount").isNotNull(), F.col(f"t.{c}")).otherwise(F.col(f"e.{c}"))
    d = d.withColumns({"price_origin": origin, "amount": pick("amount"), "mark": pick("currency"), "bare": F.coalesce(pick("bare_dollar"), F.lit(False)), "listed": F.col("currency")})
    d = d.withColumn("currency", currency(F.col("mark"), F.col("bare"), F.col("listed")))
    error = (
        F.when(~F.col("title").rlike(r"[\p{L}\p{N}]"), "empty_title").when(F.col("u").isNull(), "bad_url").when(F.col("m.negative"), "negative_price").when(F.col("amount").isNull(), "no_price").when(~F.col("currency").isin(*allowed), "unsupported_currency")
    )
    price, ship = F.round("amount", 2), F.round("shipping", 2)
    about = F.when(F.col("source_kind").isin("retail", "aggregator"), F.lit("")).otherwise(F.substring("description", 1, 2000))
    return d.select(
        *keep, error.alias("error"), "title", text.canonical_of(F.col("u")).alias("url"), text.canonical_of(F.col("o")).alias("outbound_url"), "description", price.alias("price"), "currency", ship.alias("shipping"),
        F.round(price + F.coalesce(ship, F.lit(0.0)), 2).alias("total_price"), F.when(F.col("was") > 0, F.round("was", 2)).alias("list_price"),
        text.parse_condition(F.col("condition_raw"), F.col("source_kind"), F.col("title"), about).alias("item_condition"), F.slice(values.distinct_urls(F.col("image_urls")), 1, MOST_IMAGES).alias("image_urls"), "price_origin",
    )
