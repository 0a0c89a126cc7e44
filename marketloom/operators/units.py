"""Quantities in differing units: split a unit text over tries, score the readings, convert to one unit.

A unit text such as ``US$``, ``k USD``, ``pesos mexicanos`` or ``¢`` is cut into pieces by dynamic
programming over two tries (prefixes; roots, exponents and filler words). A reading is a sequence of
groups ``prefix* root exponent?`` and fillers that covers the text; each piece has a cost, characters
no trie explains have a high one, and every root pays the negative log prior of its dimension in the
field it stands in (an ``m`` is a million in a price and a metre in a size). The cheapest reading wins.

Only the *shape* of a text (numbers replaced by ``#``) is parsed, and every distinct shape once per
worker process; numbers are taken out, converted and rounded by JVM expressions.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Root(NamedTuple):
    dimension: str
    unit: str
    exp10: int = 0


class Group(NamedTuple):
    dimension: str
    unit: str
    exp10: int
    start: int
    end: int


# Roots of units by surface form. "$" is a dollar whose country is still open.
ROOTS: dict[str, Root] = {
    **{s: Root("money", "$") for s in ("$", "dollar", "dollars", "buck", "bucks")},
    **{s: Root("money", c) for c in ("USD", "CAD", "AUD", "EUR", "GBP", "MXN", "JPY", "CHF") for s in (c.lower(),)},
    **{s: Root("money", "EUR") for s in ("€", "euro", "euros")},
    **{s: Root("money", "GBP") for s in ("£", "pound", "pounds", "sterling", "pounds sterling", "quid")},
    **{s: Root("money", "MXN") for s in ("peso", "pesos", "pesos mexicanos")},
    **{s: Root("money", "JPY") for s in ("¥", "yen", "円", "jpy")},
    **{s: Root("money", "CHF") for s in ("fr.", "fr", "franken", "francs", "franc")},
    **{s: Root("money", "$", -2) for s in ("¢", "cent", "cents")},
    **{s: Root("money", "GBP", -2) for s in ("pence",)},
    **{s: Root("money", "") for s in ("funds",)},
    **{s: Root("count", "1") for s in ("available", "left", "pcs", "pieces", "units", "x")},
    **{s: Root("time", "day") for s in ("day", "days", "tage", "jours", "días")},
    **{s: Root("time", "h") for s in ("h", "hour", "hours")},
    **{s: Root("mass", "g") for s in ("g", "gram", "grams")},
    **{s: Root("mass", "lb") for s in ("lb", "lbs", "pound", "pounds")},
    **{s: Root("length", "m") for s in ("m", "metre", "metres", "meter", "meters")},
    **{s: Root("length", "in") for s in ("in", "inch", "inches", '"')},
    **{s: Root("data", "B") for s in ("b", "byte", "bytes")},
    **{s: Root("rate", "bit/s") for s in ("bps", "bit/s")},
    **{s: Root("power", "W") for s in ("w", "watt", "watts")},
    **{s: Root("charge", "Ah") for s in ("ah",)},
    **{s: Root("frequency", "Hz") for s in ("hz",)},
    **{s: Root("ratio", "%") for s in ("%", "percent")},
}
# One surface may be a root of two dimensions (pound: money or mass); the second reading is kept here.
SECOND: dict[str, Root] = {s: Root("money", "GBP") for s in ("pound", "pounds")}
# Prefixes that name a dollar's or franc's country, and decimal prefixes of measures.
COUNTRY: dict[str, dict[str, str]] = {
    **{p: {"$": "USD"} for p in ("us", "u.s.", "american")},
    **{p: {"$": "CAD", "": "CAD"} for p in ("c", "ca", "cdn", "can", "canadian")},
    **{p: {"$": "AUD", "": "AUD"} for p in ("a", "au", "australian")},
    **{p: {"$": "MXN", "MXN": "MXN"} for p in ("mx", "mexican")},
    **{p: {"CHF": "CHF"} for p in ("s", "sfr", "schweizer", "swiss")},
    **{p: {"JPY": "JPY"} for p in ("japanese",)},
    **{p: {"GBP": "GBP"} for p in ("british", "uk")},
}
METRIC: dict[str, int] = {"n": -9, "µ": -6, "m": -3, "c": -2, "k": 3, "kilo": 3, "M": 6, "mega": 6, "G": 9, "giga": 9, "g": 9, "t": 12, "tera": 12}
SCALES: dict[str, int] = {"k": 3, "grand": 3, "m": 6, "mio": 6, "million": 6}
EXPONENTS = ("²", "³", "^2", "^3", "2", "3")
# Words that may stand around an amount without changing it.
FILLERS = ("price", "prices", "asking", "firm", "obo", "ono", "vb", "shipping", "versand", "incl", "only", "each", "all", "amounts", "amount", "figures", "quoted", "stated", "are", "is", "in", "en", "preis", "prix", "precio", "seller", "s&h")
SEPARATORS = " \t\n,.;:!+-–—()[]/*~|=_' "

#: Prior of each dimension in a field; what isn't named has REST.
FIELD_PRIORS: dict[str, dict[str, float]] = {
    "price": {"money": 0.95},
    "shipping": {"money": 0.93, "time": 0.03},
    "statement": {"money": 0.97},
    "weight": {"mass": 0.95},
    "size": {"length": 0.6, "data": 0.3},
}
REST = 0.004
UNKNOWN_COST, FILLER_COST, PIECE_COST = 6.0, 1.0, 0.4


def _trie(words) -> dict:
    top: dict = {}
    for w in words:
        at = top
        for ch in w:
            at = at.setdefault(ch, {})
        at[""] = w
    return top


_ROOT_TRIE, _PREFIX_TRIE, _FILLER_TRIE = _trie(ROOTS), _trie([*COUNTRY, *METRIC]), _trie([*FILLERS, *SCALES])


def _matches(trie: dict, s: str, i: int):
    at = trie
    while i < len(s) and (at := at.get(s[i])) is not None:
        i += 1
        if "" in at:
            yield at[""], i


def _letter(s: str, i: int) -> bool:
    return 0 <= i < len(s) and s[i].isalpha()


def segment(text: str, field: str) -> list[Group]:
    """The cheapest reading of `text`, as the unit groups in it; fillers and separators leave no group."""
    s = text.lower()
    prior = FIELD_PRIORS.get(field, {})
    n = len(s)
    best: list[tuple[float, tuple[Group, ...]] | None] = [None] * (n + 1)
    best[0] = (0.0, ())

    def offer(j: int, cost: float, groups: tuple[Group, ...]) -> None:
        if best[j] is None or cost < best[j][0]:
            best[j] = (cost, groups)

    def close(i: int, j: int, cost: float, groups, root: Root, unit: str, exp10: int) -> None:
        for word in EXPONENTS:
            if root.dimension not in ("money", "count") and s.startswith(word, j) and not _letter(s, j + len(word)):
                offer(j + len(word), cost + PIECE_COST, (*groups, Group(root.dimension, unit + word.strip("^"), exp10, i, j + len(word))))
        if not (s[j - 1].isalpha() and _letter(s, j)):
            offer(j, cost, (*groups, Group(root.dimension, unit, exp10, i, j)))

    for i in range(n):
        if best[i] is None:
            continue
        cost, groups = best[i]
        if s[i] in SEPARATORS:
            offer(i + 1, cost + 0.01, groups)
        offer(i + 1, cost + UNKNOWN_COST, groups)
        if _letter(s, i) and _letter(s, i - 1):
            continue
        for word, j in _matches(_FILLER_TRIE, s, i):
            if _letter(s, j):
                continue
            if word in SCALES:
                offer(j, cost + PIECE_COST - math.log(prior.get("money", REST)), (*groups, Group("scale", "", SCALES[word], i, j)))
            if word in FILLERS:
                offer(j, cost + FILLER_COST, groups)
        for word, j in _matches(_ROOT_TRIE, s, i):
            for root in filter(None, (ROOTS[word], SECOND.get(word))):
                close(i, j, cost + PIECE_COST - math.log(prior.get(root.dimension, REST)), groups, root, root.unit, root.exp10)
        for pre, j in _matches(_PREFIX_TRIE, s, i):
            k = j
            while pre in COUNTRY and k < n and s[k] in " . ":
                k += 1
            for word, e in _matches(_ROOT_TRIE, s, k):
                root = ROOTS[word]
                for root in filter(None, (root, SECOND.get(word))):
                    country = COUNTRY.get(pre, {}).get(root.unit) if root.dimension == "money" else None
                    if country:
                        close(i, e, cost + 1.5 * PIECE_COST - math.log(prior.get("money", REST)), groups, root, country, root.exp10)
                    elif pre in METRIC and k == j and root.dimension not in ("money", "count", "time", "ratio"):
                        close(i, e, cost + 2 * PIECE_COST - math.log(prior.get(root.dimension, REST)), groups, root, root.unit, METRIC[pre] + root.exp10)
    assert best[n] is not None
    return list(best[n][1])


#: What a shape says: the number it means (from 0), its currency mark ("" none, "$" an open dollar), and a power of ten.
class Reading(NamedTuple):
    kind: str  # "amount", "free" or "none"
    slot: int
    mark: str
    exp10: int


NONE = Reading("none", 0, "", 0)
# Words for "nothing to pay" and for amounts that are still open.
FREE = re.compile(r"\b(?:free|gratis|kostenlos|kostenfrei|gratuit|included|inclusive|inbegriffen|no charge|incluido)\b", re.I)
OPEN = re.compile(r"\b(?:not|excl\w*|ask|varies|calculated|request|offer|trade|swap only)\b", re.I)


def read_shape(shape: str | None, field: str) -> Reading:
    """Read a text whose numbers were replaced by '#'."""
    if not shape:
        return NONE
    parts = shape.split("#")
    found: list[tuple[float, Reading]] = []
    for k in range(len(parts) - 1):
        left, right = parts[k], parts[k + 1]
        if re.search(r"[-−]\s*[^\s\w]{0,3}\s*$", left) and not re.search(r"\w\s*[-−]\s*$", left):
            return NONE  # a negative number
        before = [g for g in segment(left, field) if k == 0 or left[: g.start].strip() or g.dimension == "money"]
        after = segment(right, field)
        close_after = next((g for g in after if not right[: g.start].strip(" ,-–. (")), None)
        exp10 = 0
        if close_after and close_after.dimension == "scale":
            exp10 = close_after.exp10
            rest = [g for g in after if g is not close_after]
            close_after = next((g for g in rest if not right[close_after.end : g.start].strip()), None)
        if close_after and close_after.dimension not in ("money",):
            continue  # a count, a duration or a measure
        money = [g for g in before if g.dimension == "money"][-1:] or ([close_after] if close_after else [])
        if money:
            found.append((2.0 - k * 0.01, Reading("amount", k, money[0].unit, exp10 + money[0].exp10)))
        else:
            found.append((1.0 - k * 0.01, Reading("amount", k, "", exp10)))
    if found and (found[0][1].mark or not FREE.search(shape)):
        return max(found)[1]
    if FREE.search(shape) and not OPEN.search(shape):
        return Reading("free", 0, "", 0)
    return NONE


@lru_cache(maxsize=65536)
def _read(shape: str, field: str) -> tuple:
    return tuple(read_shape(shape, field))


@lru_cache(maxsize=65536)
def _statement(text: str) -> str:
    return next((g.unit for g in segment(text, "statement") if g.dimension == "money" and g.unit not in ("", "$")), "") or ("USD" if any(g.unit == "$" for g in segment(text, "statement")) else "")


_READING = T.StructType([T.StructField("kind", T.StringType()), T.StructField("slot", T.IntegerType()), T.StructField("mark", T.StringType()), T.StructField("exp10", T.IntegerType())])


def _reader(field: str):
    @F.pandas_udf(_READING)
    def read(shape: pd.Series) -> pd.DataFrame:
        codes, uniques = pd.factorize(shape, use_na_sentinel=True)
        rows = [_read(u, field) for u in uniques]
        rows.append(tuple(NONE))  # code -1: no text
        table = pd.DataFrame(rows, columns=["kind", "slot", "mark", "exp10"])
        return table.iloc[codes].reset_index(drop=True)

    return read


@F.pandas_udf(T.StringType())
def _statement_currency(text: pd.Series) -> pd.Series:
    codes, uniques = pd.factorize(text, use_na_sentinel=True)
    table = pd.Series([_statement(u) for u in uniques] + [""], dtype=object)
    return table.iloc[codes].reset_index(drop=True)


_NUMBER = r"[0-9]{1,3}(?:[ '’][0-9]{3})+(?![0-9])(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)*"
_WIDE, _NARROW = "０１２３４５６７８９，．＄￥   #", "0123456789,.$¥    "
#: A statement about the prices: a word for prices, then within one clause a currency.
_STATEMENT = (
    r"(?i)\b(?:prices?|amounts?|figures?|quoted|preise?|prix|precios?|all|stated)\b[^.!?;,\n0-9]{0,40}?"
    r"((?:(?:us|canadian|australian|american|swiss|schweizer|japanese|mexican|british)\s+)?"
    r"\b(?:usd|cad|aud|eur|gbp|mxn|jpy|chf|dollars?|funds|euros?|pounds?|sterling|pesos?|yen|franken|francs?)\b)"
)


def amount_of(run: Column) -> Column:
    """A number as written to decimal(18,4): the last of two kinds of separator is the decimal one; several of
    one kind, or a single one before exactly three final digits, group thousands."""
    t = F.regexp_replace(run, "[ '’]", "")
    dots, commas = (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in ".,")
    plain = (
        F.when((dots > 0) & (commas > 0), F.when(F.instr(F.reverse(t), ".") < F.instr(F.reverse(t), ","), F.replace(t, F.lit(","), F.lit(""))).otherwise(F.translate(F.replace(t, F.lit("."), F.lit("")), ",", ".")))
        .when(dots + commas > 1, F.translate(t, ".,", ""))
        .when(t.rlike(r"^[0-9]+[.,][0-9]{3}$"), F.translate(t, ".,", ""))
        .otherwise(F.translate(t, ",", "."))
    )
    return plain.try_cast("decimal(18,4)")


def _power(exp10: Column) -> Column:
    return F.when(exp10 == 0, F.lit("1").cast("decimal(10,2)")).when(exp10 == -2, F.lit("0.01").cast("decimal(10,2)")).when(exp10 == 3, F.lit("1000").cast("decimal(10,2)")).when(exp10 == 6, F.lit("1000000").cast("decimal(10,2)"))


def hundredths(extra: Column) -> Column:
    """Whether a JSON bag states that numeric amounts count hundredths."""
    unit = F.lower(F.coalesce(F.get_json_object(extra, "$.price_unit"), F.get_json_object(extra, "$.amounts.unit"), F.lit("")))
    said = unit.isin("cents", "cent", "minor", "minor_units", "hundredths") | (F.get_json_object(extra, "$.price_divisor").try_cast("double") == 100)
    note = F.lower(F.coalesce(F.get_json_object(extra, "$.note"), F.lit(""))).rlike("amounts? (?:are|count|in) (?:in )?(?:hundredths|cents|minor units)")
    return F.coalesce(F.when(extra.rlike("(?i)cents|minor|divisor|hundredths"), said | note), F.lit(False))


def money_in_cents(listings: DataFrame, rates: DataFrame) -> DataFrame:
    """Prices and shipping costs of `listings` that aren't plain US dollar numbers, in US cents.

    Args: listings with obs_id, price_raw, price_num, shipping_raw, shipping_num, currency, description, extra
    (further columns are ignored); rates with currency, usd_per_unit (a currency list; joined by size, so
    Spark broadcasts it only under its own threshold).
    Returns (obs_id, amount_field, usd_cents), one row per determinable amount; see TESTDATA.md problem 1.

    Defined edge cases: null or empty texts, NaN, negative numbers, offers to ask and currencies without a
    rate give no row; null `extra` means no statement; amounts of 10**14 and more give no row; rows that
    repeat an obs_id each give their own row; no rows in, no rows out. No shuffle: one scan, one Arrow stage.
    """
    d = listings.select("obs_id", "price_raw", "price_num", "shipping_raw", "shipping_num", "currency", "description", "extra")
    column = F.upper(F.trim("currency"))
    small = hundredths(F.col("extra"))
    # Rows of plain dollars only never reach Python.
    d = d.withColumns({"cur": F.when(column != "", column), "small": small})
    plain = F.coalesce(F.col("cur") == "USD", F.lit(False)) & ~F.col("small")
    d = d.where(F.col("price_raw").isNotNull() | F.col("shipping_raw").isNotNull() | (~plain & (F.col("price_num").isNotNull() | F.col("shipping_num").isNotNull())))
    for f in ("price", "shipping"):
        text = F.translate(F.col(f"{f}_raw"), _WIDE, _NARROW)
        d = d.withColumns({f"{f}_runs": F.when(text.isNotNull(), F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0))), f"{f}_shape": F.regexp_replace(text, _NUMBER, "#")})
    d = d.withColumn("phrase", F.when(F.col("cur").isNull() & F.col("description").isNotNull(), F.nullif(F.regexp_extract("description", _STATEMENT, 1), F.lit(""))))
    d = d.select(
        "obs_id", "price_num", "shipping_num", "price_runs", "shipping_runs", "cur", "small",
        _reader("price")("price_shape").alias("price_read"), _reader("shipping")("shipping_shape").alias("shipping_read"), _statement_currency("phrase").alias("stated"),
    )
    rows = []
    for f in ("price", "shipping"):
        num, read = F.col(f"{f}_num"), F.col(f"{f}_read")
        mark = read["mark"]
        fallback = F.coalesce(F.col("cur"), F.nullif(F.col("stated"), F.lit("")), F.lit("USD"))
        currency = F.when(mark == "$", F.when(F.col("cur").isin("CAD", "AUD"), F.col("cur")).otherwise("USD")).when(mark != "", mark).otherwise(fallback)
        from_num = F.when(~F.isnan(num) & (num >= 0) & ~((currency == "USD") & ~F.col("small")), num.try_cast("decimal(18,4)") * F.when(F.col("small"), _power(F.lit(-2))).otherwise(_power(F.lit(0))))
        from_raw = F.when(read["kind"] == "free", F.lit(0).cast("decimal(28,6)")).when(read["kind"] == "amount", amount_of(F.get(F.col(f"{f}_runs"), read["slot"])) * _power(read["exp10"]))
        rows.append(F.struct(F.lit(f).alias("amount_field"), F.when(num.isNotNull(), from_num).otherwise(from_raw).cast("decimal(28,6)").alias("amount"), currency.alias("currency")))
    d = d.select("obs_id", F.explode(F.array(*rows)).alias("r")).where("r.amount is not null")
    d = d.select("obs_id", "r.amount_field", "r.amount", "r.currency")
    rates = rates.select(F.upper("currency").alias("currency"), F.col("usd_per_unit").cast("decimal(12,8)").alias("rate"))
    cents = F.round(F.col("amount").cast("decimal(24,6)") * F.col("rate") * 100, 0)
    return d.join(rates, "currency").select("obs_id", "amount_field", cents.cast("bigint").alias("usd_cents"))
