"""Listings of the same product from different sellers.

Each listing is parsed once: standard identifiers (GTIN) with their check digit, the maker's part number
wherever it stands and however it is spelled, the model (series, number, suffix) and the main capacity, size or
form in common units. Reliable keys made of these join listings; a connected component is guarded: an edge
counts only while the attributes both ends state agree, so that a shared shop number or a part number of few
letters can't chain different products together.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.components import components
from marketloom.tables import cut_lineage, spread

# Words of product classes, and the class's suffix codes in part numbers.
CLASSES: dict[str, str] = {
    "gpu": r"graphics (?:card|adapter)|video card|\bgpu\b",
    "ssd": r"\bssd\b|\bnvme\b|solid state drive",
    "hdd": r"hard dis[kc]|hard drive|\bhdd\b",
    "ram": r"\bddr[3-6] ?(?:ram|memory)|memory kit|desktop ram|\bram\b",
    "psu": r"power supply|\bpsu\b",
    "monitor": r"monitor|led screen|ips display",
    "board": r"motherboard|mainboard|system board",
    "router": r"router",
    "bank": r"power bank|portable charger|battery pack",
}
_CLASS = {k: re.compile(v) for k, v in CLASSES.items()}
SUFFIXES = {"pro": "pr", "max": "ma", "lite": "li", "x": "x", "s": "s"}
_UNITS = r"(?:mb|gb|tb|g|gig|gigabytes?|terabytes?|megabytes?|mhz|hz|mt|w|watts?|kw|mah|ah|rpm|bit|mbps|gbps|mbit|gbit|in|inch|cm|ms|v|slots?|ports?|year|x)"
_MODEL = re.compile(rf"(?<![\w-])([a-z]{{4,12}})[ -]?([0-9]{{2,6}})(?![0-9.,]*[0-9])(?:[ -]?(pro|max|lite|x|s)(?![\w]))?(?![- ]?(?:{_UNITS}\b|[\"″+]))")
#: Words that stand before numbers without being a series.
_NO_SERIES = re.compile(r"^(?:cache|router|profile|channel|supply|warranty|modular|card|adapter|screen|monitor|drive|disk|memory|watt|gigabyte|terabyte|price|year|ports?|slot|number|about|from|exit|with|model|version|chip|gen|wifi|pcie|ddr|tech)$")
_PACKED = re.compile(r"(?<![a-z0-9])([a-z]{2})[- ]?([a-z]{3})([0-9]{3,5})(?:(pr|ma|li|x|s)[- ]?|[- ]?)([0-9]{1,5}|matx|atx|itx)(?![a-z0-9])")
_NUM = r"([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+(?:\.[0-9]+)?)"
_CAPACITY: dict[str, re.Pattern] = {
    "data": re.compile(rf"(?<![\w.,]){_NUM}[ -]?(tb|terabytes?|gb|gigabytes?|gig|g|mb|megabytes?)(?![\w/])(?! ?(?:cache|wan|be\b|/s))"),
    "psu": re.compile(rf"(?<![\w.,]){_NUM}[ -]?(w|watts?|kw|kilowatts?)(?![\w])"),
    "monitor": re.compile(rf"(?<![\w.,]){_NUM}[ -]?(inch(?:es)?|in|\"|″|cm)(?![\w])"),
    "router": re.compile(rf"(?<![\w.,]){_NUM}[ -]?(mbps|mbit/s|gbps|gbit/s)(?![\w])"),
    "board": re.compile(r"(?<![\w])(?:()(micro[- ]?atx|m-?atx|mini[- ]?itx|itx|full atx|atx))(?![\w])"),
    "bank": re.compile(rf"(?<![\w.,]){_NUM}[ -]?(mah|ah)(?![\w])"),
}
_SAYS = re.compile(r"^(?:spec|version|capacity|size|form|variant|storage|option)s?:|^this is the |\bmodel$|\bversion$")


def gtin_valid(digits: str) -> bool:
    """Whether a GTIN-8, -12, -13 or -14 has its check digit."""
    if len(digits) not in (8, 12, 13, 14) or not digits.isdigit() or not int(digits):
        return False
    total = sum(int(c) * (3 if k % 2 == 0 else 1) for k, c in enumerate(reversed(digits[:-1])))
    return (10 - total % 10) % 10 == int(digits[-1])


_GTIN = re.compile(r"(?:\b(?:gtin|ean|upc|isbn)(?:-?1[0-9])?\b[ :#]*)([0-9]{8,14})\b")


_SPACES = re.compile(r"\s+")


def clean(text: str | None) -> str:
    t = text or ""
    if "&" in t:
        t = html.unescape(html.unescape(t))
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
    return _SPACES.sub(" ", t).strip().lower()


def class_of(title: str) -> str | None:
    return next((k for k, p in _CLASS.items() if p.search(title)), None)


def _value(kind: str, number: str, unit: str) -> str | None:
    if kind == "board":
        u = unit.replace("-", "").replace(" ", "")
        return "matx" if u in ("microatx", "matx") else "itx" if u.endswith("itx") else "atx"
    v = float(number.replace(",", ""))
    if kind in ("gpu", "ram"):
        v = v / 1024 if unit[0] == "m" else v * 1024 if unit[0] == "t" else v
    elif kind in ("ssd", "hdd"):
        v = v / 1000 if unit[0] == "m" else v * 1000 if unit[0] == "t" else v
    elif kind == "psu":
        v = v * 1000 if unit[0] == "k" else v
    elif kind == "monitor":
        v = round(v / 2.54) if unit == "cm" else v
    elif kind == "router":
        v = v * 1000 if unit[0] == "g" else v
    elif kind == "bank":
        v = v * 1000 if unit == "ah" else v
    return f"{v:g}" if v < 1e6 else str(int(v))


#: Plausible main capacities of a class, in its own unit; what lies outside is an attribute, not the capacity.
_RANGE = {"gpu": (1, 128), "ram": (2, 1024), "ssd": (60, 64000), "hdd": (160, 64000), "psu": (200, 3000), "monitor": (10, 100), "router": (50, 50000), "bank": (500, 100000)}


def capacities(kind: str | None, text: str) -> list[str]:
    if kind is None:
        return []
    p = _CAPACITY["data" if kind in ("gpu", "ram", "ssd", "hdd") else kind]
    out = []
    for m in p.finditer(text):
        if kind == "board":
            out.append(_value(kind, "", m.group(2)))
            continue
        v = _value(kind, m.group(1), m.group(2))
        lo, hi = _RANGE[kind]
        if lo <= float(v) <= hi and float(v) * 4 == int(float(v) * 4):
            out.append(v)
    return out


class Listing(NamedTuple):
    kind: str | None  # product class
    series: str | None
    number: str | None
    suffix: str  # code, "" none
    capacity: str | None
    brand: str | None  # first two letters of a part number, or None
    letters: str | None  # the letters of the series in the part number, in order of the alphabet
    shop_number: str | None
    gtin: str | None


def _models(text: str) -> list[tuple[str, str, str, int]]:
    out = []
    for m in _MODEL.finditer(text):
        if not _NO_SERIES.search(m.group(1)):
            out.append((m.group(1), m.group(2), SUFFIXES.get(m.group(3) or "", ""), m.start()))
    return out


_TAIL = re.compile(r"(?<![a-z0-9])([a-z]{2})[- ]?([a-z]{3})([0-9]{2,11}(?:pr|ma|li|x|s)?[0-9]{0,6}(?:[- ]?(?:[0-9]{1,6}|m?atx|itx))?)(?![a-z0-9])")
_REST = re.compile(r"[0-9]{1,6}|matx|atx|itx")


def _split_part(text: str, number: str | None, suffix: str) -> tuple[str, str, str | None] | None:
    """(brand letters, series letters, capacity) of a part number of a known model, in any spelling."""
    if number is None or number not in text:
        return None
    head = number + suffix
    for brand, series, tail in _TAIL.findall(text):
        if tail.startswith(head):
            rest = tail[len(head) :].lstrip("- ")
            if not rest:
                return brand, series, None
            if _REST.fullmatch(rest):
                return brand, series, rest
    return None


_GTIN_HINT = re.compile(r"gtin|ean|upc|isbn", re.I)


def parse(title: str | None, description: str | None, sku: str | None) -> Listing:
    """Attributes of one listing. The description is read only for what title and part number leave open."""
    t, s = clean(title), clean(sku)
    kind = class_of(t)
    without_parts = _PACKED.sub(" ", t)
    models = _models(without_parts) or _models(t)
    series, number, suffix = max(models, key=lambda m: len(m[1]) > 2)[:3] if models else (None, None, "")
    part = _split_part(s, number, suffix) or _split_part(t, number, suffix)
    if part is not None and series is not None and not (series[0] == part[1][0] and (sorted(series[:3]) == sorted(part[1]) or series[:2] == part[1][:2] or series[2:3] == part[1][1])):
        part = None
    found = capacities(kind, without_parts)
    capacity = found[0] if found else part[2] if part else None
    if capacity is None and kind and description:
        d = clean(description.replace("\n", ". "))
        for sentence in re.split(r"(?<=[.!?])\s+", d):
            x = sentence.strip(" .!")
            named = number is not None and number in x and any(m[1] == number and m[0][0] == series[0] for m in _models(x))
            if named or _SAYS.search(x):
                if hit := capacities(kind, x[x.index(number) + len(number) :] if named else x):
                    capacity = hit[0]
                    break
    shop = s if len(s) >= 5 and s.isdigit() and int(s) else None
    texts = [x for x in (title, description) if x and _GTIN_HINT.search(x)]
    gtin = next((g for x in texts for g in _GTIN.findall(clean(x)) if gtin_valid(g)), None) or (s if len(s) in (12, 13, 14) and gtin_valid(s) else None)
    return Listing(kind, series, number, suffix, capacity, part[0] if part else None, "".join(sorted(part[1])) if part else None, shop, gtin)


def model_key(p: Listing) -> str | None:
    """The reliable key of a fully described product: class, number, suffix, capacity, series."""
    if None in (p.kind, p.series, p.number, p.capacity):
        return None
    return "|".join((p.kind, p.number.lstrip("0"), p.suffix, p.capacity, p.series))


_PARSED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("origin", T.LongType()),
        T.StructField("model", T.LongType()),
        T.StructField("block", T.LongType()),
        T.StructField("series", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("number", T.StringType()),
        T.StructField("suffix", T.StringType()),
        T.StructField("capacity", T.StringType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
    ]
)


def parsed(items: DataFrame, key: Column, origin: Column) -> DataFrame:
    """One row per listing: hashes of its model key and of that without the series (block), its attributes, and
    hashes of its other reliable keys (GTIN, part number, shop and shop number). Odd hashes are of keys that makers give."""
    import xxhash

    h = lambda *xs: xxhash.xxh64_intdigest("\x1f".join(xs)) - (1 << 63)
    maker, shops = lambda *xs: h(*xs) | 1, lambda *xs: h(*xs) & ~1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for title, description, sku, shop in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                p = parse(title, description, sku)
                m = model_key(p)
                keys = []
                if p.gtin:
                    keys.append(maker("gtin", p.gtin.zfill(14)))
                if p.brand and p.number:
                    keys.append(shops("part", p.brand, (p.series or "")[:1], p.number, p.suffix, p.capacity or ""))
                    keys.append(maker("number", p.brand, p.letters or "", p.number, p.suffix, p.capacity or ""))
                if p.shop_number and shop:
                    keys.append(shops("shop", shop.strip().lower(), p.shop_number))
                for c, v in zip(cols, (None if m is None else h("model", m), None if m is None else h("block", m.rpartition("|")[0]), p.series, p.brand, p.kind, p.number, p.suffix if p.number else None, p.capacity, keys), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *[pa.string()] * 6, pa.list_(pa.int64())), strict=True))], names=[f.name for f in _PARSED])

    return spread(items.select(key.cast("long").alias("id"), origin.alias("origin"), "title", "description", "sku", "retailer")).mapInArrow(run, _PARSED)


def _agree(a: str, b: str) -> Column:
    """The guard: no attribute that both ends state differs."""
    out = F.lit(True)
    for c in ("kind", "number", "suffix", "capacity"):
        x, y = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        out = out & (x.isNull() | y.isNull() | (x == y))
    return out


def misspelt_models(full: DataFrame) -> DataFrame:
    """(a, b): models of one block whose series are one slip of the keyboard apart (a letter left out or doubled
    inside, two neighbours swapped) and whose brands agree. A letter more or less at the end makes another
    series, as does another letter. Models are first brought to one row each, so that the join within a
    block is over different spellings only."""
    models = full.groupBy("block", "model", "series").agg(F.min("brand").alias("least"), F.max("brand").alias("most"))
    a, b = (models.select("block", *(F.col(c).alias(f"{c}_{x}") for c in ("model", "series", "least", "most"))) for x in "ab")
    p, q = F.col("series_a"), F.col("series_b")
    letters = lambda c: F.array_sort(F.split(c, ""))
    one_off = (F.abs(F.length(p) - F.length(q)) == 1) & (F.levenshtein(p, q) == 1) & ~p.startswith(q) & ~q.startswith(p)
    swapped = (F.length(p) == F.length(q)) & (F.levenshtein(p, q) == 2) & (letters(p) == letters(q))
    brands = F.col("least_a").isNull() | F.col("least_b").isNull() | ((F.col("least_a") == F.col("most_b")) & (F.col("most_a") == F.col("least_b")))
    return a.join(b.hint("merge"), "block").where((F.col("model_a") < F.col("model_b")) & (F.substring(p, 1, 1) == F.substring(q, 1, 1)) & (one_off | swapped) & brands).select(F.col("model_a").alias("a"), F.col("model_b").alias("b"))


_STATED = ("kind", "number", "suffix", "capacity")


def shared_numbers(full: DataFrame) -> DataFrame:
    """(a, b): models of fully described listings that share a key given by the maker and agree in all but the series, whose
    spelling may differ in any way. A star per key and set of attributes keeps edges in proportion to the models."""
    at = full.select("model", *_STATED, F.explode("keys").alias("key")).where(F.col("key").bitwiseAND(F.lit(1)) == 1).distinct()
    star = at.groupBy("key", *_STATED).agg(F.min("model").alias("b"), F.max("model").alias("most")).where("b <> most")
    return at.join(star.hint("merge"), ["key", *_STATED]).where("model <> b").select(F.col("model").alias("a"), "b").distinct()


def loose_links(loose: DataFrame) -> DataFrame:
    """(a, b): listings that share a key and whose attributes agree, as a star per key and set of stated attributes, and
    edges from each set that leaves something open to the others of its key that it agrees with, if these
    agree among themselves; one that fits products that differ joins none and is joined by none."""
    same = loose.groupBy("key", *_STATED).agg(F.min("id").alias("rep"))
    on = [F.col("l.key") == F.col("s.key"), *(F.col(f"l.{c}").eqNullSafe(F.col(f"s.{c}")) for c in _STATED)]
    within = loose.alias("l").join(same.hint("merge").alias("s"), on).where("l.id <> s.rep").select(F.col("l.id").alias("a"), F.col("s.rep").alias("b"))
    open_ = same.where(" or ".join(f"{c} is null" for c in _STATED))
    fits = open_.alias("o").join(same.hint("merge").alias("f"), (F.col("o.key") == F.col("f.key")) & (F.col("o.rep") != F.col("f.rep")) & _agree("o", "f"))
    fits = cut_lineage(fits.select(F.col("o.key").alias("key"), F.col("o.rep").alias("a"), F.col("f.rep").alias("b"), *(F.col(f"f.{c}").alias(c) for c in _STATED)))
    differ = F.lit(False)
    for c in _STATED:
        differ = differ | (F.min(c) != F.max(c))
    torn = fits.groupBy("key", "a").agg(F.coalesce(differ, F.lit(False)).alias("torn")).where("torn").select("key", "a")
    sure = fits.select("key", "a", "b").join(torn.hint("merge"), ["key", "a"], "left_anti").join(torn.withColumnRenamed("a", "b").hint("merge"), ["key", "b"], "left_anti")
    return within.unionByName(sure.select("a", "b")).distinct()


def product_classes(listings: DataFrame) -> DataFrame:
    """(id, origin, class) of `parsed` listings that belong to a known product.

    A fully described listing's class is the component of its model, its misspellings and the models that share its maker's
    number. One that leaves something open joins the only class that its reliable keys lead to and its own attributes
    agree with; those that lead to none form guarded components among themselves, over listings that share a
    key and agree.
    """
    full = listings.where("model is not null")
    slips = cut_lineage(misspelt_models(full).unionByName(shared_numbers(full)))
    if not slips.isEmpty():
        labels = components(slips).select(F.col("node").alias("model"), "label")
        full = full.join(labels.hint("merge"), "model", "left").withColumn("model", F.coalesce("label", "model")).drop("label")
    open_ = listings.where("model is null and size(keys) > 0").select("*", F.explode("keys").alias("key"))
    known = full.select("model", *_STATED, F.explode("keys").alias("key")).join(open_.select("key").distinct().hint("merge"), "key", "left_semi").distinct()
    led = open_.alias("o").join(known.hint("merge").alias("f"), (F.col("o.key") == F.col("f.key")) & _agree("o", "f"))
    led = led.groupBy("o.id", "o.origin").agg(F.min("f.model").alias("class"), F.max("f.model").alias("other"))
    led = cut_lineage(led)
    joined = led.where(F.col("class") == F.col("other")).select("id", "origin", "class")
    loose = open_.join(led.select("id").distinct().hint("merge"), "id", "left_anti")
    out = full.select("id", "origin", F.col("model").alias("class")).unionByName(joined)
    loose = cut_lineage(loose.select("id", "origin", *_STATED, "key"))
    edges = cut_lineage(loose_links(loose))
    if edges.isEmpty():
        return out
    labels = components(edges)
    return out.unionByName(loose.select("id", "origin").distinct().join(labels.withColumnRenamed("node", "id").hint("merge"), "id").select("id", "origin", F.xxhash64(F.lit("loose"), "label").alias("class")))


def same_product_classes(items: DataFrame, key: str = "item_id", origin: tuple[str, ...] = ("source", "source_id")) -> DataFrame:
    """(key, class_id): listings that belong to a known product, whether or not others do. Edge cases as in
    `same_product_pairs`."""
    where = F.xxhash64(*(F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in origin))
    p = parsed(items.where(F.col(key).isNotNull()), F.col(key), where).persist()
    c = cut_lineage(product_classes(p))
    p.unpersist()
    return c.select(F.col("id").alias(key), "origin", F.col("class").alias("class_id"))


def same_product_pairs(items: DataFrame, key: str = "item_id", origin: tuple[str, ...] = ("source", "source_id")) -> DataFrame:
    """(key_a, key_b), a < b: listings of different origin that offer the same product.

    Defined edge cases: a null key gives no pair; listings without a model or a usable key give none; null
    parts of the origin equal each other only; null or empty title, description or sku state nothing; repeated
    rows of one origin make no pair; no rows give no pairs; clashing extra columns don't matter.
    """
    c = same_product_classes(items, key, origin)
    a, b = (c.select("class_id", F.col(key).alias(x), F.col("origin").alias(f"o{x}")) for x in "ab")
    return a.join(b.hint("merge"), "class_id").where("a < b and oa <> ob").select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"))
