"""Text and URL expressions; all JVM-side except entities and compatibility forms, which need `unescape`."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parameters by which links are tracked, by name, by beginning, and by name on hosts of certain shops.
TRACKING = (
    "fbclid", "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "msclkid", "yclid", "twclid", "ttclid", "li_fat_id", "igshid", "igsh", "mc_cid", "mc_eid", "_ga", "_gl", "_hsenc", "_hsmi", "hsctatracking", "mkt_tok", "spm", "scm",
    "ref", "ref_", "irclickid", "irgwc", "clickid", "click_id", "s_kwcid", "ef_id", "_branch_match_id", "_bta_tid", "_bta_c", "wickedid", "rb_clickid", "_openstat", "ncid", "sr_share", "cmpid", "icid", "rdt", "srsltid", "cjevent",
    "cjdata", "zanpid", "ranmid", "raneaa", "ransiteid", "share_id", "si", "epik", "trk", "trkcampaign", "mibextid", "pk_campaign", "pk_kwd", "pk_keyword", "pk_source", "pk_medium", "pk_content", "pk_cid",
)
TRACKING_PREFIXES = ("utm_", "pf_rd_", "pd_rd_", "hsa_", "mtm_", "_hs", "__hs", "oly_", "vero_", "trk_", "ref_", "cm_", "__cft__", "__tn__", "__xts__")
HOST_TRACKING: dict[str, tuple[str, ...]] = {
    "ebay.": ("_trkparms", "_trksid", "hash", "amdata", "itmmeta", "itmprp", "sspagename", "_from", "nordt", "_ul", "ul_noapp"),
    "bestbuy.": ("loc", "acampid", "mpid", "cmp", "lid"),
    "facebook.": ("referral_code", "referral_story_type", "tracking", "rdid", "share_url", "notif_id", "notif_t", "acontext", "aref", "sfnsn"),
    "slickdeals.": ("src", "attrsrc"),
    "walmart.": ("athbdg", "athcpid", "athpgid", "athznid", "athieid", "athstid", "athguid", "athwpid", "athtvid", "athancid", "athena", "adsredirect", "wmlspartner", "affiliates_ad_id", "veh", "sourceid", "wl13"),
    "target.": ("clkid", "afid", "cpng", "lnk", "dpid"),
}
#: Hosts of the shop whose product pages are named by a ten-character number, how that stands in paths, and the parameters kept there.
NUMBERED_HOST = r"(?:^|\.)amazon\.(?:com|ca|co\.uk|de|fr|it|es|co\.jp|com\.au|com\.mx|in|nl|se|pl|sg)$"
NUMBERED_PATH = r"(?i)/(?:dp|gp/product|gp/aw/d|exec/obidos/asin|o/asin)/([A-Z0-9]{10})(?=[/?]|$)"
NUMBERED_KEEP = ("th", "psc", "smid", "m", "tag", "aod")
_BLOCKS = r"(?is)<(script|style|noscript)\b.*?(</\1\s*>|$)"
_COMMENTS = r"(?s)<!--.*?(-->|$)|<!\[CDATA\[|\]\]>"
_BREAKS = r"(?i)</?(br|p|div|li|ul|ol|tr|table|h[1-6]|section|article)\b[^>]*>"
_INVISIBLE = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\u00ad\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\ufeff]"


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """HTML entities resolved twice, trademark signs dropped, compatibility forms folded."""
    return s.map(lambda t: unicodedata.normalize("NFKC", html.unescape(html.unescape(t)).translate({0x2122: None, 0xAE: None, 0xA9: None})) if t else t)


def strip_markup(c: Column) -> Column:
    """Without script and style blocks and comments (unclosed ones run to the end); block tags become line breaks."""

    def strip(x: Column) -> Column:
        out = F.regexp_replace(F.regexp_replace(x, _BLOCKS, " "), _COMMENTS, " ")
        out = F.regexp_replace(F.regexp_replace(out, _BREAKS, "\n"), r"<[^>]{0,2000}>", "")
        return F.when(F.contains(x, F.lit("<")) | F.contains(x, F.lit("]]>")), out).otherwise(x)

    return _bound(c, strip)


def squeeze(c: Column, keep_newlines: bool = False) -> Column:
    c = F.regexp_replace(F.translate(c, "‘’“”–—− ", "''\"\"--- "), _INVISIBLE, "")
    if keep_newlines:
        c = F.regexp_replace(F.regexp_replace(c, r"[^\S\n]+", " "), r" ?\n[ \n]*", "\n")
        return F.trim(F.regexp_replace(c, r"^\n+|\n+$", ""))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def truncate(c: Column, most: int) -> Column:
    """At most `most` characters, cut at a space if there is one in the last 40 %."""

    def cut(x: Column) -> Column:
        head = F.substring(x, 1, most)
        back = F.regexp_extract(head, rf"(?s)^(.{{{int(most * 0.6)},}})\s", 1)
        return F.when(F.length(x) <= most, x).otherwise(F.when(back != "", F.rtrim(back)).otherwise(head))

    return _bound(c, cut)


def clean_text(c: Column, most: int | None = None, keep_newlines: bool = False) -> Column:
    """Markup out, entities resolved, invisible characters out, quotes and dashes folded, white space squeezed.
    Nothing is cut without `most`; with it, input beyond 8 * `most` characters isn't looked at, which bounds the
    work on hostile texts."""
    c = strip_markup(c if most is None else F.substring(c, 1, 8 * most))
    c = F.when(c.rlike("[&\\x{80}-\\x{10ffff}]"), unescape(c)).otherwise(c)
    c = squeeze(strip_markup(c), keep_newlines)
    return c if most is None else truncate(c, most)


def _bound(c: Column, then) -> Column:
    """`then` of a column that is worked out once, however often `then` speaks of it."""
    return F.get(F.transform(F.array(c), then), 0)


def url_parts(u: Column) -> Column:
    """(scheme, host, port, path, query) of an absolute http(s) URL, null for anything else. Scheme and host are lower-case,
    without credentials and final dots, the port is empty where it is the scheme's own; the fragment is gone. `//` and
    `www.` at the start stand for https."""
    t = F.trim(F.regexp_replace(F.trim(u), r"^<+|>+$", ""))
    t = F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).when(F.lower(F.substring(t, 1, 4)) == "www.", F.concat(F.lit("https://"), t)).otherwise(t)
    # One pass of the pattern; what it doesn't fit has no separators.
    cut = F.split(F.regexp_replace(t, r"(?is)^(https?)://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#@\[]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?.*$", "$1\x01$2\x01$3\x01$4\x01$5"), "\x01")
    space = lambda c: F.replace(c, F.lit(" "), F.lit("%20"))

    def parts(m: Column) -> Column:
        scheme, host, port, path = F.lower(F.get(m, 0)), F.regexp_replace(F.lower(F.get(m, 1)), r"\.+$", ""), F.get(m, 2), F.get(m, 3)
        own = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
        out = F.struct(scheme.alias("scheme"), host.alias("host"), F.when(own, "").otherwise(port).alias("port"), space(F.when(path == "", "/").otherwise(path)).alias("path"), space(F.get(m, 4)).alias("query"))
        return F.when((F.size(m) == 5) & (host != "") & (host != "[]"), out)

    return _bound(cut, parts)


def canonical_of(parts: Column) -> Column:
    """The canonical URL of `url_parts`: no tracking parameters, the others as and where they were; product pages of the numbered
    shop are `/dp/NUMBER` with a few parameters."""
    name = lambda p: F.lower(F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1)))
    host = parts["host"]
    own = F.array().cast("array<string>")
    for marker, names in reversed(HOST_TRACKING.items()):
        own = F.when(F.contains(host, F.lit(marker)), F.array(*map(F.lit, names))).otherwise(own)
    begins = "^(?:" + "|".join(TRACKING_PREFIXES) + ")"
    numbered = host.rlike(NUMBERED_HOST)
    keeps = lambda n: F.when(numbered, n.isin(*NUMBERED_KEEP)).otherwise(~n.isin(*TRACKING) & ~n.rlike(begins) & ~F.array_contains(own, n))
    kept = F.filter(F.split(parts["query"], "&"), lambda p: (numbered | (p != "")) & _bound(name(p), keeps))
    kept = F.when(parts["query"] == "", "").otherwise(F.array_join(kept, "&"))
    asin = F.upper(F.regexp_extract(parts["path"], NUMBERED_PATH, 1))
    path = F.when(numbered & (asin != ""), F.concat(F.lit("/dp/"), asin)).otherwise(parts["path"])
    return F.when(parts.isNotNull(), F.concat(parts["scheme"], F.lit("://"), host, F.when(parts["port"] != "", F.concat(F.lit(":"), parts["port"])).otherwise(""), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def canonical_url(u: Column) -> Column:
    """`canonical_of` the parts of a URL. To read its host too, take both from one column of `url_parts`."""
    return _bound(url_parts(u), canonical_of)


def bare_host(parts: Column) -> Column:
    return F.regexp_replace(parts["host"], r"^www\.", "")


def host_of(u: Column) -> Column:
    return bare_host(url_parts(u))


def redact_url(u: Column) -> Column:
    """Credentials and values of secret parameters masked."""
    u = F.regexp_replace(u, r"(?i)^([a-z][a-z0-9+.-]*://)[^/@]*@", "$1***@")
    return F.regexp_replace(u, r"(?i)([?&](?:token|key|api_?key|secret|password|sig|signature|access_token)=)[^&#]*", "$1***")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\*_~`|>\[\]()#])", r"\\$1")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, as chat services count."""
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def safe_text(c: Column, most: int) -> Column:
    """Without NUL, clipped to a column width."""
    return F.substring(F.regexp_replace(c, "\\x00", ""), 1, most)


# Other spellings of stores; stores known by name; short hosts; suffixes of two parts; places that aren't stores.
STORE_ALIASES: dict[str, str] = {
    "amazoncom": "amazon", "amzn": "amazon", "bby": "bestbuy", "bh": "bhphotovideo", "bhphoto": "bhphotovideo", "bandh": "bhphotovideo", "bandhphoto": "bhphotovideo", "bhphotovideocom": "bhphotovideo", "delltechnologies": "dell",
    "hpstore": "hp", "hpinc": "hp", "lgelectronics": "lg", "samsungepp": "samsung", "samsungeppedu": "samsung", "bjswholesale": "bjs", "bjswholesaleclub": "bjs", "officedepotofficemax": "officedepot", "officemax": "officedepot",
    "thehomedepot": "homedepot", "microsoftstore": "microsoft", "googlestore": "google", "applestore": "apple", "walmartcom": "walmart", "targetcom": "target", "neweggcom": "newegg", "microcentercom": "microcenter",
}
STORES = (
    "bestbuy", "newegg", "walmart", "target", "microcenter", "costco", "samsclub", "adorama", "antonline", "woot", "staples", "gamestop", "abt", "crutchfield", "monoprice", "nvidia", "lowes", "kohls", "macys", "asus", "acer", "msi",
    "sony", "lenovo", "qvc", "meh", "zotac", "evga", "gigabyte", "corsair", "nzxt",
)
SHORT_HOSTS = {"amzn.to": "amazon", "a.co": "amazon", "amzn.com": "amazon"}
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "com.au", "net.au", "co.nz", "co.jp", "com.br", "com.mx", "co.in", "com.sg", "co.kr", "com.tr")
NOT_STORES = ("ebay", "facebook", "fb", "offerup", "craigslist", "reddit", "redd", "slickdeals", "mercari", "swappa", "kijiji", "letgo", "nextdoor", "poshmark", "hardwareswap", "imgur", "bit", "tinyurl", "t", "youtube", "youtu", "twitter", "x", "discord")


def _known(c: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), c)


def store_of_host(host: Column) -> Column:
    """The store of a host name, by the label of its registrable domain."""
    h = F.regexp_replace(F.trim(F.regexp_replace(F.lower(host), r"^\.+|\.+$", "")), r"^www\.", "")
    two = lambda labels: F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    domain = lambda labels: _bound(two(labels), lambda t: F.when((F.size(labels) >= 3) & t.isin(*TWO_PART_SUFFIXES), F.concat_ws(".", F.get(labels, F.size(labels) - 3), t)).otherwise(t))
    named = lambda d: _bound(F.regexp_replace(F.substring_index(d, ".", 1), "[^a-z0-9]+", ""), lambda label: F.nullif(F.coalesce(_known(d, SHORT_HOSTS), _known(label, STORE_ALIASES), label), F.lit("")))
    return _bound(F.filter(F.split(h, r"\."), lambda x: x != ""), lambda labels: _bound(domain(labels), named))


def store_name(c: Column) -> Column:
    """A store's key: letters and digits only, other spellings and host names folded; null for empty names."""
    stores = tuple(sorted({*STORES, *STORE_ALIASES.values()}))

    def of_key(key: Column) -> Column:
        return F.coalesce(_known(key, STORE_ALIASES), _bound(F.regexp_extract(key, "^(.+?)(?:com|net|us|ca)$", 1), lambda base: F.coalesce(_known(base, STORE_ALIASES), F.when(base.isin(*stores), base))), key)

    def of_name(t: Column) -> Column:
        hostlike = t.rlike(r"^(?:https?://)?(?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)+(?:/\S*)?$")
        return F.when(hostlike, store_of_host(F.regexp_extract(t, r"^(?:https?://)?([a-z0-9.-]+)", 1))).otherwise(_bound(F.regexp_replace(t, "[^a-z0-9]+", ""), of_key))

    return F.nullif(_bound(F.lower(F.trim(c)), of_name), F.lit(""))


def cluster_identity(kind: Column, retailer: Column, url: Column) -> Column:
    """The store by which offers of different sources are taken together: of the retailer's name, else of the URL; null
    for what isn't a shop's or an aggregator's offer, and for places where anyone sells."""
    store = F.coalesce(store_name(retailer), _bound(url_parts(url)["host"], store_of_host))
    return _bound(store, lambda x: F.when(kind.isin("retail", "aggregator") & ~x.isin(*NOT_STORES), x))


# Condition classes of platform codes, by first and last code.
CONDITION_CODES: tuple[tuple[int, int, str], ...] = ((1000, 1499, "new"), (1500, 1999, "open_box"), (2000, 2749, "refurbished"), (2750, 6999, "used"), (7000, 7000, "for_parts"))
# Words of conditions in structured fields; the first rule that fits counts.
CONDITION_WORDS: tuple[tuple[str, str], ...] = (
    ("for_parts", r"\b(?:for parts|parts only|parts or repair|not working|non working|salvage)\b"),
    ("refurbished", r"\b(?:refurb\w*|renewed|reconditioned|remanufactured|re ?certified)\b"),
    ("open_box", r"\b(?:open ?box|opened box|new other|new with defects|new without box|new no box|damaged box)\b"),
    ("used", r"(?<!never )(?<!not )\bused\b|\b(?:pre ?owned|second ?hand|like new|gently used|lightly used|normal wear)\b"),
    ("new", r"\b(?:new|brand new|bnib|nib|nisb|nwt|bnwt|sealed|factory sealed|unopened)\b"),
    ("used", r"\b(?:very good|good|acceptable|fair|excellent|mint|poor|worn|collectible)\b"),
)
# Wordings of conditions in free text, and what takes a wording back.
_DENIED = r"(?<!\b(?:not|no|never|non|without|(?:is|was|are|were|do|does|did|has|have|had)n'?t)[\s-]{1,3}(?:[a-z']{1,20}\s{1,3})?)"


def _hint(words: str) -> str:
    """Words that begin here; only where they do is looked for what takes them back."""
    return rf"(?<![a-z0-9_])(?={words}){_DENIED}{words}"


CONDITION_HINTS: dict[str, str] = {
    "for_parts": _hint(r"(?:for[\s-]+parts|parts(?:[\s-]+only|\s*/\s*repair))\b"),
    "refurbished": _hint(r"(?:refurb(?:ished)?|renewed|reconditioned|remanufactured|recertified)\b"),
    "open_box": _hint(r"(?:open[\s-]?box(?:ed)?|opened|box\s+(?:was\s+|has\s+been\s+)?opened|new\s+other|new\s+with\s+defects)\b"),
    "used": _hint(r"(?:(?<!\bbe\s)used|pre[\s-]?owned|second[\s-]?hand|like[\s-]new)\b"),
    "new": _hint(r"(?:brand[\s-]new|b?nib|nisb|b?nwt|new\s+in\s+(?:the\s+)?(?:sealed\s+)?box|factory[\s-]sealed|new\s+sealed|(?<!\bre[\s-])sealed|unopened)\b"),
}
#: A bare "new" counts in titles only, and not where it speaks of something else.
_BARE_NEW = _hint(r"new\b(?<!\b(?:like|near|almost|as|pretty|basically)[\s-]new)(?!\s+(?:other|with\s+defects)\b)(?![\s-]*(?:to\s+me|thermal|pads?|paste|fans?|cooler|price|listing|account|in\s+town|ish)\b)")
#: Classes from the safest (the one of the lowest prices) on.
_SAFEST = ("for_parts", "used", "refurbished", "open_box", "new")


def condition_of(c: Column) -> Column:
    """The class of a structured condition value, a code or words; null if it says nothing."""
    t = F.trim(c)
    code = F.when(t.rlike("^[0-9]{4}$"), t.try_cast("int"))
    words = F.trim(F.regexp_replace(F.lower(t), "[^0-9a-z]+", " "))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CONDITION_WORDS):
        out = F.when(words.rlike(pattern), name).otherwise(out)
    by_code = F.lit(None).cast("string")
    for first, last, name in CONDITION_CODES:
        by_code = F.when(code.between(first, last), name).otherwise(by_code)
    return F.when(t.rlike("^[0-9]+$"), by_code).otherwise(out)


#: A cheap test: no hint is possible without one of these.
_MAY_HINT = "parts|refurb|renewed|recond|reman|recert|open|used|owned|hand|like|new|nib|nisb|nwt|sealed"


def condition_hints(title: Column, text: Column | None = None) -> Column:
    """The classes that a text speaks of, as an array; `text` goes on after the title."""

    def said(x: Column) -> Column:
        low, bare = x["low"], x["title"].rlike(_BARE_NEW)
        hits = [F.when(low.rlike(p) | bare if name == "new" else low.rlike(p), F.lit(name)) for name, p in CONDITION_HINTS.items()]
        return F.when(low.rlike(_MAY_HINT), F.filter(F.array(*hits), lambda h: h.isNotNull())).otherwise(F.array().cast("array<string>"))

    return _bound(F.struct(F.lower(title if text is None else F.concat_ws("\n", title, text)).alias("low"), F.lower(title).alias("title")), said)


def _safest(classes: Column) -> Column:
    """The safest of an array of classes; null for none."""
    return F.get(F.filter(F.array(*map(F.lit, _SAFEST)), lambda x: F.array_contains(classes, x)), 0)


def parse_condition(raw: Column, kind: Column, title: Column, text: Column | None = None) -> Column:
    """The class of a listing: the structured value counts, and its title can only lower it. Without one, offers of shops and
    aggregators are new unless their text lowers that; others are used unless it says new (lowered to what else
    it says). Where the kind is none of these, the safest hint, else `unknown`."""
    both = F.struct(condition_of(raw).alias("base"), condition_hints(title).alias("own"), (condition_hints(title) if text is None else condition_hints(title, text)).alias("all"), kind.alias("kind"))

    def decide(x: Column) -> Column:
        has = lambda c: F.array_contains(x["all"], c)
        down = lambda base, hints: _safest(F.concat(F.array(base), F.filter(hints, lambda h: h != "new")))
        private = F.when(has("used") | ~has("new"), "used").when(has("refurbished"), "refurbished").when(has("open_box"), "open_box").otherwise("new")
        free = F.when(has("for_parts"), "for_parts").when(x["kind"].isin("retail", "aggregator"), down(F.lit("new"), x["all"])).when(x["kind"].isin("local", "marketplace"), private).otherwise(F.coalesce(_safest(x["all"]), F.lit("unknown")))
        return F.when(x["base"].isNotNull(), down(x["base"], x["own"])).otherwise(free)

    return _bound(both, decide)
