"""Template residue, filler and error pages instead of content.

Unfilled placeholders are found by one small grammar per delimiter pair (`PLACEHOLDERS`), filler and
error or script notices by patterns. A hit counts by the share of the text it covers: a placeholder
that makes up much of a sentence is residue, one that a sentence talks about is not, and sentences
whose words show that they explain a syntax (`TUTORIAL`), or fenced and indented code, are left out.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_NAME = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"
# One grammar per delimiter pair.
PLACEHOLDERS: dict[str, str] = {
    "{{ }}": rf"\{{\{{[#/&^>!]?\s*{_NAME}(?:\s*\|\s*{_NAME})*\s*\}}\}}",
    "{% %}": r"\{%[^{}]+?%\}",
    "<% %>": r"<%[^<>]+?%>",
    "${ }": rf"[$#@]\{{\s*{_NAME}\s*\}}",
    "{ }": rf"(?<![{{$#@%])\{{(?:{_NAME}|[0-9])\}}(?!\}})",
    "[[ ]]": rf"\[\[\s*{_NAME}\s*\]\]",
    "[ ]": r"(?<!\[)\[(?:[A-Z][A-Z0-9]*(?:[_. ][A-Z0-9]+)*|[a-z]+(?:[_.][a-z0-9]+)+|brand|model|title|name|sku|seller|category|price|product|item|city|customer)\](?!\])",
    "(( ))": rf"\(\(\s*{_NAME}\s*\)\)",
    "%% %%": rf"%%\s*{_NAME}\s*%%",
    "% %": r"(?<![%\w])%[A-Z][A-Z0-9_]*(?:\.[A-Z0-9_]+)*%(?!%)",
    "%( )s": rf"%\({_NAME}\)[sdifr]",
    "@@ @@": rf"@@{_NAME}@@",
    "__ __": r"(?<![A-Za-z0-9_])__[A-Za-z][A-Za-z0-9_.]*?__(?![A-Za-z0-9_])",
    "*| |*": rf"\*\|{_NAME}\|\*",
    "$ $": rf"(?<![\w$])\${_NAME}\$(?![\w$])",
    "< >": r"<(?:[A-Z][A-Z0-9_.]*(?: [A-Z]+)*|[a-z]+(?:[_.][a-z0-9]+)+|brand|model|title|name|sku|seller|category|product|item)>",
    "<!-- -->": r"<!--(?:(?!<!--)[\s\S])*?-->",
    "values": r"\[object Object\]|\bNaN\b|\b(?:undefined|null)(?: (?:undefined|null))+\b",
}
_PLACEHOLDER = re.compile("|".join(PLACEHOLDERS.values()))
# The vocabulary of the usual Latin filler text.
_LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
#: Orders to whoever was to write the text.
_FILLER = re.compile(
    r"\b(?:insert|add|enter|write|put)\s+(?:your\s+|a\s+|the\s+)?(?:\w+\s+){0,2}?(?:description|title|text|copy|name|bullet points?|content)\b(?:\s+(?:here|before launch|later))?[.… ]*"
    r"|\b(?:\w+\s+){0,2}?(?:description|title|text|copy|content)\s+(?:goes here|here|coming soon|to follow|to come)\b[. ]*"
    r"|\b(?:todo|tbd|fixme)\b[: ]*(?:(?:write|add|insert|bullet|points?|product|marketing|short|title|description|text|copy|here|before|launch)\b[ .]*)*"
    r"|\bplaceholder (?:copy|text|title|description)(?: for (?:item|product|title))?\b[. ]*"
    r"|\b(?:sample|test|dummy|example) (?:product|item|listing|text|title)\b(?:\s*-?\s*do not (?:publish|buy|use|order))?[. ]*"
    r"|\bbefore launch\b",
    re.I,
)
# The rows of the keyboard, and the same from the right.
_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "poiuytrewq", "lkjhgfdsa", "mnbvcxz")
# Notices that take the place of a page, by kind.
NOTICES: dict[str, tuple[str, ...]] = {
    "script": (
        r"(?:please )?(?:enable|activate|turn on) (?:java ?scripts?|scripts?|cookies)[\w ,]{0,40}",
        r"(?:this|the|our|your) (?:site|page|app|store|browser) (?:requires|must support|needs) (?:java ?script|scripts?)[\w ]{0,20}\.?(?: refresh after enabling it)?",
        r"we'?re sorry but [\w .-]{1,40} doesn'?t work properly without (?:java ?)?scripts?(?: enabled)?",
        r"you need to (?:enable|turn on|activate) (?:java ?)?scripts?[\w ]{0,30}",
        r"scripting appears to be (?:switched|turned) off[\w ]{0,30}",
        r"(?:java ?)?scripts? (?:is|are|appears? to be) (?:disabled|blocked|(?:switched|turned) off)[\w ]{0,30}",
        r"bitte aktivieren sie java ?script[\w ]{0,30}",
        r"(?:veuillez )?activez? java ?script[\w ]{0,30}",
        r"habilite java ?script[\wá ]{0,30}",
        r"active java ?script para[\wá ]{0,30}",
    ),
    "wall": (
        r"are you (?:a )?(?:robot|human)\??(?: press and hold\.?)?",
        r"(?:please )?(?:verify|confirm|prove) (?:that )?you(?:'re| are) (?:a |not a )?(?:human|robot)[\w ]{0,20}",
        r"checking your (?:connection|browser)[\w, ]{0,40}",
        r"pardon (?:our|the) interruption",
        r"our systems? (?:have )?(?:noticed|detected) unusual traffic[\w ]{0,40}",
        r"access to this page has been denied",
        r"(?:your )?(?:request|access|ip)(?: has been| was)? (?:blocked|denied)\.?(?: incident \w+)?",
        r"too many requests\.?(?: slow down\.?)?",
    ),
    "error": (
        r"(?:[45][0-9]{2} )?(?:forbidden|bad gateway|not found|bad request|unauthorized|gateway time-?out|service (?:temporarily )?unavailable|internal server error|too many requests)",
        r"(?:error )?[45][0-9]{2}",
        r"upstream request timeout",
        r"no healthy upstream",
        r"something went wrong(?: on our end)?",
        r"session expired,? (?:please )?sign in again",
        r"the page (?:you are looking for|you requested|requested) (?:could not be|cannot be|was not) found",
        r"(?:oops|sorry),? (?:an error occurred|something went wrong)",
        r"wartungsarbeiten(?: - bitte später erneut versuchen)?",
        r"(?:we are )?(?:down for|under) maintenance[\w, ]{0,30}",
    ),
}
_NOTICE = re.compile("|".join(rf"(?<!\w)(?:{p})(?!\w)" for ps in NOTICES.values() for p in ps), re.I)
#: Words of a sentence that explains a syntax instead of having failed to fill it.
TUTORIAL = re.compile(r"\b(?:macros?|templat(?:e|es|ing)|variables?|syntax|placeholders? (?:is|are|frames)|brackets|manual|editor|language|firmware|regex|escape[sd]?|snippet|example code|keypad)\b", re.I)
_CODE = re.compile(r"```.*?(?:```|$)|(?m:^(?: {4}|\t).*$)", re.S)

#: A placeholder is residue from this share of its sentence on (the second where it could be a plain word in
#: brackets); filler and notices from these of the whole text.
#: A body that isn't JSON is judged with all it shows, so that half suffices.
SENTENCE_SHARE, WEAK_SHARE, FILLER_SHARE, NOTICE_SHARE, BODY_SHARE = 0.15, 0.3, 0.6, 0.8, 0.5
_WEAK = re.compile(r"\{(?!(?:brand|model|title|name|sku|seller|category|price|product|item|city|customer|store)\})[a-z]+\}")
#: Cheap tests: no hit of a pattern is possible without these.
_MAY_HOLD = re.compile(r"[{\[<%$#@*(]|__|NaN|undefined|null")
_SAY = ("script", "cookie", "robot", "human", "connection", "browser", "interruption", "traffic", "denied", "blocked", "request", "forbidden", "gateway", "found", "unauthorized", "unavailable", "server error", "upstream", "wrong", "expired", "error", "wartung", "maintenance")
_CODE_NUMBER = re.compile(r"[45][0-9]{2}")
_FILL = ("here", "launch", "coming soon", "to follow", "to come", "todo", "tbd", "fixme", "placeholder", "sample", "test", "dummy", "example", "insert", "enter", "write", "add ", "put ", "later")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")
_NO_WORD = re.compile(r"[^\w]")


def _may_say(text: str) -> bool:
    low = text.lower()
    return any(x in low for x in _SAY) or _CODE_NUMBER.search(low) is not None


def _may_fill(text: str) -> bool:
    low = text.lower()
    return any(x in low for x in _FILL)


def _solid(s: str) -> int:
    """Characters other than white space."""
    return len("".join(s.split()))


def placeholder_share(text: str) -> float:
    """The largest share of a sentence, outside of code and tutorial sentences, that placeholders cover; a plain
    word in brackets counts only from WEAK_SHARE on."""
    if not _MAY_HOLD.search(text):
        return 0.0
    top = 0.0
    for s in _SENTENCES.split(_CODE.sub(" ", text)):
        hits = _PLACEHOLDER.findall(s) if _MAY_HOLD.search(s) else None
        if hits and not TUTORIAL.search(_PLACEHOLDER.sub(" ", s)):
            share = sum(map(_solid, hits)) / max(1, _solid(s))
            if share >= WEAK_SHARE or not all(_WEAK.fullmatch(h) for h in hits):
                top = max(top, share)
    return top


def filler_share(text: str) -> float:
    """The share of the text that is filler: Latin, orders to the writer, key mashing, repeated words."""
    total = _solid(text)
    if not total:
        return 0.0
    covered = 0
    rest = text
    if _may_fill(text):
        covered = sum(_solid(m.group()) for m in _FILLER.finditer(text))
        rest = _FILLER.sub(" ", text)
    if _MAY_HOLD.search(rest):
        rest = _PLACEHOLDER.sub(" ", rest)
    tokens = rest.split()
    words = [t if t.isalnum() else _NO_WORD.sub("", t) for t in rest.lower().split()]
    if not covered and len(set(words)) == len(words) and not any(w in _LATIN for w in words) and max(map(len, words), default=0) > 3 and len(words) > 8:
        return 0.0
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    latin = sum(w in _LATIN for w in words)
    few = len(counts) * 2 <= len(tokens) or len(counts) <= 2 < len(tokens)
    runs = {w for a, w, z in zip(words, words[1:], words[2:], strict=False) if w and a == w == z}
    for t, w in zip(tokens, words, strict=True):
        mash = len(w) >= 4 and any(w in k for k in _KEYS)
        if (
            (w in _LATIN and latin >= 3)
            or (w and len(w) >= 6 and len(set(w)) == 1)
            or mash
            or w in runs
            or (counts[w] >= 3 and (few or counts[w] * len(w) * 2 >= total))
            or (counts[w] >= 2 and few and len(tokens) >= 4)
            or (not w and len(tokens) >= 3)
        ):
            covered += _solid(t)
    return covered / total


def notice_share(text: str) -> float:
    if not _may_say(text):
        return 0.0
    return sum(_solid(m.group()) for m in _NOTICE.finditer(text)) / max(1, _solid(text.strip(" .!")))


def residue_kind(text: str) -> str | None:
    """`placeholder`, `notice` or `filler` where a title or description isn't real content, else None."""
    t = (html.unescape(html.unescape(text)) if "&" in text else text).strip()
    if not t:
        return None
    if placeholder_share(t) >= SENTENCE_SHARE:
        return "placeholder"
    if notice_share(_TAG.sub(" ", t) if "<" in t else t) >= NOTICE_SHARE:
        return "notice"
    held = sum(map(_solid, _PLACEHOLDER.findall(t))) / _solid(t) if _MAY_HOLD.search(t) else 0.0
    if filler_share(t) + held >= FILLER_SHARE:
        return "filler"
    return None


_TAG = re.compile(r"<[^>]*>")
_NOTHING = {"", "none", "null", "false", "0", "undefined"}
_SAYS = ("message", "detail", "error", "errors", "title", "reason", "description", "error_description")


def _walled(o) -> bool:
    """Whether an object carries the script of a bot wall."""
    script = o.get("blockScript")
    return isinstance(script, str) and script.strip().lower() not in _NOTHING


def _within(o) -> Iterator[tuple]:
    """All values of a page, itself included, however deep, and whether they lie below a name of messages."""
    todo = [(o, False)]
    while todo:
        x, says = todo.pop()
        yield x, says
        if isinstance(x, dict):
            todo += ((v, says or k in _SAYS) for k, v in x.items())
        elif isinstance(x, list):
            todo += ((v, says) for v in x)


def _notice_in(s: str, says: bool) -> bool:
    """Whether a text holds a notice; a bare number is one only in a message, as elsewhere it can be an id or a price."""
    return any(says or any(c.isalpha() for c in m.group()) for m in _NOTICE.finditer(s))


def products_of(page: dict) -> list[dict]:
    data = page.get("data")
    if not isinstance(data, dict):
        return []
    many = data.get("product_summaries")
    return [p for p in [*(many if isinstance(many, list) else []), data.get("product")] if isinstance(p, dict)]


def _texts(product: dict) -> Iterator[str]:
    item = product.get("item")
    about = item.get("product_description") if isinstance(item, dict) else None
    for o in (product, item, about):
        if isinstance(o, dict):
            for k, v in o.items():
                if (k == "title" or k == "description" or k.endswith("_description")) and isinstance(v, str):
                    yield v


def _said(shown: str) -> str | None:
    """What a body that is text and not a product object is: `notice` where that is at least half of what it shows."""
    return "notice" if notice_share(shown) >= BODY_SHARE else residue_kind(shown)


def page_kind(body: str | None) -> str | None:
    """Why a fetched product page isn't one: `wall`, `notice`, `placeholder` or `filler`; None if it is one,
    or is only cut off, empty or without products."""
    if body is None or not (text := body.strip().strip("﻿")):
        return None
    try:
        page = json.loads(text)
    except ValueError:
        if text[0] in "{[":
            return None  # cut off
        return _said(html.unescape(_TAG.sub(" ", text)))
    except RecursionError:
        return None
    if isinstance(page, str):
        return _said(page)
    if not isinstance(page, dict):
        return None
    products = products_of(page)
    if not products:
        if any(_walled(o) for o, _ in _within(page) if isinstance(o, dict)):
            return "wall"
        if any(_notice_in(s, says) for s, says in _within(page) if isinstance(s, str)) or page.get("status") == "error" or page.get("errors"):
            return "notice"
        return None
    if _walled(page):
        return "wall"
    for p in products:
        for s in _texts(p):
            if k := residue_kind(s):
                return k
    return None


def residue_pages(pages: DataFrame, key: str = "page_id", body: str = "body") -> DataFrame:
    """(key, residue_kind) of the pages to exclude; the http status plays no part.

    Defined edge cases: null, empty, blank and cut-off bodies and pages without products give no row;
    repeated rows each give theirs; a null key is kept; other columns are ignored; very long texts are read
    whole. One scan and one Arrow stage, no shuffle.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = pa.array([page_kind(t) for t in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), kinds], names=[key, "residue_kind"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, body).where(f"`{body}` is not null").mapInArrow(judge, f"`{key}` {kind}, residue_kind string").where("residue_kind is not null")
