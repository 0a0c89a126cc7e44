"""Amounts of money in texts: price fields in the notations of several countries, and prices named in free text.

Amounts are taken apart in one Arrow pass per column (they need positions and what stands around them); plain fields, which
are most, are read by JVM expressions before that.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Larger amounts aren't prices, and longer fields aren't price fields.
MOST, LONGEST = 10_000_000, 256
# Currencies by code, by sign, and by the letters before a dollar sign; those that group digits with dots.
CODES = ("USD", "CAD", "AUD", "NZD", "HKD", "SGD", "MXN", "TWD", "BRL", "EUR", "GBP", "JPY", "CNY", "CHF", "INR", "KRW", "RUB", "TRY", "ILS", "PHP", "SEK", "NOK", "DKK", "PLN", "CZK", "HUF", "ZAR")
SIGNS = {"€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₩": "KRW", "₽": "RUB", "₺": "TRY", "₪": "ILS", "₱": "PHP"}
DOLLARS = {"": "USD", "US": "USD", "C": "CAD", "CA": "CAD", "A": "AUD", "AU": "AUD", "NZ": "NZD", "HK": "HKD", "S": "SGD", "SG": "SGD", "MX": "MXN", "NT": "TWD", "R": "BRL"}
DOTTED = ("EUR", "BRL", "TRY", "DKK", "NOK", "SEK", "PLN", "CZK", "HUF", "RUB")
#: Currencies that a bare dollar sign can stand for.
DOLLAR_CODES = ("USD", "CAD", "AUD", "NZD", "HKD", "SGD", "MXN", "TWD")

_CODE = "|".join(CODES)
_SIGN = "".join(SIGNS)
_NARROW = "\u00a0\u202f\u2009"  # spaces that don't break, and thin ones
_DIGITS = rf"[0-9](?:[0-9]|[,.'{_NARROW}](?=[0-9]))*"
_SPACED = r"[0-9]{1,3}(?: [0-9]{3}(?![0-9]))+(?:[.,][0-9]{1,2}(?![0-9]))?"
_DOLLAR = r"(?:(?<![A-Za-z])(?:US[ \u00a0]?|CA|AU|NZ|HK|SG|MX|NT|C|A|S|R))?\$"


def _amounts(before: str, number: str, after: str, need_mark: bool) -> re.Pattern[str]:
    """An amount with its mark before or behind; a minus counts when it is attached and not a dash between words."""
    return re.compile(
        rf"(?P<minus>(?<![^\s(\[{{:/])[-−])?(?:(?P<mark>{before})[ \u00a0]{{0,2}}(?P<minus2>[-−])?(?P<n>{number})(?P<k>[kK](?![A-Za-z0-9]))?"
        rf"|(?<![\w.,'’$])(?P<n2>{number})(?P<k2>[kK](?![A-Za-z0-9]))?(?P<mark2>{after}){'' if need_mark else '?'})"
    )


_IN_FIELD = _amounts(
    rf"{_DOLLAR}|(?<![A-Za-z])(?i:{_CODE})(?![A-Za-z])(?:[ \u00a0]?\$)?|[{_SIGN}]",
    rf"(?:{_SPACED}|{_DIGITS})",
    rf"[ \u00a0]?\$(?![ \u00a0]?[0-9$])|[ \u00a0]?[{_SIGN}](?![ \u00a0]?[0-9])|[ \u00a0]?(?<![A-Za-z])(?i:{_CODE})(?![A-Za-z])(?![ \u00a0]?[0-9])",
    need_mark=False,
)
_IN_TEXT = _amounts(
    rf"{_DOLLAR}|(?<![A-Za-z])(?i:usd)(?![A-Za-z])(?:[ \u00a0]?\$)?|(?<![A-Za-z])(?:CAD|AUD|NZD|HKD|SGD|MXN)[ \u00a0]?\$",
    _DIGITS,
    r"\$(?![0-9$])|[ \u00a0]?(?<![A-Za-z])(?i:usd)(?![A-Za-z])(?![ \u00a0]?[0-9])",
    need_mark=True,
)
# Words by which an amount is a reduction or a charge, not the price; words of things given away.
_NOT_PRICE = re.compile(
    r"\s*(?:off\b|rebates?\b|discounts?\b|savings?\b|coupons?\b|promo\b|gift\s*cards?\b|gc\b|e?credits?\b|cash\s*back\b|rewards?\b|back\b|mir\b|shipping\b(?!\s+incl)|s[&/]h\b|tax\b|fees?\b|deposit\b|bonus\b|trade[\s-]?in\b|value\b)",
    re.I,
)
_REDUCES = re.compile(r"\b(?:save|saving|savings|extra|additional|discount|rebate|credit)\s*(?:of\s+|up\s+to\s+|an?\s+)?$", re.I)
_FREE = re.compile(r"\bfree\b(?!\s*(?:shipping|ship\b|delivery|returns?|s&h|s/h|gifts?\b|install\w*|pick[\s-]?up\s+in\s+store|trial))", re.I)
_KEYCAP = re.compile("[0-9#*]️?⃣")
_HINT = re.compile(r"\$|[uU][sS][dD]")


class Money(NamedTuple):
    amount: float | None = None
    currency: str | None = None
    negative: bool = False  # amounts were found, all of them below zero
    bare_dollar: bool = False  # the currency is that of a dollar sign alone


class Found(NamedTuple):
    start: int
    end: int
    value: float | None
    mark: str | None
    negative: bool


def currency_of(mark: str | None) -> tuple[str | None, bool]:
    """The currency a mark names, and whether it is a dollar sign alone."""
    m = re.sub(r"[ \u00a0]", "", mark or "").upper()
    if m.endswith("$"):
        head = m[:-1]
        return (head, False) if head in CODES else (DOLLARS.get(head), head == "")
    return (m if m in CODES else SIGNS.get(m)), False


def read_number(run: str, thousands: bool = False, dotted: bool = False) -> float | None:
    """The value of digits with separators; None where they can be read in two ways. `thousands`: a `k` follows; `dotted`: the
    currency groups digits with dots."""
    s = re.sub(rf"[' {_NARROW}]", "", run)
    marks = [c for c in s if c in ".,"]
    if not marks:
        whole, part = s, ""
    else:
        last = marks[-1]
        groups = re.split(r"[.,]", s)
        alone = marks.count(last) == 1
        mixed = len(set(marks)) == 2
        if mixed:
            if not alone:
                return None
            whole, part, grouped = "".join(groups[:-1]), groups[-1], groups[:-1]
        elif not alone:
            if thousands:
                return None
            whole, part, grouped = "".join(groups), "", groups
        elif len(groups[1]) == 3 and groups[0] != "0" and len(groups[0]) <= 3:
            if thousands or (last == "." and not dotted):
                return None
            whole, part, grouped = "".join(groups), "", groups
        else:
            whole, part, grouped = groups[0], groups[1], groups[:1] and ["0"]
        if (mixed or not alone) and not (1 <= len(grouped[0]) <= 3 and all(len(g) == 3 for g in grouped[1:])):
            return None
    v = float(f"{whole}.{part or 0}")
    v = round(v * 1000, 6) if thousands else v
    return v if v <= MOST else None


def _found(m: re.Match[str]) -> Found:
    first = m["n"] is not None
    mark = m["mark"] if first else m["mark2"]
    dotted = mark is not None and currency_of(mark)[0] in DOTTED
    return Found(m.start(), m.end(), read_number(m["n"] if first else m["n2"], bool(m["k"] if first else m["k2"]), dotted), mark, bool(m["minus"] or m["minus2"]))


def parse_money(text: str | None) -> Money:
    """What a price field says: the first marked amount, else the first plain one; `Free` is 0. Nothing for texts that name no
    amount, one that can be read in two ways, or one beyond `MOST`."""
    t = _KEYCAP.sub(" ", text or "").strip()
    if not t or len(t) > LONGEST:
        return Money()
    if _FREE.match(t.lstrip(" \t\"'*~!:([")):
        return Money(0.0)
    found = [_found(m) for m in _IN_FIELD.finditer(t)]
    good = [f for f in found if f.value is not None and not f.negative]
    best = next((f for f in good if f.mark), None) or next(iter(x for x in good if not x.mark), None)
    if best is not None:
        currency, bare = currency_of(best.mark)
        return Money(best.value, currency, False, bare)
    if any(f.negative for f in found):
        return Money(negative=True)
    return Money(0.0) if not found and _FREE.search(t) else Money()


def price_in_text(text: str | None) -> Money:
    """The first price that a title or text names with a dollar sign or USD; reductions and charges aren't prices. A sum in
    brackets, as in `($1599 - $400)` or `($449 - $50 = $399)`, is worked out."""
    if not text or not _HINT.search(text):
        return Money()
    found = [_found(m) for m in _IN_TEXT.finditer(text)]
    k = next((k for k, f in enumerate(found) if f.value is not None and not f.negative and not _NOT_PRICE.match(text, f.end) and not _REDUCES.search(text[max(0, f.start - 28) : f.start])), None)
    if k is None:
        return Money()
    first = found[k]
    value = first.value
    opened, shut = text.rfind("(", 0, first.start), text.find(")", first.start)
    if opened >= 0 and shut >= 0 and ")" not in text[opened : first.start] and "(" not in text[first.start : shut]:
        value = _worked_out(text, [f for f in found[k:] if f.end <= shut and f.value is not None])
    currency, bare = currency_of(first.mark)
    return Money(value, currency, False, bare)


def _worked_out(text: str, terms: list[Found]) -> float:
    between = [text[a.end : b.start].strip() for a, b in zip(terms, terms[1:], strict=False)]
    stated = next((b.value for gap, b in zip(between, terms[1:], strict=True) if gap.endswith("=")), None)
    if stated is not None:
        return stated
    left = base = terms[0].value
    for gap, term in zip(between, terms[1:], strict=True):
        if gap in ("-", "−", "–", "—") or (not gap and term.negative):
            left -= term.value
        else:
            break
    return round(left, 2) if 0 < left < base else base


_MONEY = T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("currency", T.StringType()), T.StructField("negative", T.BooleanType()), T.StructField("bare_dollar", T.BooleanType())])


def _frame(s: pd.Series, read) -> pd.DataFrame:
    return pd.DataFrame([read(t) for t in s], columns=Money._fields).astype({"amount": "float64"})


@F.pandas_udf(_MONEY)
def _money_of(s: pd.Series) -> pd.DataFrame:
    return _frame(s, parse_money)


@F.pandas_udf(_MONEY)
def _price_of(s: pd.Series) -> pd.DataFrame:
    return _frame(s, price_in_text)


def _struct(amount: Column, currency: Column, negative: Column, bare: Column) -> Column:
    return F.struct(amount.cast("double").alias("amount"), currency.cast("string").alias("currency"), negative.alias("negative"), bare.alias("bare_dollar"))


def money(text: Column, number: Column | None = None) -> Column:
    """(amount, currency, negative, bare_dollar) of a price given as a number (which counts if there is one) or as a text."""
    none, no = F.lit(None), F.lit(False)
    plain = F.regexp_extract(text, r"^\s*(?:US ?\$|\$)? ?((?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]{1,8})(?:\.[0-9]{1,2})?)\s*$", 1)
    amount = F.replace(plain, F.lit(",")).try_cast("double")
    fast = _struct(F.when(amount <= MOST, amount), F.when(F.contains(text, F.lit("$")) & (amount <= MOST), "USD"), no, F.coalesce(F.trim(text).startswith("$") & (amount <= MOST), no))
    slow = F.when(plain == "", text)
    m = _money_of(slow)
    out = F.when(text.isNull(), _struct(none, none, no, no)).when(plain != "", fast).otherwise(_struct(F.nanvl(m["amount"], none.cast("double")), m["currency"], m["negative"], m["bare_dollar"]))
    if number is None:
        return out
    bad = F.isnan(number) | (F.abs(number) == float("inf"))
    given = _struct(F.when(~bad & number.between(0, MOST), number), none, ~bad & (number < 0), no)
    return F.when(number.isNull(), out).otherwise(given)


def text_price(text: Column) -> Column:
    """(amount, currency, negative, bare_dollar) of the first price named in free text."""
    none, no = F.lit(None), F.lit(False)
    m = _price_of(F.when(text.rlike(r"\$|[uU][sS][dD]"), text))
    return F.when(text.rlike(r"\$|[uU][sS][dD]"), _struct(F.nanvl(m["amount"], none.cast("double")), m["currency"], m["negative"], m["bare_dollar"])).otherwise(_struct(none, none, no, no))


def shipping(text: Column, number: Column) -> Column:
    """A shipping cost: 0 where it is free or included, else the amount; null if unknown."""
    free = text.rlike(r"(?i)^\W*(?:free|gratis|included|incl\b)|\bfree\s+(?:standard\s+|ground\s+|2[\s-]day\s+)?(?:shipping|delivery|s&h|s/h|ship)\b|^\W*(?:shipping|delivery)\s*:?\s*(?:free|included)\b")
    return F.when(number.isNull() & free, F.lit(0.0)).otherwise(money(text, number)["amount"])
