"""Classification by configured patterns: profiles with variants, ordered and scoped rule groups, negation.

Rules are configuration; they are compiled into one projection of JVM regular expressions, so that any number of
rules costs one scan and no join. Only matches of negatable groups go through an Arrow function, and only those
rows that a JVM test has already let through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Variant:
    id: str
    any: tuple[str, ...]


@dataclass(frozen=True)
class Profile:
    """Matches when any of `any`, all of `all` and none of `none` are found; of several the one with the highest
    priority counts, then the first."""

    id: str
    any: tuple[str, ...]
    all: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    variants: tuple[Variant, ...] = ()
    variant_required: bool = False
    priority: int = 0


@dataclass(frozen=True)
class Group:
    """A group of patterns; `kinds` and `profiles` restrict it (empty: all); `negatable`: a match that the text
    denies ("no scratches") doesn't count."""

    id: str
    patterns: tuple[str, ...]
    weight: float = 1.0
    kinds: tuple[str, ...] = ()
    profiles: tuple[str, ...] = ()
    negatable: bool = False
    negations: tuple[str, ...] = field(default=("no", "not", "without", "never", "zero", "free of", "isn't", "wasn't", "none of", "n't"))


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def profile_match(text: Column, p: Profile) -> Column:
    out = _any(text, p.any)
    for a in p.all:
        out = out & _any(text, (a,))
    return out & ~_any(text, p.none) if p.none else out


def identify(text: Column, profiles: tuple[Profile, ...]) -> Column:
    """struct(profile, variant, strength, reason): the best profile that `text` matches. A profile that needs a
    variant and finds none is passed over; if only such match, the reason is `variant_unknown`."""
    ranked = sorted(profiles, key=lambda p: -p.priority)
    cands = []
    for p in ranked:
        variant = F.lit(None).cast("string")
        for v in reversed(p.variants):
            variant = F.when(_any(text, v.any), v.id).otherwise(variant)
        cands.append(F.when(profile_match(text, p), F.struct(F.lit(p.id).alias("profile"), variant.alias("variant"), F.lit(bool(p.variants)).alias("has"), F.lit(p.variant_required).alias("must"), F.lit(p.priority).alias("priority"))))
    found = F.filter(F.array(*cands), lambda c: c.isNotNull())
    fit = F.filter(found, lambda c: ~c["must"] | c["variant"].isNotNull())
    best = F.get(fit, 0)
    rival = F.size(F.filter(fit, lambda c: c["priority"] == best["priority"])) > 1
    strength = 1.0 - F.when(best["has"] & best["variant"].isNull(), 0.15).otherwise(0.0) - F.when(rival, 0.1).otherwise(0.0)
    reason = F.when(best.isNotNull(), None).when(F.size(found) > 0, "variant_unknown").otherwise("no_profile_match")
    return F.struct(best["profile"].alias("profile"), best["variant"].alias("variant"), F.when(best.isNotNull(), F.greatest(F.lit(0.3), strength)).alias("strength"), reason.alias("reason"))


_CLAUSE = re.compile(r"[;!?\n]|[.,](?![0-9])|\b(?:but|however)\b")
_TERM = re.compile(r"[^\W_]+(?:[.,'’][^\W_]+)*")
# Words that a negation before them is about, so that what follows isn't denied.
CLOSERS = (
    "box", "boxes", "packaging", "package", "manual", "manuals", "receipt", "warranty", "return", "returns", "refund", "refunds", "trade", "trades", "lowball", "lowballs", "lowballers", "hold", "holds", "scam", "scams", "scammers",
    "shipping", "delivery", "offers", "accessories", "cable", "cables", "stand", "remote", "except", "besides", "although", "though",
)
_CLOSE = frozenset(CLOSERS)
_GOES_ON = re.compile(r"[ \t]*(?:[,/&]|(?:and|or|nor)\b)")
_BETWEEN = re.compile(r"(?:[ \t]+[^\W\d_]+){0,2}[ \t]*(?:([,/])[ \t]*(and|or|nor|&)?[ \t]*|(?:and|or|nor|&)[ \t]+)")


def _answers(negations: tuple[str, ...]) -> re.Pattern[str]:
    """`: none`, `? No`, ` - never` behind a match, up to two words on, unless the answer is about something else."""
    said = "|".join(re.escape(n).replace("\\ ", r"\W+").replace("'", "['’]") for n in sorted(negations, key=len, reverse=True))
    return re.compile(rf"(?:[ \t]+[^\W\d_]+){{0,2}}?\s*(?:[:=?]|\s[-–—]+\s)\s*(?:{said}|none|nil|zero|0)(?![\w'’])(?!\s+(?:{'|'.join(CLOSERS)})\b)")


def negated(text: str, start: int, end: int, negations: tuple[str, ...], window: int = 5, answers: re.Pattern[str] | None = None) -> bool:
    """Whether a match in a lower-case text is denied: by a negation that ends at most `window` words before it in the same
    clause with no `CLOSERS` word between, or by an answer right after it. A negation `n't` is the end of any word."""
    if (answers or _answers(negations)).match(text, end):
        return True
    cut = 0
    for m in _CLAUSE.finditer(text, 0, start):
        cut = m.end()
    words = [w.replace("’", "'") for w in _TERM.findall(text[cut:start])]
    for last in range(len(words) - 1, max(-1, len(words) - window - 1), -1):
        if words[last] in _CLOSE:
            return False
        for n in negations:
            term = n.split()
            if words[max(0, last - len(term) + 1) : last + 1] == term or (n == "n't" and words[last].endswith("n't")):
                return True
    return False


def _listed(text: str, before: int, start: int, end: int) -> bool:
    """Whether a match goes on a list of denied things: after a conjunction, or after a comma if the list goes on behind it."""
    m = _BETWEEN.fullmatch(text, before, start)
    return m is not None and (m.group(1) is None or bool(m.group(2)) or _GOES_ON.match(text, end) is not None)


def _holds(text: str, pattern: re.Pattern[str], negations: tuple[str, ...], answers: re.Pattern[str]) -> bool:
    low, denied = text.lower(), None
    if len(low) != len(text):  # a letter that grows: positions are those of the lower-case text
        text = low
    for m in pattern.finditer(text):
        if negated(low, m.start(), m.end(), negations, answers=answers) or (denied is not None and _listed(low, denied, m.start(), m.end())):
            denied = m.end()
        else:
            return True
    return False


def undenied(text: Column, group: Group) -> Column:
    """Whether a pattern of the group is found in `text` at least once without being denied."""
    pattern = re.compile("|".join(f"(?:{p})" for p in group.patterns), re.I)
    negations, answers = group.negations, _answers(group.negations)

    @F.pandas_udf(T.BooleanType())
    def check(s: pd.Series) -> pd.Series:
        return s.map(lambda t: bool(t) and _holds(t, pattern, negations, answers))

    hit = _any(text, group.patterns)
    return check(F.when(hit, text))


def group_match(text: Column, group: Group, kind: Column | None = None, profile: Column | None = None) -> Column:
    out = undenied(text, group) if group.negatable else _any(text, group.patterns)
    for c, allowed in ((kind, group.kinds), (profile, group.profiles)):
        if allowed:
            out = out & (c.isin(*allowed) if c is not None else F.lit(False))
    return F.coalesce(out, F.lit(False))


def first_match(text: Column, groups: tuple[Group, ...], kind: Column | None = None, profile: Column | None = None) -> Column:
    """The id of the first group that matches, in configured order."""
    return F.coalesce(*(F.when(group_match(text, g, kind, profile), g.id) for g in groups))


def signals(text: Column, groups: tuple[Group, ...], kind: Column | None = None, profile: Column | None = None) -> Column:
    """Every matching group as struct(code, weight), in configured order."""
    return F.filter(F.array(*(F.when(group_match(text, g, kind, profile), F.struct(F.lit(g.id).alias("code"), F.lit(g.weight).alias("weight"))) for g in groups)), lambda s: s.isNotNull())


def strongest(signal_array: Column, most: int = 3) -> Column:
    """The codes of the strongest signals, ties in their order."""
    numbered = F.transform(signal_array, lambda s, i: F.struct((-s["weight"]).alias("w"), i.alias("i"), s["code"].alias("code")))
    return F.transform(F.slice(F.array_sort(numbered), 1, most), lambda s: s["code"])


def classified(df: DataFrame, text: Column, profiles: tuple[Profile, ...], groups: tuple[Group, ...], kind: Column | None = None) -> DataFrame:
    """`df` with product (struct), rejected_by and signals."""
    d = df.withColumn("product", identify(text, profiles))
    return d.withColumns({"rejected_by": first_match(text, tuple(g for g in groups if g.weight >= 1), kind, F.col("product.profile")), "signals": signals(text, tuple(g for g in groups if g.weight < 1), kind, F.col("product.profile"))})
