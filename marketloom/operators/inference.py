"""Model answers on pictures (or anything that a URL names), cached, cascaded and brought together per row.

The model is a parameter: a function from a list of (url, prompt) to a list of answer texts. Answers are kept in a table by
model, prompt version and URL; only what it lacks is asked, once per URL however many rows show it. Answers the first model isn't
sure of go to the second. No answer ever breaks a row: what can't be read counts as uncertain with confidence 0.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import values

Predict = Callable[[list[tuple[str, str]]], list[str | None]]
# Kinds of answers, and the verdict each stands for.
VERDICTS = {"genuine": "genuine", "box_only": "box_only", "parts_only": "parts_only", "damaged": "damaged", "wrong_item": "wrong_item", "stock_photo": "uncertain", "uncertain": "uncertain"}
NEGATIVE = ("damaged", "box_only", "parts_only", "wrong_item")
#: What a picture shows of the item itself outweighs other pictures that look right.
OF_THE_ITEM = ("damaged",)
WORDS = {"very_high": 0.95, "high": 0.9, "medium": 0.6, "moderate": 0.6, "low": 0.3, "very_low": 0.1}
#: Confidence is cut where an answer contradicts itself.
DAMAGE_CUT, CONTRADICTION_CUT, DEFAULT = 0.8, 0.5, 0.5


def photos(rows: DataFrame, key: str, urls: str, most: int) -> DataFrame:
    """(key, pos, url): the first `most` + 2 different http(s) URLs of each row, two of them in reserve."""
    return rows.select(key, F.posexplode(values.distinct_urls(F.col(urls), most + 2)).alias("pos", "url"))


def prompt_kind(category: Column, words: Column, kinds: dict[str, str]) -> Column:
    """The kind of prompt: the category's own if there is one, else by the first pattern that the words fit, else `generic`."""
    out = F.lit("generic")
    for kind, pattern in reversed(kinds.items()):
        out = F.when(F.lower(words).rlike(pattern), kind).otherwise(out)
    return F.when(category.isin(*kinds), category).otherwise(out)


def _object(text: str | None) -> dict | None:
    """The first JSON object in a text, whatever stands around it."""
    at = (text or "").find("{")
    while at >= 0:
        try:
            o, _ = json.JSONDecoder().raw_decode(text, at)
            return o if isinstance(o, dict) else None
        except (ValueError, RecursionError):
            at = text.find("{", at + 1)
    return None


def confidence_of(x: object) -> float | None:
    """0 to 1 of a number, a share of 100, a percentage or a word."""
    if isinstance(x, bool) or x is None:
        return None
    m = re.search(r"-?[0-9]+(?:\.[0-9]+)?(?:e-?[0-9]+)?", str(x), re.I)
    if m is None:
        return WORDS.get(re.sub(r"[^a-z]+", "_", str(x).lower()).strip("_"))
    v = float(m.group())
    if v != v or v in (float("inf"), float("-inf")):
        return None
    if str(x)[m.end() :].lstrip().startswith("%") or 1 < v <= 100:
        v /= 100
    return min(1.0, max(0.0, v))


def _flag(x: object) -> bool | None:
    word = str(x).strip().lower()
    return True if word in ("true", "yes", "y", "1") else False if word in ("false", "no", "n", "0") else None


def read_answer(text: str | None) -> tuple[str, float]:
    """(verdict, confidence) of an answer text."""
    o = _object(text)
    if o is None:
        return "uncertain", 0.0
    kinds = ("category", "verdict", "label", "class")
    if not any(k in o for k in kinds):
        o = next((v for v in o.values() if isinstance(v, dict) and any(k in v for k in kinds)), o)
    given = next((o[k] for k in kinds if k in o), None)
    named = {t for t in (re.sub(r"[^a-z]+", "_", x.lower()).strip("_") for x in re.split(r"[|/,;]", given)) if t in VERDICTS} if isinstance(given, str) else set()
    kind = named.pop() if len(named) == 1 else "uncertain"
    sure = next((c for c in (confidence_of(o[k]) for k in ("confidence", "score", "probability") if k in o) if c is not None), DEFAULT)
    if kind == "genuine" and _flag(o.get("damage_visible")):
        return "damaged", sure * DAMAGE_CUT
    if (kind == "genuine" and _flag(o.get("item_visible")) is False) or (kind == "box_only" and _flag(o.get("item_visible"))):
        return "uncertain", sure * CONTRADICTION_CUT
    return VERDICTS[kind], sure


_ANSWER = "url string, prompt string, verdict string, confidence double, usable boolean"


def asked(questions: DataFrame, predict: Predict, lot: int = 32) -> DataFrame:
    """(url, prompt, verdict, confidence, usable) of each question (url, prompt); an answer of None means that the picture
    couldn't be used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            texts = [t for k in range(0, len(pairs), lot) for t in predict(pairs[k : k + lot])]
            read = [read_answer(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v for v, _ in read], pa.string()), pa.array([c for _, c in read], pa.float64()), pa.array([t is not None for t in texts], pa.bool_())], names=["url", "prompt", "verdict", "confidence", "usable"])

    return questions.select("url", "prompt").mapInArrow(run, _ANSWER)


def answers(questions: DataFrame, first: Predict, second: Predict | None = None, kept: DataFrame | None = None) -> DataFrame:
    """Answers to different questions: those `kept` from before, else the first model's; uncertain ones are put to the second,
    whose answer counts if it could be had."""
    q = questions.select("url", "prompt").distinct()
    new = q if kept is None else q.join(kept.select("url", "prompt"), ["url", "prompt"], "left_anti")
    a = asked(new, first)
    if second is not None:
        open_ = a.where("usable and verdict = 'uncertain'")
        again = asked(open_, second).select("url", "prompt", *(F.col(c).alias(f"{c}2") for c in ("verdict", "confidence", "usable")))
        better = F.coalesce(F.col("usable2"), F.lit(False))
        a = a.join(again, ["url", "prompt"], "left").select("url", "prompt", *(F.when(better, F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in ("verdict", "confidence", "usable")))
    return a if kept is None else a.unionByName(kept.join(q, ["url", "prompt"], "left_semi").select(*a.columns))


def verdicts(shown: DataFrame, answered: DataFrame, key: str, most: int, least_sure: float, required: Column | None = None) -> DataFrame:
    """(key, verdict, confidence, photos) of rows whose pictures `shown` (key, pos, url, prompt) are `answered`: from the first
    `most` usable ones. Strong damage wins; other strong negatives unless a genuine one is strong; then genuine, else uncertain.
    Rows without a usable picture are `skipped`, or `error` where `required`."""
    d = shown.join(answered, ["url", "prompt"], "left")
    good = F.filter(F.sort_array(F.collect_list(F.when(F.col("usable"), F.struct("pos", "verdict", "confidence")))), lambda x: x.isNotNull())
    d = d.groupBy(key).agg(F.slice(good, 1, most).alias("a"), (F.bool_or(required) if required is not None else F.lit(False)).alias("required"))
    top = lambda xs: F.element_at(F.array_sort(F.transform(xs, lambda x: F.struct(x["confidence"].alias("c"), (-x["pos"]).alias("p"), x["verdict"].alias("v")))), -1)
    strong = F.filter("a", lambda x: x["verdict"].isin(*NEGATIVE) & (x["confidence"] >= least_sure))
    item = F.filter(strong, lambda x: x["verdict"].isin(*OF_THE_ITEM))
    genuine = F.filter("a", lambda x: x["verdict"] == "genuine")
    sure = F.exists(genuine, lambda x: x["confidence"] >= least_sure)
    best = F.when(F.size(item) > 0, top(item)).when((F.size(strong) > 0) & ~sure, top(strong)).when(F.size(genuine) > 0, top(genuine)).when(F.size("a") > 0, top(F.col("a")))
    d = d.select(key, "required", F.size("a").alias("photos"), ((F.size(item) > 0) | ((F.size(strong) > 0) & ~sure) | (F.size(genuine) > 0)).alias("settled"), best.alias("b"))
    verdict = F.when((F.col("photos") == 0) & F.col("required"), "error").when(F.col("photos") == 0, "skipped").when(F.col("settled"), F.col("b.v")).otherwise("uncertain")
    return d.select(key, verdict.alias("verdict"), F.coalesce("b.c", F.lit(0.0)).alias("confidence"), "photos")
