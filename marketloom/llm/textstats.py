"""Per-document text statistics, and documents that aren't natural prose.

A document of more than `chunk` characters is split; every chunk gives associative partial counts of the pieces that
are whole in it and, as boundary state, the open text at its two ends. Partials of neighbouring chunks merge by
counting what the cut had separated, in two levels (groups of `FAN_IN` chunks, then the document). Pieces are
fixed by positions in the document and by what stands near them, not by chunks, so that any way of cutting and merging
gives the same counts. Documents of one chunk, nearly all, are counted where they lie, without a shuffle.

Prose is measured in characters: a line (or a piece of a very long one) is running text when enough of its
words are common words of one language, but not nearly all of them, when it is mostly letters and words
don't keep repeating. A document less than half of whose characters stand in such lines isn't prose.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.tables import spread

CHUNK, FAN_IN = 1 << 16, 32
#: Lines are judged whole. Only where no line ends within so many characters on either side is a line cut into pieces of
#: about that length: at the first word that begins after each multiple of it in the document (inside a word of over that length).
PIECE = 2000
#: How many preceding words count as a word's neighbourhood for repetition.
NEAR = 10
#: A piece is running text from MIN_WORDS words on (a shorter one needs SHORT_COMMON and two common words).
MIN_WORDS, MIN_COMMON, MAX_COMMON, SHORT_COMMON = 5, 0.17, 0.84, 0.25
MIN_LETTERS, MAX_REPEATS, MAX_DIGIT_WORDS = 0.72, 0.6, 0.35
PROSE_SHARE = 0.5

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_ENDS = frozenset(".!?…:;。！？\"”»")
_BULLET = re.compile(r"\s*(?:[-*•→◦·+>]\s|\[[ x]?\]\s|[0-9]{1,3}[.)]\s|#)")
_CELLS = re.compile(r"[|│\t;]|</?t[dr]>| {3,}|,(?=\S)")
_WORD_START = re.compile(r"\s\S")
_DIGIT = re.compile(r"\d")
_ALNUM = bytes(c for c in range(128) if chr(c).isalnum())


class Counts(NamedTuple):
    chars: int = 0  # without white space
    words: int = 0
    word_chars: int = 0
    symbols: int = 0  # neither letters, digits nor white space
    common: int = 0
    lines: int = 0  # with any text
    ended: int = 0  # of these, ending in punctuation
    prose_chars: int = 0  # without white space, in running text

    def __add__(self, other: Counts) -> Counts:  # type: ignore[override]
        return Counts(*(a + b for a, b in zip(self, other, strict=True)))


class Vocabulary:
    """Common words by language; a piece is measured by the language that explains it best."""

    def __init__(self, words: list[tuple[str, str]]):
        self.by_word: dict[str, int] = {}
        langs = sorted({lang for lang, _ in words})
        for lang, w in words:
            self.by_word[w.lower()] = self.by_word.get(w.lower(), 0) | (1 << langs.index(lang))
        self.bits = [1 << k for k in range(len(langs))]


def _running(s: str, words: list[str], masks: dict[int, int], vocabulary: Vocabulary) -> bool:
    """Whether a piece is running text, as far as `_piece` hasn't looked already."""
    n = len(words)
    best = max(sum(c for h, c in masks.items() if h & b) for b in vocabulary.bits) if masks else 0
    share = best / n
    if not MIN_COMMON <= share <= MAX_COMMON or (n < MIN_WORDS and (share < SHORT_COMMON or best < 2)):
        return False
    if _DIGIT.search(s) and sum(w[0].isdigit() for w in words) > MAX_DIGIT_WORDS * n:
        return False
    if n - len(set(words)) > MAX_REPEATS * n:  # else there aren't enough
        seen: dict[str, int] = {}
        repeats = 0
        for k, w in enumerate(words):
            repeats += k - seen.get(w, -NEAR - 1) <= NEAR
            seen[w] = k
        if repeats > MAX_REPEATS * n:
            return False
    return len(_CELLS.findall(s)) * 5 <= n and not (n < 12 and share < SHORT_COMMON and _BULLET.match(s))


def _piece(s: str, vocabulary: Vocabulary) -> tuple[int, int, int, int, int, int]:
    """chars, words, word_chars, symbols, common, prose_chars"""
    solid = "".join(s.split())
    chars = len(solid)
    if not chars:
        return 0, 0, 0, 0, 0, 0
    words = _WORD.findall(s.lower())
    n = len(words)
    word_chars = sum(map(len, words))
    symbols = len(solid.encode().translate(None, _ALNUM)) if solid.isascii() else chars - sum(map(str.isalnum, solid))
    if not n:
        return chars, 0, 0, symbols, 0, 0
    masks = Counter(map(vocabulary.by_word.get, words))
    common = n - masks.pop(None, 0)
    ok = common >= MIN_COMMON * n and word_chars >= MIN_LETTERS * chars and _running(s, words, masks, vocabulary)
    return chars, n, word_chars, symbols, common, chars if ok else 0


def _cuts(text: str, start: int, stop: int, at: int, left_cut: bool, right_cut: bool) -> Iterator[int]:
    """Where the line text[start:stop] is cut, `at` being the position of `text` in the document. A side that
    isn't itself a cut is taken for the end of the line, or for the end of what is known, where no cut is certain either."""
    first = at + start if left_cut else at + start - 1 + PIECE
    for k in range(-(-first // PIECE) * PIECE - at, stop, PIECE):
        end = k + PIECE
        if m := _WORD_START.search(text, k, min(end, stop)):
            pos = m.start() + 1
        elif end < stop and not text[end - 1].isspace() and not text[end].isspace():
            pos = end
        else:
            continue
        if right_cut or pos + PIECE <= stop:
            yield pos


def _bounds(text: str, at: int, left_cut: bool, right_cut: bool) -> list[tuple[int, bool]]:
    """The ends of pieces in `text` that are certain whatever stands around it, and whether each is a cut (or ends a line)."""
    out: list[tuple[int, bool]] = []
    start = 0
    while True:
        nl = text.find("\n", start)
        stop = nl if nl >= 0 else len(text)
        if stop - start > PIECE:
            out += ((c, True) for c in _cuts(text, start, stop, at, left_cut, right_cut and nl < 0))
        if nl < 0:
            return out
        out.append((nl + 1, False))
        start, left_cut = nl + 1, False


def _counted(text: str, bounds: list[tuple[int, bool]], vocabulary: Vocabulary, start: int = 0) -> Counts:
    """The counts of the pieces that end at `bounds`."""
    total = [0] * 6
    lines = ended = 0
    for stop, cut in bounds:
        unit = text[start:stop]
        start = stop
        for i, v in enumerate(_piece(unit, vocabulary)):
            total[i] += v
        if not cut and (end := unit.rstrip()):
            lines += 1
            ended += end[-1] in _ENDS
    chars, words, word_chars, symbols, common, prose = total
    return Counts(chars, words, word_chars, symbols, common, lines, ended, prose)


def count_text(text: str, vocabulary: Vocabulary) -> Counts:
    """The counts of a whole text."""
    return _counted(text, [*_bounds(text, 0, False, False), (len(text), False)], vocabulary)


class Partial(NamedTuple):
    """Closed counts between the open text at both ends; `tail` None: nothing is closed, all is in `head`."""

    at: int  # position of the head in the document
    head: str
    head_cut: bool  # whether the head ends at a cut, not at the end of a line
    closed: Counts
    tail_at: int
    tail: str | None
    tail_cut: bool  # whether the tail begins at a cut


def _between(text: str, at: int, bounds: list[tuple[int, bool]], vocabulary: Vocabulary) -> Partial:
    if not bounds:
        return Partial(at, text, False, Counts(), 0, None, False)
    (first, head_cut), (last, tail_cut) = bounds[0], bounds[-1]
    return Partial(at, text[:first], head_cut, _counted(text, bounds[1:], vocabulary, first), at + last, text[last:], tail_cut)


def partial(text: str, vocabulary: Vocabulary, at: int = 0) -> Partial:
    return _between(text, at, _bounds(text, at, False, False), vocabulary)


def merge(x: Partial, y: Partial, vocabulary: Vocabulary) -> Partial:
    """The partial of two neighbouring texts; associative."""
    joint, at = (x.head, x.at) if x.tail is None else (x.tail, x.tail_at)
    joint += y.head
    right_cut = y.tail is not None and y.head_cut
    bounds = _bounds(joint, at, x.tail is not None and x.tail_cut, right_cut)
    if right_cut:
        bounds.append((len(joint), True))
    if x.tail is None:
        p = _between(joint, at, bounds, vocabulary)
    else:
        last, cut = bounds[-1] if bounds else (0, x.tail_cut)
        p = Partial(x.at, x.head, x.head_cut, x.closed + _counted(joint, bounds, vocabulary), at + last, joint[last:], cut)
    return p if y.tail is None else p._replace(closed=p.closed + y.closed, tail_at=y.tail_at, tail=y.tail, tail_cut=y.tail_cut)


def finish(p: Partial, vocabulary: Vocabulary) -> Counts:
    """The counts of a whole document, from the partial of all its chunks."""
    if p.tail is None:
        return count_text(p.head, vocabulary)
    head = _bounds(p.head, p.at, False, p.head_cut)
    if p.head_cut:
        head.append((len(p.head), True))
    tail = [*_bounds(p.tail, p.tail_at, p.tail_cut, False), (len(p.tail), False)]
    return _counted(p.head, head, vocabulary) + p.closed + _counted(p.tail, tail, vocabulary)


_COUNTS = ", ".join(f"{f} long" for f in Counts._fields)


def _vocabulary(common_words: DataFrame, limit: int = 20_000) -> Vocabulary:
    """The word list is a parameter of the operator and must be short; a longer one is refused, not cut."""
    rows = common_words.select("lang", "word").where("word is not null").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"common_words has over {limit} words")
    return Vocabulary([(r[0] or "", r[1]) for r in rows])


def document_counts(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The `Counts` of every row of `documents` with its key.

    Defined edge cases: a null text counts as empty; an empty text has only zeros; a null key is kept;
    repeated short rows each give their own row, repeated keys of documents over `chunk` are told apart by
    their order in the partition; other columns are ignored. Only documents over `chunk` are shuffled.
    """
    vocabulary = _vocabulary(common_words)
    kind = dict(documents.dtypes)[key]
    d = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"key {kind}, {_COUNTS}"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [count_text(t, vocabulary) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(Counts._fields)))], names=["key", *Counts._fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(2).to_pylist()):
                ats = range(0, len(t), chunk)
                for some in (ats[k : k + 256] for k in range(0, len(ats), 256)):
                    take = pa.array([i] * len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array([a // chunk for a in some], pa.int64()), pa.array([t[a : a + chunk] for a in some], pa.string())], names=["key", "doc", "at", "text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps = [partial(t, vocabulary, a * chunk) for a, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield _partials(b.column(0), b.column(1), b.column(2), ps)

    state = ("start", "head", "head_cut", "tail_at", "tail", "tail_cut")
    kinds = (pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.bool_())

    def _partials(keys, docs, at, ps) -> pa.RecordBatch:
        ends = [pa.array([x[k] for x in ((p.at, p.head, p.head_cut, p.tail_at, p.tail, p.tail_cut) for p in ps)], t) for k, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([keys, docs, at, *ends, *(pa.array([p.closed[i] for p in ps], pa.int64()) for i in range(len(Counts._fields)))], names=["key", "doc", "at", *state, *Counts._fields])

    def fold(t: pa.Table) -> Partial:
        cols = [t.sort_by("at").column(c).to_pylist() for c in (*state, *Counts._fields)]
        top = None
        for start, head, head_cut, tail_at, tail, tail_cut, *counts in zip(*cols, strict=True):
            p = Partial(start, head, head_cut, Counts(*counts), tail_at, tail, tail_cut)
            top = p if top is None else merge(top, p, vocabulary)
        return top

    def level(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_partials(t.column("key").combine_chunks()[:1], t.column("doc").combine_chunks()[:1], pa.array([min(t.column("at").to_pylist()) // FAN_IN], pa.int64()), [fold(t)])])

    def top(t: pa.Table) -> pa.Table:
        c = finish(fold(t), vocabulary)
        return pa.table({"key": t.column("key").combine_chunks()[:1], **{f: pa.array([v], pa.int64()) for f, v in zip(Counts._fields, c, strict=True)}})

    small = spread(d.where(F.length("text") <= chunk)).mapInArrow(whole, schema)
    part = f"key {kind}, doc long, at long, start long, head string, head_cut boolean, tail_at long, tail string, tail_cut boolean, {_COUNTS}"
    huge = d.where(F.length("text") > chunk).select("key", F.monotonically_increasing_id().alias("doc"), "text")
    # Chunks of a document are spread, so that one of a gigabyte isn't one task's work.
    huge = huge.mapInArrow(cut, f"key {kind}, doc long, at long, text string").repartition("doc", "at").mapInArrow(count, part)
    huge = huge.groupBy("doc", F.floor(F.col("at") / FAN_IN).alias("group")).applyInArrow(level, part).groupBy("doc").applyInArrow(top, schema)
    return small.unionByName(huge).withColumnRenamed("key", key)


def statistics(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ratios and rule outcome derived from `document_counts`."""
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counts.select(
        key,
        F.col("words").alias("word_count"),
        over("word_chars", "words").alias("mean_word_length"),
        over("symbols", "chars").alias("symbol_share"),
        over("ended", "lines").alias("ended_line_share"),
        over("common", "words").alias("common_word_share"),
        over("prose_chars", "chars").alias("prose_share"),
        (F.col("prose_chars") < PROSE_SHARE * F.col("chars")).alias("not_prose"),
    )
