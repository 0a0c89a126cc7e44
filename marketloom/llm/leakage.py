"""Evaluation texts inside training documents, by spaced-seed hashing.

A seed is a mask over a window of words: positions marked 1 are hashed, the others may differ. All windows
of the evaluation texts are hashed under every mask; documents are scanned once, and where a window's hash
meets one of a test item the overlap around the hit is verified word by word: as an exact run, or tolerating
substitutions along the hit's diagonal. Every mask spans at most the shortest run asked for, so that no exact
run is missed. The evaluation texts are the stated query set: up to BLOCK_CHARS of them travel to the tasks and are looked up
where documents are read. A larger set is met by joining hashes: documents are still read once, and of their
windows only those that pass a bit filter of fixed size over the set's hashes are shuffled; candidate pairs then fetch
their two texts and are verified in the same way. Documents as such never move but for candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.tables import cut_lineage, spread

#: Masks of a span of 12 words or less; different positions are open in each.
MASKS = ("110110101101", "101101111011")
RUN = 12
#: Characters of evaluation text that are sent to tasks; a larger set is joined.
BLOCK_CHARS = 8_000_000
#: Bits of the filter over a larger set's hashes (8 MB), in pages of so many bits.
FILTER_BITS, PAGE_BITS = 26, 16
_WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Index(NamedTuple):
    """One block of evaluation texts: its vocabulary, word ids, and window hashes sorted per mask."""

    vocabulary: dict[str, int]
    ids: np.ndarray  # the word ids of all items, one after the other, each followed by zeros
    item: np.ndarray  # the item of each word
    hashes: list[np.ndarray]
    starts: list[np.ndarray]
    masks: tuple[np.ndarray, ...]
    span: int


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(20_250_901).integers(1, 1 << 63, size=n, dtype=np.uint64) | np.uint64(1)


def _hashes(ids: np.ndarray, mask: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every window, whether all its hashed positions hold a word of the vocabulary)"""
    n = len(ids) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    f = _factors(span)
    h, ok = np.zeros(n, np.uint64), np.ones(n, bool)
    wide = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    wide ^= wide >> np.uint64(29)
    for k in mask:
        h += wide[k : k + n] * f[k]
        ok &= ids[k : k + n] > 0
    return h, ok


def build_index(items: list[tuple[int, str]], masks: tuple[str, ...] = MASKS, once: bool = False) -> Index:
    """`once`: of equal windows of an item only the first, which is enough to find exact runs, so that texts that repeat a few words
    don't multiply with each other."""
    span = max(map(len, masks))
    vocabulary: dict[str, int] = {}
    ids: list[int] = []
    owner: list[int] = []
    for item, text in items:
        own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text or "")]
        ids += own + [0] * span
        owner += [item] * (len(own) + span)
    arr = np.array(ids, dtype=np.int32)
    positions = tuple(np.array([k for k, c in enumerate(m) if c == "1"]) for m in masks)
    hashes, starts = [], []
    owners = np.array(owner, dtype=np.int64)
    whole, complete = _hashes(arr, np.arange(span), span)
    first = np.ones(len(whole), bool)
    if once and len(whole):
        runs = np.nonzero(complete)[0]
        pairs = np.stack([whole[runs], owners[runs].astype(np.uint64)])
        first[runs] = False
        first[runs[np.unique(pairs, axis=1, return_index=True)[1]]] = True
        first &= complete
    for m in positions:
        h, ok = _hashes(arr, m, span)
        at = np.nonzero(ok & first)[0]
        order = np.argsort(h[at], kind="stable")
        hashes.append(h[at][order])
        starts.append(at[order])
    return Index(vocabulary, arr, owners, hashes, starts, positions, span)


def hits(ids: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(window starts in `ids`, window starts in the index), one pair per match of a hash under any mask."""
    left, right = [], []
    for mask, hs, starts in zip(index.masks, index.hashes, index.starts, strict=True):
        h, ok = _hashes(ids, mask, index.span)
        at = np.nonzero(ok)[0]
        if not len(at) or not len(hs):
            continue
        lo = np.searchsorted(hs, h[at], side="left")
        cand = lo < len(hs)
        at, lo = at[cand], lo[cand]
        same = hs[lo] == h[at]
        at, lo = at[same], lo[same]
        n = np.searchsorted(hs, hs[lo], side="right") - lo
        left.append(np.repeat(at, n))
        first = np.repeat(np.cumsum(n) - n, n)
        right.append(starts[np.repeat(lo, n) + np.arange(n.sum()) - first])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def exact_items(ids: np.ndarray, index: Index, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(start in `ids`, item) of every exact run of `run` words found from a hit; `run` is at least the span."""
    a, b = hits(ids, index)
    fit = (a + run <= len(ids)) & (b + run <= len(index.ids))
    a, b = a[fit], b[fit]
    k = np.arange(run)
    same = np.ones(len(a), bool)
    for j in k:
        x = ids[a + j]
        same &= (x == index.ids[b + j]) & (x > 0)
    return a[same], index.item[b[same]]


def tolerant_overlaps(ids: np.ndarray, index: Index, least: int = RUN, identity: float = 0.8) -> list[tuple[int, int, int]]:
    """(item, words spanned, words equal): per item the best overlap of at least `least` words along a hit's
    diagonal, in which from end to end at least `identity` of the words are equal."""
    a, b = hits(ids, index)
    best: dict[int, tuple[int, int]] = {}
    for diagonal in set((a - b).tolist()):
        on = np.sort(b[a - b == diagonal])
        done = -1
        for q in on.tolist():
            if q <= done:
                continue
            item = index.item[q]
            lo = hi = q
            for step in (-1, 1):
                score = top = 0
                at, end = (q - 1, q) if step < 0 else (q, q)
                while 0 <= at + diagonal < len(ids) and 0 <= at < len(index.ids) and index.item[at] == item and index.ids[at] > 0 and score > top - 6:
                    score += 1 if ids[at + diagonal] == index.ids[at] else -2
                    if score > top:
                        top, end = score, at + (step > 0)
                    at += step
                lo, hi = (end, hi) if step < 0 else (lo, end)
            done = max(done, hi - 1)
            equal = int((ids[lo + diagonal : hi + diagonal] == index.ids[lo:hi]).sum())
            if hi - lo >= least and equal >= identity * (hi - lo) and equal > best.get(int(item), (0, 0))[1]:
                best[int(item)] = (hi - lo, equal)
    return [(i, s, e) for i, (s, e) in sorted(best.items())]


def _small(items: DataFrame, key: str, text: str, most: int) -> list[tuple[int, str]] | None:
    """The evaluation texts if they are `most` characters or less together, else None."""
    items = items.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("t is not null and k is not null").distinct()
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    return [(r[0], r[1]) for r in items.collect()] if total <= most else None


_seen_words: dict[str, int] = {}


def _word_ids(text: str) -> np.ndarray:
    """A 64-bit hash of each word, never 0."""
    if len(_seen_words) > 1_000_000:
        _seen_words.clear()
    out = []
    for w in _WORD.findall(text.lower()):
        h = _seen_words.get(w)
        if h is None:
            h = _seen_words[w] = xxhash.xxh64_intdigest(w) | 1
        out.append(h)
    return np.array(out, dtype=np.uint64)


def _window_hashes(texts: list[str], masks: tuple[str, ...] = MASKS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all windows of the texts under all masks."""
    span = max(map(len, masks))
    rows, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for i, t in enumerate(texts):
        ids = _word_ids(t)
        for k, m in enumerate(masks):
            h, _ = _hashes(ids, np.array([p for p, c in enumerate(m) if c == "1"]), span)
            h = np.unique(h * np.uint64(2) + np.uint64(k))
            rows.append(np.full(len(h), i))
            hashes.append(h)
    return np.concatenate(rows), np.concatenate(hashes)


def _windows(d: DataFrame, key: str, keep=None) -> DataFrame:
    """(key, hash) of the different windows of each text; `keep`: a broadcast filter that they must pass."""
    kind = d.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("hash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows, h = _window_hashes(part.column(1).to_pylist())
                if keep is not None:
                    bit = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    on = (keep.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                    rows, h = rows[on], h[on]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(h.view(np.int64))], names=[key, "hash"])

    return d.mapInArrow(run, schema)


def _filter(hashes: DataFrame) -> np.ndarray:
    """The bit filter over a column `hash`, made page by page, so that what comes to the driver is its 8 MB at most."""
    top = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    d = hashes.select(F.shiftright(top, PAGE_BITS).alias("page"), top.bitwiseAND(F.lit((1 << PAGE_BITS) - 1)).alias("bit")).distinct()

    def page(t: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PAGE_BITS, np.uint8)
        bits[t.column("bit").to_numpy()] = 1
        return pa.table({"page": t.column("page").combine_chunks()[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = 1 << (PAGE_BITS - 3)
    for r in d.groupBy("page").applyInArrow(page, "page long, bits binary").toLocalIterator():
        out[r.page * size : (r.page + 1) * size] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _leaked_by_join(documents: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str, run: int, tolerant: bool, schema: T.StructType) -> DataFrame:
    items = cut_lineage(items.select(F.col(item_key).cast("long").alias(item_key), F.col(text).alias("item_text")).where(f"item_text is not null and `{item_key}` is not null").distinct().withColumn("item_row", F.monotonically_increasing_id()))
    docs = documents.select(F.col(doc_key).alias(doc_key), F.col(text).alias("text")).where("text is not null")
    # Rows are told apart by a hash of their text, so that keys may repeat, and be null.
    docs = docs.withColumn("doc_row", F.xxhash64("text"))
    of_items = cut_lineage(_windows(items.select("item_row", "item_text"), "item_row"))
    shared = documents.sparkSession.sparkContext.broadcast(_filter(of_items))
    met = _windows(spread(docs.select("doc_row", "text")), "doc_row", shared).join(of_items.hint("merge"), "hash").select("doc_row", "item_row").distinct()
    pairs = cut_lineage(met)
    d = docs.join(pairs.hint("merge"), "doc_row").join(items.hint("merge"), "item_row").select(doc_key, item_key, "text", "item_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, extra = [], []
            for i, (t, item) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                index = build_index([(0, item)], once=not tolerant)
                get = index.vocabulary.get
                ids = np.array([get(w, 0) for w in words_of(t)], dtype=np.int32)
                if tolerant:
                    found = [(s, e) for _, s, e in tolerant_overlaps(ids, index, run)]
                else:
                    found = [()] if len(exact_items(ids, index, run)[0]) else []
                good += [i] * len(found)
                extra += found
            take = pa.array(good, pa.int64())
            more = [pa.array([e[k] for e in extra], pa.int64()) for k in (0, 1)] if tolerant else []
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *more], names=schema.names)

    return d.mapInArrow(verify, schema)


def leaked(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "test_item_id", text: str = "text", run: int = RUN, tolerant: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents and the evaluation items whose passages they hold.

    Exact: distinct (doc_key, item_key) that share `run` or more words in a row. Tolerant: also span_words and
    equal_words of each pair's best overlap with at least 80 % equal words. Words are maximal runs of a-z and
    0-9 after lower-casing. Defined edge cases: null texts and keys of items are left out, null document
    texts hold nothing, texts of fewer than `run` words can't be found, equal items are each reported, repeated
    documents count once, no items give no rows. Documents are scanned once; only found pairs are shuffled, and beyond
    `block_chars` of evaluation text windows that pass the filter and candidates.
    """
    sc = documents.sparkSession.sparkContext
    kind = documents.schema[doc_key].dataType
    schema = T.StructType([T.StructField(doc_key, kind), T.StructField(item_key, T.LongType()), *([T.StructField(c, T.LongType()) for c in ("span_words", "equal_words")] if tolerant else [])])
    docs = spread(documents.select(doc_key, text).where(F.col(text).isNotNull()))
    few = _small(items, item_key, text, block_chars)
    if few is None:
        out = _leaked_by_join(documents, items, doc_key, item_key, text, run, tolerant, schema)
        return _once(out, doc_key, item_key, tolerant)
    shared = sc.broadcast(build_index(few, once=not tolerant))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        get = index.vocabulary.get
        for b in batches:
            flat: list[int] = []
            starts = [0]
            for t in b.column(1).to_pylist():
                flat += [get(w, 0) for w in _WORD.findall(t.lower())]
                flat += [0] * index.span  # no window reaches into the next document
                starts.append(len(flat))
            ids = np.array(flat, dtype=np.int32)
            bounds = np.array(starts)
            rows, extra = [], []
            if tolerant:
                a, _ = hits(ids, index)
                for d in np.unique(np.searchsorted(bounds, a, side="right") - 1).tolist():
                    for item, span, equal in tolerant_overlaps(ids[bounds[d] : bounds[d + 1]], index, run):
                        rows.append((d, item))
                        extra.append((span, equal))
            else:
                a, item = exact_items(ids, index, run)
                d = np.searchsorted(bounds, a, side="right") - 1
                rows = np.unique(np.stack([d, item], axis=1), axis=0).tolist() if len(d) else []
            cols = [b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64())]
            if tolerant:
                cols += [pa.array([e[k] for e in extra], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return _once(docs.mapInArrow(scan, schema), doc_key, item_key, tolerant)


def _once(out: DataFrame, doc_key: str, item_key: str, tolerant: bool) -> DataFrame:
    if not tolerant:
        return out.distinct()
    best = out.groupBy(doc_key, item_key).agg(F.max(F.struct("equal_words", "span_words")).alias("b"))
    return best.select(doc_key, item_key, "b.span_words", "b.equal_words")
