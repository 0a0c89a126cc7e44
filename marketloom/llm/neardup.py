"""Near-duplicate records with small edits, by Order MinHash.

A sketch takes, under one hash function, the two smallest distinct k-mers of a text, each where it first stands
(likeness is that of sets, so a text pasted twice is the same text), and keeps them
in text order if they stand within NEAR k-mers of each other, so that local order tells texts apart but a moved
block doesn't; two texts share it with a probability of about their likeness squared. A band is two sketches; texts that share a band are candidates. One-bit minima of 64 functions
travel with every band, so that chance candidates are told apart inside the join, by a bit count, before any
pair is written. What is left is verified exactly on the whole k-mer sets, or by banded alignment.

Texts with equal k-mer sets are one node: bands, candidates and verification work on nodes, and members are
expanded last. A block of a task sends a node only once, so a group of copies, however large, meets as few nodes.

Buckets of bands are read as sorted streams, and pairs are written only within buckets of up to HOT nodes. What
boilerplate puts into larger ones, whether found in the stream or already known for a heavy share of a block of
rows (such buckets are never shuffled), goes to an exact join instead: nodes are ordered by how rare their k-mers are
and meet by the rare ones that two alike sets can't but share (prefix filter). Nothing is cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.components import components
from marketloom.tables import cut_lineage, spread

K, LEAST_WORDS, LIKENESS = 3, 40, 0.6
BANDS, BITS = 32, 64
#: Within this distance the order of two k-mers is part of a sketch.
NEAR = 16
#: Candidates differ in at most so many of the 64 one-bit minima (at a likeness of 0.6 they differ in 12.8 +- 3.2, so
#: that one pair in some 100,000 at exactly 0.6 is lost by it).
MAX_DIFFERENT = 26
#: Buckets of more nodes aren't paired off directly.
HOT = 256
#: Rows of one block; a bucket that holds over one in SHARE of a block's nodes, and over LEAST of them, is reported.
BLOCK, SHARE, LEAST = 65_536, 512, 64
#: Bytes that one partition of bands or of sets may hold, by estimate.
PARTITION = 64 << 20
_WORD = re.compile(r"[a-z0-9]+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_words: dict[str, int] = {}


def _word_hashes(words: list[str]) -> np.ndarray:
    if len(_words) > 1_000_000:
        _words.clear()
    get = _words.get
    out = []
    for w in words:
        h = get(w)
        if h is None:
            h = _words[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def kmers(texts: list[str], k: int = K, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that have at least `least_words` words, k-mer hashes of these rows in text order, start of each row)"""
    rows, flat, lengths = [], [], []
    for i, t in enumerate(texts):
        w = _WORD.findall(t.lower())
        if len(w) >= max(least_words, k):
            rows.append(i)
            flat += w
            lengths.append(len(w))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    h, n = _word_hashes(flat), np.array(lengths)
    grams = len(h) - k + 1
    g = np.zeros(grams, np.uint64)
    for j in range(k):
        g = _mix(g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + grams])
    ends = np.cumsum(n)
    inside = np.ones(grams, bool)
    for j in range(1, k):
        cut = ends[:-1] - j
        inside[cut] = False
    counts = n - k + 1
    return np.array(rows), g[inside], np.concatenate([[0], np.cumsum(counts)[:-1]])


def occurrences(g: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For every k-mer, how many equal ones stand before it in its row."""
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(g))))
    order = np.lexsort((np.arange(len(g)), g, row))
    same = (g[order][1:] == g[order][:-1]) & (row[order][1:] == row[order][:-1])
    idx = np.arange(len(g))
    first = np.concatenate([[True], ~same])
    run = idx - np.maximum.accumulate(np.where(first, idx, 0))
    out = np.empty(len(g), np.int64)
    out[order] = run
    return out


def sketches(grams: np.ndarray, starts: np.ndarray, bands: int = BANDS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(rows x bands signatures of 32 bits, one 64-bit word of one-bit minima per row)"""
    n = len(starts)
    seeds = np.random.default_rng(7).integers(1, 1 << 63, size=max(2 * bands, bits), dtype=np.uint64) | np.uint64(1)
    index = np.arange(len(grams), dtype=np.uint64)
    sig = np.zeros((n, bands), np.uint64)
    word = np.zeros(n, np.uint64)
    for f, seed in enumerate(seeds):
        x = (grams ^ (grams >> np.uint64(32)) ^ seed) * (seed | np.uint64(1))
        x = (x & ~_LOW) | index
        least = np.minimum.reduceat(x, starts)
        a = (least & _LOW).astype(np.int64)
        if f < bits:
            word |= ((grams[a] * seed) >> np.uint64(63)) << np.uint64(f)
        if f < 2 * bands:
            x[a] = np.iinfo(np.uint64).max
            second = np.minimum.reduceat(x, starts)
            b = (second & _LOW).astype(np.int64)
            single = second == np.iinfo(np.uint64).max  # one k-mer only
            b = np.where(single, a, b)
            turn = (np.abs(a - b) <= NEAR) & (a > b)  # neighbours in text order, others by hash
            pair = _mix(grams[np.where(turn, b, a)] * np.uint64(3) + _mix(grams[np.where(turn, a, b)]))
            sig[:, f // 2] = _mix(sig[:, f // 2] + pair)
    return (sig & _LOW).astype(np.uint32).view(np.int32).reshape(n, bands), word.view(np.int64)


def banded_distances(a: list[np.ndarray], b: list[np.ndarray], band: int = 32) -> np.ndarray:
    """Edit distances of pairs of sequences by alignment within `band` of the diagonal; where that can't reach the end, the
    longer length. All pairs advance together, one row of the alignment at a time."""
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows, width = len(a), 2 * band + 1
    far = np.int32(1 << 29)
    longest = int(n.max(initial=0))
    top_m = int(m.max(initial=0))
    x = np.zeros((rows, longest + 1), np.int64)
    y = np.zeros((rows, max(top_m, longest) + width + 2), np.int64)
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        x[i, : len(p)] = p
        y[i, band : band + len(q)] = q  # y[:, band + j] is the j-th
    k = np.arange(width, dtype=np.int32)
    # prev[k] is the distance of i items of a and j = i + k - band of b.
    j = k[None, :] - band
    prev = np.where((j >= 0) & (j <= m[:, None]), j, far).astype(np.int32)
    out = np.where(n == 0, m, np.maximum(n, m)).astype(np.int64)
    for i in range(1, longest + 1):
        j = i + k[None, :] - band
        other = y[:, i - 1 : i - 1 + width]  # item j - 1 of b
        cost = prev + (other != x[:, i - 1 : i])
        np.minimum(cost[:, :-1], prev[:, 1:] + 1, out=cost[:, :-1])
        cost = np.where((j < 0) | (j > m[:, None]), far, np.where(j == 0, i, cost)).astype(np.int32)
        cost = np.minimum.accumulate(cost - k[None, :], axis=1) + k[None, :]
        prev = np.where(j <= m[:, None], cost, far).astype(np.int32)
        done = np.nonzero(n == i)[0]
        if len(done):
            at = m[done] - i + band
            ok = (at >= 0) & (at < width)
            d = prev[done[ok], at[ok]]
            out[done[ok]] = np.where(d < far // 2, d, out[done[ok]])
    return out


def banded_similarity(a: list, b: list, band: int = 32) -> float:
    """1 - edits / longer length, by alignment within `band` of the diagonal; 0 where the lengths differ by more."""
    if not a and not b:
        return 1.0
    ids: dict = {}
    p, q = (np.array([ids.setdefault(w, len(ids) + 1) for w in x], np.int64) for x in (a, b))
    return float(1 - banded_distances([p], [q], band)[0] / max(len(a), len(b)))


_FEATURES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("origin", T.LongType()),
        T.StructField("node", T.LongType()),
        T.StructField("bits", T.LongType()),
        T.StructField("bands", T.ArrayType(T.IntegerType())),
        T.StructField("grams", T.ArrayType(T.IntegerType())),
        T.StructField("heavy", T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())]))),
    ]
)


def _heavy(blocks: list[np.ndarray]) -> list[tuple[int, int]]:
    """Buckets with a large share of a block of signatures, with their counts there. A bucket with over a
    SHARE-th of all nodes has at least that share of some block."""
    sig = np.concatenate(blocks)
    least = max(LEAST, len(sig) // SHARE)
    out = []
    if len(sig) > least:
        for band in range(sig.shape[1]):
            v, n = np.unique(sig[:, band], return_counts=True)
            out += [((band << 32) | (x & 0xFFFFFFFF), c) for x, c in zip(v[n > least].tolist(), n[n > least].tolist(), strict=True)]
    return out


def features(items: DataFrame, key: Column, origin: Column, texts: Column, bands: int = BANDS, k: int = K, least_words: int = LEAST_WORDS, words: bool = False) -> DataFrame:
    """One row per text of enough words: its id and origin, its node (hash of the k-mer set; with `words`, of the sequence of
    words), and, on the first row of each node in a block, the node's bits, bands and k-mer set
    (32 bits each, sorted), or with `words` its word hashes in text order. Rows without a node report heavy buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        block: list[np.ndarray] = []
        ids = origins = None

        def report() -> pa.RecordBatch | None:
            found = _heavy(block) if block else []
            block.clear()
            seen.clear()
            if not found:
                return None
            nothing = [pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.list_(pa.int32()))] * 2
            return pa.RecordBatch.from_arrays([*nothing, pa.array([[{"key": x, "n": c} for x, c in found]], heavy_type)], names=[f.name for f in _FEATURES])

        heavy_type = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                texts = part.column(2).to_pylist()
                rows, g, starts = kmers(texts, k, least_words)
                if not len(rows):
                    continue
                occ = occurrences(g, starts)
                once = occ == 0
                sig, word = sketches(_mix(g[once]), np.concatenate([[0], np.cumsum(np.add.reduceat(once, starts, dtype=np.int64))[:-1]]), bands)
                if words:
                    _, g, starts = kmers([texts[i] for i in rows], 1, max(least_words, k))
                ends = np.append(starts[1:], len(g))
                short = (g >> np.uint64(32)).astype(np.uint32).view(np.int32)
                nodes, sets, new = [], [], []
                for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    own = g[s:e] if words else np.unique(g[s:e])
                    node = xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)
                    nodes.append(node)
                    if node in seen:
                        sets.append(None)
                        continue
                    seen.add(node)
                    new.append(i)
                    sets.append(short[s:e] if words else np.unique(short[s:e]))
                keep = np.zeros(len(rows), bool)
                keep[new] = True
                block.append(sig[keep])
                ids, origins = part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, origins, pa.array(nodes, pa.int64()), pa.array(word, mask=~keep),
                        pa.array([r if f else None for r, f in zip(sig.tolist(), keep.tolist(), strict=True)], pa.list_(pa.int32())), pa.array(sets, pa.list_(pa.int32())), pa.nulls(len(rows), heavy_type),
                    ],
                    names=[f.name for f in _FEATURES],
                )
                if sum(map(len, block)) >= BLOCK and (r := report()) is not None:
                    yield r
        if (r := report()) is not None:
            yield r

    return spread(items.select(key.cast("long").alias("id"), origin.alias("origin"), texts.alias("text")).where("text is not null")).mapInArrow(run, _FEATURES)


_PAIRS = "a long, b long"


def _bucket_pairs(max_different: int, hot: int, flush: int = 1 << 18):
    """Reads rows (key, node, bits) sorted by key and node; gives the pairs (a, b), a < b, of nodes that share a key and
    differ in few bits, and (node, null) for the nodes of keys with more than `hot` nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.empty(0, np.int64),) * 3
        rest, wide = empty, None  # rows of the last key so far; the key, once known to be hot
        made: list[np.ndarray] = []

        def give(force: bool = False) -> Iterator[pa.RecordBatch]:
            if made and (force or sum(len(x) for x in made) >= flush):
                u = np.unique(np.concatenate(made).view([("a", np.int64), ("b", np.int64), ("w", np.int8)]))
                made.clear()
                yield pa.RecordBatch.from_arrays([pa.array(u["a"]), pa.array(u["b"], mask=u["w"] == 1)], names=["a", "b"])

        def packed(a: np.ndarray, b: np.ndarray, w: int) -> np.ndarray:
            out = np.empty(len(a), [("a", np.int64), ("b", np.int64), ("w", np.int8)])
            out["a"], out["b"], out["w"] = a, b, w
            return out

        def settle(key: np.ndarray, node: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(key):
                return
            starts = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
            sizes = np.diff(np.append(starts, len(key)))
            big = np.repeat(sizes > hot, sizes)
            if big.any():
                made.append(packed(node[big], np.zeros(int(big.sum()), np.int64), 1))
                key, node, bits = key[~big], node[~big], bits[~big]
            at, d = np.arange(len(key)), 1
            while True:
                at = at[at + d < len(key)]
                at = at[key[at] == key[at + d]]
                if not len(at):
                    break
                near = at[np.bitwise_count((bits[at] ^ bits[at + d]).view(np.uint64)) <= max_different]
                made.append(packed(node[near], node[near + d], 0))  # nodes ascend within a key
                yield from give()
                d += 1
            yield from give()

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            key, node, bits = (np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True))
            if not len(key):
                continue
            same = np.append(False, (key[1:] == key[:-1]) & (node[1:] == node[:-1]))
            key, node, bits = key[~same], node[~same], bits[~same]
            if wide is not None:
                on = key == wide
                made.append(packed(node[on], np.zeros(int(on.sum()), np.int64), 1))
                yield from give()
                key, node, bits = key[~on], node[~on], bits[~on]
                if not len(key):
                    rest = empty
                    continue
                wide = None
            last = int(np.searchsorted(key, key[-1], side="left"))
            yield from settle(key[:last], node[:last], bits[:last])
            rest = (key[last:], node[last:], bits[last:])
            if len(rest[0]) > hot:
                wide = int(key[-1])
                made.append(packed(rest[1], np.zeros(len(rest[1]), np.int64), 1))
                rest = empty
        if len(rest[0]):
            yield from settle(*rest)
        yield from give(force=True)

    return run


def prefix_pairs(sets: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """(a, b), a < b: pairs of `sets` (node, grams) that can have `likeness` in common, exactly and without sketches:
    two such sets share one of their rarest k-mers, as many as a set may lack plus one. Rare is by count
    over all of `sets`, so that what many share is looked at last, or, as far as it is a `likeness`-th of a set, never."""
    own = sets.select("node", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    common = own.groupBy("gram").agg(F.count(F.lit(1)).alias("f"))
    ranked = own.join(common.hint("merge"), "gram").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("f", "gram"))).alias("g"))
    prefix = ranked.select("node", "n", F.posexplode(F.slice("g", F.lit(1), (F.col("n") - F.ceil(F.col("n") * likeness) + 1).cast("int"))).alias("at", "g"))
    x, y = (prefix.select(F.col("g.gram").alias("gram"), *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "at"))) for s in "ab")
    reach = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))  # if it is the first one shared, so many can be
    fits = (F.col("node_a") < F.col("node_b")) & (F.least("n_a", "n_b") >= likeness * F.greatest("n_a", "n_b")) & (reach * (1 + likeness) >= likeness * (F.col("n_a") + F.col("n_b")))
    return x.join(y.hint("merge"), "gram").where(fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def candidates(f: DataFrame, max_different: int = MAX_DIFFERENT, hot: int = HOT, parts: int = 8) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) of nodes that share a band and few of whose bits differ, nodes of hot buckets as (node))."""
    rows = f.where("bands is not null").select("node", "bits", F.posexplode("bands").alias("band", "sig"))
    rows = rows.select((F.shiftleft(F.col("band").cast("long"), 32).bitwiseOR(F.col("sig").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("key"), "node", "bits")
    total = f.where("bands is not null").count()
    # At most SHARE keys a band can hold a SHARE-th of all nodes, so that this list has some 16,000 at most, whatever the data.
    heavy = [r[0] for r in f.where("heavy is not null").select(F.explode("heavy").alias("h")).groupBy("h.key").agg(F.sum("h.n").alias("n")).where(F.col("n") > max(LEAST, total // SHARE)).select("key").collect()]
    known = None
    if heavy:
        known, rows = rows.where(F.col("key").isin(heavy)).select("node"), rows.where(~F.col("key").isin(heavy))
    made = cut_lineage(rows.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(_bucket_pairs(max_different, hot), _PAIRS).groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one"))
    crowded = made.where("b is null").select(F.col("a").alias("node"))
    return made.where("b is not null"), (crowded if known is None else crowded.unionByName(known)).distinct()


def _partitions(f: DataFrame, bytes_a_row: int) -> int:
    """Partitions of bounded size for what `f` will be spread to, at least as many as the session asks for."""
    return max(int(f.sparkSession.conf.get("spark.sql.shuffle.partitions")), f.where("bands is not null").count() * bytes_a_row // PARTITION + 1)


def similar_nodes(f: DataFrame, likeness: float = LIKENESS, max_different: int = MAX_DIFFERENT, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: nodes whose k-mer sets have at least `likeness` of their union in common; written to the shared
    folder, so that `f` and the sets can be let go.

    Sets are read on both sides of a join, which Spark's exchange reuse doesn't see through here: they are kept
    partitioned by their node, so that they are shuffled once."""
    n = _partitions(f, 32 * 40)
    pairs, crowded = candidates(f, max_different, hot, n)
    sets = f.where("bands is not null").select("node", "grams").repartition(n, "node").groupBy("node").agg(F.first("grams").alias("grams")).persist(StorageLevel.MEMORY_AND_DISK)
    if not crowded.isEmpty():
        more = prefix_pairs(sets.join(crowded.hint("merge"), "node", "left_semi"), likeness)
        pairs = pairs.unionByName(more).distinct()
    pairs = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")).hint("merge"), "a")
    pairs = pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")).hint("merge"), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    out = cut_lineage(pairs.where(both >= likeness * (F.size("ga") + F.size("gb") - both)).select("a", "b"))
    sets.unpersist()
    return out


def _origin(columns: tuple[str, ...]) -> Column:
    return F.xxhash64(*(F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in columns))


def _joined(columns: tuple[str, ...]) -> Column:
    return F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in columns))


def near_duplicate_pairs(items: DataFrame, key: str = "item_id", origin: tuple[str, ...] = ("source", "source_id"), texts: tuple[str, ...] = ("title", "description"), likeness: float = LIKENESS, hot: int = HOT) -> DataFrame:
    """(key_a, key_b), a < b: rows of different origin, each of at least 40 words, whose sets of three-word
    runs have at least `likeness` of their union in common. Words are maximal runs of a-z and 0-9 after
    lower-casing the texts joined by line breaks.

    Candidates come from Order MinHash and are missed with a probability of about 0.01 at a likeness of
    exactly 0.6 and of under 0.001 from 0.7 on, whether or not runs repeat in a text; by the bit filter alone, of
    about 0.00002 at 0.6; what is found is exact. Defined edge cases: null texts count
    as empty, a null key gives no pair, null parts of the origin are equal to each other only, very long texts are
    read whole, repeated rows of one origin make no pair, no rows give no pairs; clashing column names don't
    matter. The pass over the texts is kept in memory or on disk until node pairs and members are written.
    """
    f = features(items.where(F.col(key).isNotNull()), F.col(key), _origin(origin), _joined(texts)).persist(StorageLevel.MEMORY_AND_DISK)
    nodes = similar_nodes(f, likeness, hot=hot)
    members = cut_lineage(f.where("node is not null").select("node", "id", "origin"))
    f.unpersist()
    a = members.select(F.col("node").alias("a"), F.col("id").alias("i"), F.col("origin").alias("oi"))
    b = members.select(F.col("node").alias("b"), F.col("id").alias("j"), F.col("origin").alias("oj"))
    across = nodes.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where("oi <> oj").select("i", "j")
    within = a.join(b.hint("merge"), F.col("a") == F.col("b")).where("i < j and oi <> oj").select("i", "j")
    return across.unionByName(within).select(F.least("i", "j").alias(f"{key}_a"), F.greatest("i", "j").alias(f"{key}_b"))


#: Defaults of `edit_classes`.
EDIT_WORDS, EDIT_LIKENESS, BAND = 5, 0.8, 32
#: Pairs aligned at a time.
LOT = 256


def edit_classes(items: DataFrame, key: str = "item_id", texts: tuple[str, ...] = ("title", "description"), likeness: float = EDIT_LIKENESS, band: int = BAND) -> DataFrame:
    """(key, class_id, links): rows whose texts differ by small edits. A link joins two different word sequences of at least
    40 words whose banded alignment leaves 1 - edits / longer length at `likeness` or more; a class is a
    connected component of links, named after its least node; equal texts are one node and share its links. Rows of
    texts that are alone give no row. Candidates come from Order MinHash over runs of five words.

    Edge cases as in `near_duplicate_pairs`; sequences that differ in length by more than `band` words aren't linked;
    equal keys each give their row.
    """
    f = features(items.where(F.col(key).isNotNull()), F.col(key), F.lit(0).cast("long"), _joined(texts), k=EDIT_WORDS, words=True).persist(StorageLevel.MEMORY_AND_DISK)
    n = _partitions(f, 32 * 40)
    pairs, crowded = candidates(f, parts=n)
    seqs = f.where("bands is not null").select("node", "grams").repartition(n, "node").groupBy("node").agg(F.first("grams").alias("grams")).persist(StorageLevel.MEMORY_AND_DISK)
    if not crowded.isEmpty():
        # Of the longer length L, at least likeness * L words match, so that of the union of numbered words (each with
        # how often it stood before) at least this share is common.
        numbered = F.transform("grams", lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice("grams", 1, i), lambda y: y == x))))
        more = prefix_pairs(seqs.join(crowded.hint("merge"), "node", "left_semi").select("node", numbered.alias("grams")), likeness / (2 - likeness))
        pairs = pairs.unionByName(more).distinct()
    pairs = pairs.join(seqs.select(F.col("node").alias("a"), F.col("grams").alias("ga")).hint("merge"), "a")
    pairs = pairs.join(seqs.select(F.col("node").alias("b"), F.col("grams").alias("gb")).hint("merge"), "b")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in (2, 3):
                col = batch.column(c)
                flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *col.value_lengths().to_pylist()])
                sides.append([flat[i:j].astype(np.int64) + (1 << 33) for i, j in zip(ends, ends[1:])])
            near = [i for i, (p, q) in enumerate(zip(*sides, strict=True)) if abs(len(p) - len(q)) <= min(band, (1 - likeness) * max(len(p), len(q)))]
            near.sort(key=lambda i: len(sides[0][i]))
            good = []
            at = 0
            while at < len(near):
                lot = near[at : at + max(1, min(LOT, (1 << 22) // max(1, len(sides[0][near[min(at + LOT, len(near)) - 1]]))))]
                at += len(lot)
                p, q = ([side[i] for i in lot] for side in sides)
                d = banded_distances(p, q, band)
                longer = np.array([max(len(u), len(v)) for u, v in zip(p, q, strict=True)])
                good += [i for i, ok in zip(lot, (longer - d >= likeness * longer).tolist(), strict=True) if ok]
            take = pa.array(sorted(good), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], names=["a", "b"])

    links = cut_lineage(pairs.select("a", "b", "ga", "gb").mapInArrow(align, _PAIRS))
    seqs.unpersist()
    members = cut_lineage(f.where("node is not null").select("node", "id"))
    f.unpersist()
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    classes = components(links) if not links.isEmpty() else links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    copies = members.groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
    known = copies.join(classes.hint("merge"), "node", "left").join(degree.hint("merge"), "node", "left").where("rows > 1 or label is not null")
    known = known.select("node", F.coalesce("label", "node").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(known.hint("merge"), "node").select(F.col("id").alias(key), "class_id", "links")
