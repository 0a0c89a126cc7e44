import bisect
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from marketloom.llm import leakage, packing, quantiles, textstats
from pyspark.sql import functions as F

V = textstats.Vocabulary([("en", w) for w in "the of and a to in is you that it he was for on are as with his they at".split()] + [("de", w) for w in "der die das und ist".split()])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab the,.\n\t ", max_size=400), st.lists(st.integers(1, 399), max_size=12), st.integers(3, 40), st.randoms())
def test_any_cuts_and_merges_give_the_whole(text, cuts, piece, rnd):
    before, textstats.PIECE = textstats.PIECE, piece
    try:
        at = sorted({0, *(c for c in cuts if c < len(text))})
        parts = [textstats.partial(text[a:b], V, a) for a, b in zip(at, [*at[1:], len(text)], strict=True)]
        while len(parts) > 1:  # in any order
            k = rnd.randrange(len(parts) - 1)
            parts[k : k + 2] = [textstats.merge(parts[k], parts[k + 1], V)]
        assert textstats.finish(parts[0], V) == textstats.count_text(text, V)
    finally:
        textstats.PIECE = before


def test_one_very_long_line_counts_alike_at_every_chunk(spark):
    words = spark.createDataFrame([("en", w) for w in V.by_word], "lang string, word string")
    line = "The cat and the dog were in a house that he was to see as it is on the hill. " * 160 + "qx7 zzkk vvv9 " * 200 + "y" * 9000
    df = spark.createDataFrame([(1, line), (2, line + "\n" + line)], "doc_id long, text string")
    want = sorted(map(tuple, textstats.document_counts(df, words, chunk=1 << 20).collect()))
    for chunk in (3000, 5000, 6007):
        assert sorted(map(tuple, textstats.document_counts(df, words, chunk=chunk).collect())) == want


def test_chunked_operator(spark):
    words = spark.createDataFrame([("en", w) for w in V.by_word], "lang string, word string")
    line = "The cat and the dog were in a house that he was to see as it is on the hill.\n"
    docs = [(1, line * 700), (2, None), (3, ""), (4, "| a | b |\n" * 30), (5, "THE CAT AND THE DOG WERE IN A HOUSE THAT HE KNEW"), (5, "THE CAT AND THE DOG WERE IN A HOUSE THAT HE KNEW")]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, words string")
    a, b = (sorted(map(tuple, textstats.document_counts(df, words, chunk=c).collect())) for c in (1 << 20, 5000))
    assert a == b
    got = {r.doc_id: r for r in textstats.statistics(textstats.document_counts(df, words)).collect()}
    assert not got[1].not_prose and got[4].not_prose and not got[5].not_prose and got[1].ended_line_share == 1 and got[2].word_count == 0
    assert textstats.document_counts(df.limit(0), words).count() == 0


def test_labels(spark, data):
    from marketloom.tables import load

    s = textstats.statistics(textstats.document_counts(load(spark, data, "documents"), load(spark, data, "common_words")))
    x = s.join(load(spark, data, "doc_labels"), "doc_id")
    assert x.where(F.col("not_prose") == (F.col("doc_kind") == "prose")).count() == 0


def test_leaks_against_brute_force(spark):
    r = random.Random(3)
    words = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(words, k=r.randint(5, 60)))) for i in range(20)] + [(90, None), (91, ""), (92, None)]
    docs = []
    for i in range(60):
        w = r.choices(words, k=r.randint(0, 80))
        src = r.choice(items[:20])[1].split()
        n = r.randint(8, 16)
        s = r.randrange(max(1, len(src) - n))
        at = r.randrange(len(w) + 1)
        docs.append((i, " ".join(w[:at] + src[s : s + n] + w[at:]).replace("v1 ", "V1, *")))
    docs += [(60, None), (61, ""), (62, items[3][1]), (62, items[3][1])]
    runs = {}
    for k, t in items:
        w = leakage.words_of(t or "")
        for j in range(len(w) - 11):
            runs.setdefault(tuple(w[j : j + 12]), set()).add(k)
    want = {(d, k) for d, t in docs for w in [leakage.words_of(t or "")] for j in range(len(w) - 11) for k in runs.get(tuple(w[j : j + 12]), ())}
    dd = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, test_item_id string")
    ii = spark.createDataFrame(items, "test_item_id long, text string")
    for block in (8_000_000, 300):
        got = [tuple(x) for x in leakage.leaked(dd, ii, block_chars=block).collect()]
        assert set(got) == want and len(got) == len(want)
    assert leakage.leaked(dd, ii.limit(0)).count() == 0 and leakage.leaked(dd.limit(0), ii).count() == 0
    # One word in eight replaced: no exact run, found with tolerance.
    w = leakage.words_of(max((t for _, t in items if t), key=len))
    changed = [x if j % 8 != 7 else "other" for j, x in enumerate(w)]
    one = spark.createDataFrame([(1, " ".join(changed))], "doc_id long, text string")
    assert leakage.leaked(one, ii).count() == 0
    (row,) = leakage.leaked(one, ii, tolerant=True).collect()
    assert row.equal_words >= 0.8 * row.span_words >= 0.8 * 12


def test_tolerant_recall(spark):
    """Passages of 20 words with every word replaced with a probability of a tenth, or two swapped for others at random places; the
    truth is an overlap of 12 words or more along the pasted diagonal with 80 % equal from end to end."""
    r = random.Random(12)
    items = [(i, " ".join(f"i{i}w{r.randrange(40)}" for _ in range(60))) for i in range(12)]
    docs, want = [], set()
    for d in range(240):
        i, at = r.randrange(12), r.randrange(40)
        passage = items[i][1].split()[at : at + 20]
        changed = [w if r.random() > 0.1 else f"x{r.randrange(9)}" for w in passage]
        equal = [a == b for a, b in zip(passage, changed, strict=True)]
        if any(equal[a] and equal[b - 1] and b - a >= 12 and sum(equal[a:b]) >= 0.8 * (b - a) for a in range(20) for b in range(a + 1, 21)):
            want.add((d, i))
        docs.append((d, " ".join([f"d{r.randrange(500)}" for _ in range(15)] + changed + [f"d{r.randrange(500)}" for _ in range(15)])))
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "test_item_id long, text string")
    for block in (8_000_000, 100):
        got = {(x.doc_id, x.test_item_id) for x in leakage.leaked(dd, ii, tolerant=True, block_chars=block).collect()}
        assert got <= {(d, i) for d, i in got if i == next(k for k, t in items if set(t.split()) & set(docs[d][1].split()))}
        assert len(got & want) >= 0.9 * len(want) > 150
    repeated = spark.createDataFrame([(1, "a b " * 20_000), (2, "c " * 11)], "doc_id long, text string")
    again = spark.createDataFrame([(1, "a b " * 2000), (2, "c " * 3000)], "test_item_id long, text string")
    for block in (8_000_000, 100):
        assert [tuple(x) for x in leakage.leaked(repeated, again, block_chars=block).collect()] == [(1, 1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=80), st.lists(st.integers(1, 40), min_size=1, max_size=3, unique=True))
def test_packing(sizes, capacities):
    caps = sorted(capacities)
    out = packing.pack(sizes, caps)
    used, total = {}, {}
    for p in out:
        used[p.tier, p.container] = used.get((p.tier, p.container), 0) + p.tokens
        total[p.item] = total.get(p.item, 0) + p.tokens
    assert total == dict(enumerate(sizes))
    assert all(n <= caps[t] for (t, _), n in used.items())
    for p in out:
        assert p.piece == 0 or sizes[p.item] > caps[-1]


def test_packed_operator(spark):
    pytest.importorskip("tiktoken")
    docs = spark.createDataFrame([(i, "deal " * (i % 37), "c") for i in range(300)] + [(900, None, "c"), (901, "", "c"), (902, "long text here " * 3000, "c"), (1, "a", "c"), (1, "a", "c")], "doc_id long, text string, piece string")
    caps = spark.createDataFrame([(1, 64), (2, 512), (3, None), (4, 0)], "size_id long, capacity_tokens int")
    out = packing.packed(docs, caps, lot=100).cache()
    per = out.groupBy("container_id", "capacity_tokens").agg(F.sum("n_tokens").alias("n"))
    assert per.where("n > capacity_tokens").count() == 0
    want = {(r.doc_id, r.n) for r in packing.token_counts(docs).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert {(r.doc_id, r.n) for r in out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} == want
    assert packing.packed(docs.limit(0), caps).count() == 0
    with pytest.raises(ValueError):
        packing.packed(docs, caps.limit(0))


def test_percentiles(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", "cold", None]), r.choice([None, float("nan"), r.gauss(0, 9), 5.0, 5.0]), i % 7, 0) for i in range(6000)] + [("none", None, 0, 0), ("one", 3.0, 1, 0), ("inf", float("inf"), 1, 0), ("inf", 1.0, 1, 0)]
    df = spark.createDataFrame(rows, "query string, total_price double, day int, n int")
    by = {}
    for q, v, *_ in rows:
        if v is not None and v == v:
            by.setdefault(q, []).append(v)
    want = {(q, p): (len(vs), sorted(vs)[max(1, (len(vs) * p + 99) // 100) - 1]) for q, vs in by.items() for p in quantiles.PERCENTILES}
    got = {(x.query, x.percentile): (x.n, x.value) for x in quantiles.select_percentiles(df, "query", "total_price", settle=50).collect()}
    assert got == want
    parts = quantiles.part_summaries(df, "query", "total_price", "day")
    for x in quantiles.combine(parts, "query").collect():
        vs = sorted(by[x.query])
        k = max(1, (len(vs) * x.percentile + 99) // 100)
        lo, hi = (max(0, k - 1 - x.rank_error), min(len(vs) - 1, k - 1 + x.rank_error))
        assert x.n == len(vs) and vs[lo] <= x.value <= vs[hi]
    assert quantiles.select_percentiles(df.limit(0), "query", "total_price").count() == 0


def test_combined_stays_within_the_bound_over_hundreds_of_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    try:
        rows = spark.range(0, 480_000, 1, 16).select(F.lit("hot").alias("query"), (F.xxhash64("id") / 1e12).alias("total_price"), (F.col("id") % 2).alias("day"))
        vs = sorted(x.total_price for x in rows.collect())
        out = quantiles.combine(quantiles.part_summaries(rows, "query", "total_price", "day"), "query").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {x.percentile for x in out} == set(quantiles.PERCENTILES)
    for x in out:
        k = max(1, (len(vs) * x.percentile + 99) // 100)
        off = abs(bisect.bisect_left(vs, x.value) + 1 - k)
        assert x.n == len(vs) and off <= x.rank_error <= 0.001 * x.n


def test_tree_of_many_summaries_keeps_the_bound():
    r = np.random.default_rng(5)
    tree, every = quantiles._Tree(), []
    for _ in range(3000):
        v = r.normal(size=2000)
        every.append(v)
        a, w, e = quantiles._compress(v, np.ones(len(v), np.int64), 0)
        tree.add(len(v), e, a, w)
    v, w, err = tree.settled()
    vs = np.sort(np.concatenate(every))
    under = np.searchsorted(vs, v, side="right") - np.cumsum(w)
    assert tree.n == len(vs) == w.sum() and 0 <= under.min() and under.max() <= err <= 0.002 * len(vs) and len(v) < 20_000


def test_select_by_rounds_only(spark):
    """With ranges settled at one row, everything is found by pivots; rows are written anew along the way."""
    r = random.Random(2)
    rows = [(q, v) for q, n in (("hot", 3000), ("few", 3), (None, 40), ("one", 1)) for v in [r.choice((r.lognormvariate(3, 2), 7.0, float("inf"), float("-inf"), -0.0)) for _ in range(n)]]
    rows += [("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "query string, total_price double").repartition(7)
    want = {}
    for q in {q for q, _ in rows} - {"none"}:
        vs = sorted(v for k, v in rows if k == q)
        want |= {(q, p): (len(vs), vs[max(1, (len(vs) * p + 99) // 100) - 1]) for p in quantiles.PERCENTILES}
    for settle in (1, 64, quantiles.SETTLE):
        got = quantiles.select_percentiles(df, "query", "total_price", settle=settle).collect()
        assert {(x.query, x.percentile): (x.n, x.value) for x in got} == want and len(got) == len(want)


def test_ranges_joined_by_key(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW_GROUPS", 0)
    df = spark.range(2000).select((F.col("id") % 3).cast("string").alias("query"), F.col("id").cast("double").alias("total_price"))
    got = {(x.query, x.percentile): x.value for x in quantiles.select_percentiles(df, "query", "total_price").collect()}
    assert got == {(str(q), p): float(q + 3 * (max(1, (n * p + 99) // 100) - 1)) for q in range(3) for n in [len(range(q, 2000, 3))] for p in quantiles.PERCENTILES}


def test_parts_and_totals(spark):
    rows = [("a", d, float(v)) for d in range(5) for v in range(d * 10, d * 10 + 10)] + [(None, None, 1.0), ("a", 1, None)]
    got = quantiles.part_and_total_percentiles(spark.createDataFrame(rows, "query string, day int, total_price double"), "query", "total_price", "day").collect()
    of = {(x.query, x.scope, x.day, x.percentile): (x.n, x.value, x.rank_error) for x in got}
    assert len(of) == len(got) == 4 * (5 + 1 + 1 + 1)
    assert of["a", "all", None, 90] == (50, 44.0, 0) and of["a", "part", 3, 50] == (10, 34.0, 0) and of[None, "part", None, 99] == (1, 1.0, 0)
