import random

from marketloom.llm import neardup

S = "item_id long, source string, source_id string, title string, description string, node string"


def shingles(t):
    w = neardup._WORD.findall(t.lower())
    return set(zip(w, w[1:], w[2:], strict=False)), len(w)


def brute(rows, likeness=0.6):
    out = set()
    for i, (a, sa, ia, ta, da, _) in enumerate(rows):
        for b, sb, ib, tb, db, _ in rows[i + 1 :]:
            (x, n), (y, m) = shingles(f"{ta or ''}\n{da or ''}"), shingles(f"{tb or ''}\n{db or ''}")
            if n >= 40 and m >= 40 and (sa, ia) != (sb, ib) and len(x & y) >= likeness * len(x | y):
                out.add((min(a, b), max(a, b)))
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randint(38, 120))]
        for _ in range(r.randint(1, 4)):
            w = list(base)
            for _ in range(r.randint(0, 8)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.2:
                c = r.randrange(len(w))
                w = w[c:] + w[:c]
            rows.append((k, r.choice("ab"), str(r.randint(0, 300)), " ".join(w[:6]), " ".join(w[6:]).upper(), "clash"))
            k += 1
    got = {tuple(x) for x in neardup.near_duplicate_pairs(spark.createDataFrame(rows, S)).collect()}
    # Found pairs are right; none is missed but, seldom, near the threshold, where most of these lie.
    assert got <= brute(rows) and brute(rows, 0.7) <= got and len(got) >= 0.9 * len(brute(rows)) > 50


def test_pasted_several_times(spark):
    r = random.Random(8)
    rows = []
    for i in range(60):
        base = [f"t{i}w{r.randrange(1000)}" for _ in range(80)]
        copies = base * 3
        for _ in range(2):
            copies[r.randrange(len(copies))] = "edited"
        rows += [(2 * i, "a", str(i), "x", " ".join(base), ""), (2 * i + 1, "b", str(i), "x", " ".join(copies), "")]
    want = brute(rows, 0.7)
    assert len(want) == 60 and {tuple(x) for x in neardup.near_duplicate_pairs(spark.createDataFrame(rows, S)).collect()} == want


def test_hot_buckets(spark):
    """Boilerplate fills every bucket; with a low bound all of it takes the exact way, and nothing is lost."""
    r = random.Random(3)
    boiler = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(60):
        own = [f"u{i}x{r.randrange(99)}" for _ in range(60)]
        rows.append((2 * i, "a", str(i), "x", " ".join(boiler + own), ""))
        own[r.randrange(60)] = "edited"
        rows.append((2 * i + 1, "b", str(i), "x", " ".join(boiler + own), ""))
    items = spark.createDataFrame(rows, S)
    want = brute(rows)
    assert len(want) >= 60
    assert {tuple(x) for x in neardup.near_duplicate_pairs(items, hot=4).collect()} == want


def test_heavy_buckets_are_reported():
    import numpy as np

    sig = np.arange(4000 * 2, dtype=np.int32).reshape(4000, 2)
    sig[:1500, 1] = 7
    assert neardup._heavy([sig[:100], sig[100:]]) == [((1 << 32) | 7, 1500)]


def test_edit_classes(spark):
    r = random.Random(9)
    rows, kin = [], []
    for i in range(25):
        base = [f"t{i}w{r.randrange(500)}" for _ in range(90)]
        for c in range(3):
            w = list(base)
            for _ in range(4 * c):
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 1)] = ["edited"] * r.randint(0, 1)
            rows.append((3 * i + c, "a", str(i), "", " ".join(w), ""))
        kin.append({3 * i, 3 * i + 1, 3 * i + 2})
    rows += [(900, "a", "x", "", " ".join(f"alone{i}" for i in range(60)), ""), (901, "a", "y", "", None, ""), (None, "a", "y", "", "z " * 60, "")]
    rows += [(1000, "a", "z", "", rows[0][4], "")]
    kin[0].add(1000)
    got = neardup.edit_classes(spark.createDataFrame(rows, S)).collect()
    classes = {}
    for k, c, n in got:
        classes.setdefault(c, set()).add(k)
        assert n >= 1
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, kin))
    assert neardup.edit_classes(spark.createDataFrame([], S)).count() == 0


def test_distances_against_plain_alignment():
    import numpy as np

    def plain(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
            prev = cur
        return prev[-1]

    r = random.Random(1)
    a = [np.array([r.randint(1, 4) for _ in range(r.randint(0, 30))]) for _ in range(60)]
    b = [np.array([r.randint(1, 4) for _ in range(r.randint(0, 30))]) for _ in range(60)]
    assert neardup.banded_distances(a, b, 40).tolist() == [plain(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]


def test_edges(spark):
    long = " ".join(f"word{i}" for i in range(20_000))
    rows = [(1, "a", "1", long, None, ""), (2, "b", None, long, "", ""), (3, "b", None, long, "", ""), (4, "a", "1", long, None, ""), (5, "c", "1", "short", "text", ""), (6, "d", "1", None, None, ""), (None, "e", "1", long, None, "")]
    got = sorted(tuple(x) for x in neardup.near_duplicate_pairs(spark.createDataFrame(rows, S)).collect())
    assert got == [(1, 2), (1, 3), (2, 4), (3, 4)]
    assert neardup.near_duplicate_pairs(spark.createDataFrame([], S)).count() == 0


def test_alignment():
    a = list("kitten sitting")
    assert neardup.banded_similarity(a, a) == 1
    assert neardup.banded_similarity(list("kitten"), list("sitting")) == 1 - 3 / 7
    assert neardup.banded_similarity([], []) == 1 and neardup.banded_similarity([], list("x" * 40)) == 0
