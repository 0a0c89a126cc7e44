import pytest
from marketloom.functions import values
from marketloom.operators import fold, history, inference, routing
from marketloom.sources import feeds
from pyspark.sql import functions as F


def claims(events):
    step = fold.cluster_claim_step("kind", "l", "p", "b", "t", "tok", 100.0, 50.0, 0.05, 5.0)
    state, out = None, []
    for kind, who, p, b, t, tok in events:
        state, (row,) = step(state, {"kind": kind, "l": who, "p": p, "b": b, "t": t, "tok": tok})
        out.append((row["status"], row["previous"], row["owner"]))
    return out


def test_claims_of_clusters():
    assert claims([
        ("claim", "a", 100.0, 7, 0, 1), ("claim", "a", 99.0, 7, 1, 2), ("claim", "b", 101.0, 8, 2, 3), ("claim", "c", 500.0, 40, 3, 4), ("claim", "a", 80.0, 5, 4, 5), ("claim", "d", 80.0, 5, 5, 6),
        ("claim", "e", 101.0, 7, 60, 7), ("claim", "a", 80.0, 5, 103, 8), ("claim", "a", 80.0, 5, 104, 9),
    ]) == [("new", None, None), ("duplicate", 100.0, None), ("cross_source_duplicate", 100.0, "a"), ("new", None, None), ("price_drop", 100.0, None), ("cross_source_duplicate", 80.0, "a"), ("new", None, None), ("duplicate", 80.0, None), ("new", None, None)]


def test_undoing_claims():
    # A new claim undone frees the listing and its bucket.
    assert claims([("claim", "a", 100.0, 7, 0, 1), ("rollback", "a", None, None, 1, 1), ("claim", "b", 100.0, 7, 2, 2)])[1:] == [("undone", None, None), ("new", None, None)]
    # A drop undone brings the old price back with the time it had left, and the bucket's old owner none.
    got = claims([("claim", "a", 100.0, 7, 0, 1), ("claim", "a", 50.0, 3, 90, 2), ("rollback", "a", None, None, 95, 2), ("claim", "a", 96.0, 7, 96, 3), ("claim", "a", 96.0, 7, 106, 4)])
    assert [x[0] for x in got] == ["new", "price_drop", "undone", "duplicate", "new"] and got[3][1] == 100.0
    # What a later claim has replaced isn't undone.
    assert claims([("claim", "a", 100.0, None, 0, 1), ("claim", "a", 50.0, None, 1, 2), ("rollback", "a", None, None, 2, 1), ("rollback", "a", None, None, 3, 1)])[2:] == [("superseded", None, None), ("superseded", None, None)]


def test_weighted_quantiles_keep_every_sample(spark):
    rows = [("ties", v, 1.0) for v in (1.0, 1.0, 1.0, 5.0)] + [("one", 3.0, 0.5)] + [("w", 1.0, 1.0), ("w", 2.0, 3.0)] + [("zero", 1.0, 0.0), ("zero", 2.0, 0.0)]
    got = {r.k: r for r in history.history_stats(spark.createDataFrame(rows, "k string, v double, w double"), ["k"]).collect()}
    assert (got["ties"].q1, got["ties"].median, got["ties"].q3, got["ties"].iqr, got["ties"].mad) == (1.0, 1.0, 3.0, 2.0, 0.0)
    assert (got["one"].q1, got["one"].q3, got["one"].mad, got["one"].n_eff) == (3.0, 3.0, 0.0, 1.0)
    assert got["w"].median == 1 + (0.5 - 0.125) / 0.5 and got["zero"].median is None and got["zero"].n_eff == 0.0


def test_routes(spark):
    df = spark.createDataFrame([(1, "2026-01-01 23:30:00"), (5, "2026-01-01 12:00:00"), (None, "2026-01-01 12:00:00"), (9, None)], "p int, at string").withColumn("at", F.to_timestamp("at"))
    routes = [routing.Route("a", F.col("p") > 0, ("x", "y"), quiet=("23:00", "01:00")), routing.Route("b", F.col("p") > 4, ("y", "z"), mention=True)]
    got = {r.p: (r.routes, r.targets, r.mention, r.suppressed) for r in routing.routed(df, routes, F.col("at")).collect()}
    assert got[1] == ([], [], False, "quiet_hours") and got[5] == (["a", "b"], ["x", "y", "z"], True, None) and got[None] == ([], [], False, "no_match")
    assert got[9][0] == ["b"]  # without a time nothing is known of quiet hours: such a route doesn't speak
    for bad in ("", "24:00", "1:5", "12:60", "x:00"):
        with pytest.raises(ValueError):
            routing.minute_of(bad)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"category": "genuine", "confidence": 0.9}', ("genuine", 0.9)), ('x {"label": "Box only", "score": "80%"} y', ("box_only", 0.8)), ('{"answer": {"verdict": "damaged", "confidence": "high"}}', ("damaged", 0.9)),
        ('{"category": "genuine|box_only", "confidence": 1}', ("uncertain", 1.0)), ('{"category": "genuine", "damage_visible": "yes", "confidence": 1}', ("damaged", 0.8)), ('{"category": "genuine", "item_visible": false, "confidence": 1}', ("uncertain", 0.5)),
        ('{"category": "box_only", "item_visible": true}', ("uncertain", 0.25)), ("no json", ("uncertain", 0.0)), (None, ("uncertain", 0.0)), ("{broken", ("uncertain", 0.0)), ('{"category": 7}', ("uncertain", 0.5)),
    ],
)
def test_reading_answers(text, want):
    verdict, sure = inference.read_answer(text)
    assert (verdict, round(sure, 9)) == want


def test_cascade_cache_and_verdicts(spark):
    first = lambda ps: [{"u": None, "d": '{"verdict":"damaged","confidence":0.9}', "g": '{"verdict":"genuine","confidence":0.95}', "b": '{"verdict":"box_only","confidence":0.9}', "k": "??"}.get(u[-1], '{"verdict":"uncertain","confidence":0.2}') for u, _ in ps]
    second = lambda ps: [None if u.endswith("n") else '{"verdict":"genuine","confidence":0.7}' for u, _ in ps]
    urls = lambda s: [f"http://x/{k}{c}" for k, c in enumerate(s)]
    rows = [(1, urls("gd")), (2, urls("gb")), (3, urls("b")), (4, urls("u")), (5, []), (6, urls("n")), (7, urls("m")), (8, None), (9, urls("uug"))]
    items = spark.createDataFrame(rows, "i long, urls array<string>")
    shown = inference.photos(items, "i", "urls", 2).withColumn("prompt", F.lit("p"))
    kept = spark.createDataFrame([("http://x/0b", "p", "genuine", 0.99, True), ("http://other", "p", "genuine", 0.1, True)], "url string, prompt string, verdict string, confidence double, usable boolean")
    found = inference.answers(shown, first, second, kept)
    got = {r.i: (r.verdict, r.confidence, r.photos) for r in inference.verdicts(shown, found, "i", 2, 0.6, required=F.lit(True)).collect()}
    assert got == {1: ("damaged", 0.9, 2), 2: ("genuine", 0.95, 2), 3: ("genuine", 0.99, 1), 4: ("error", 0.0, 0), 6: ("uncertain", 0.2, 1), 7: ("genuine", 0.7, 1), 9: ("genuine", 0.95, 1)}


def test_prompts(spark):
    df = spark.createDataFrame([("gpu", "x"), ("other", "a fast SSD"), (None, "lamp")], "c string, t string")
    assert [r.k for r in df.select(inference.prompt_kind(F.col("c"), F.col("t"), {"gpu": "graphics", "disk": r"\bssd\b"}).alias("k")).collect()] == ["gpu", "disk", "generic"]


def test_waits_and_drops(spark):
    df = spark.createDataFrame([(" 7 ",), ("-1",), ("NaN",), ("",), (None,), ("soon",), ("Thu, 01 Jan 2026 00:01:30 GMT",)], "h string")
    assert [r.w for r in df.select(routing.retry_after(F.col("h"), F.lit("2026-01-01").cast("timestamp")).alias("w")).collect()] == [7.0, 0.0, None, None, None, None, 90.0]
    d = spark.createDataFrame([(100.0, 95.0), (100.0, 95.1), (10.0, 9.0), (None, 1.0)], "b double, v double")
    assert [r.x for r in d.select(values.dropped(F.col("b"), F.col("v"), 0.05, 5.0).alias("x")).collect()] == [True, False, False, None]


def test_static_page(spark):
    body = '<li class="cl-static-search-result" title="A"><a href="https://x/d/a/123.html"><div class="title">A card</div><div class="price">$1,200</div><div class="location"> here </div></a></li><li class="cl-static-search-result"><a href="https://x/d/124.html"><div class="title">B</div></a></li><li class="other">C</li>'
    got = [tuple(r) for r in feeds.search_rows(spark.createDataFrame([(1, body), (2, None), (3, "")], "page_id long, body string")).select("source_id", "title", "price_num", "place").collect()]
    assert got == [("123", "A card", 1200.0, "here"), ("124", "B", None, None)]
