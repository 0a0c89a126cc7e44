import json
import random

from marketloom.operators import asof, fold, merge
from marketloom.streaming import state
from marketloom.streaming.source import FeedSource
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = "k string, id long, v double, t double"
OUT = "k string, id long, status string, previous double"


def claims_brute(rows):
    held, out = {}, {}
    for k, i, v, t in sorted(rows, key=lambda r: (r[3], r[1])):
        h = held.get(k)
        if h is None or h[1] <= t:
            out[i], held[k] = "new", (v, t + 50)
        elif v <= h[0] * 0.9:
            out[i], held[k] = "again", (v, t + 50)
        else:
            out[i] = "duplicate"
    return out


def some_rows(n=400, seed=1):
    r = random.Random(seed)
    return [(r.choice(["hot", "hot", "hot", "a", "b"]), i, r.uniform(50, 100), float(r.randint(0, 300))) for i in range(n)]


STEP = fold.claim_step("k", "v", "t", 50.0, lambda a, b: b <= a * 0.9)


def test_claims(spark):
    rows = some_rows()
    out = fold.keyed_fold(spark.createDataFrame(rows, ROWS), ["k"], ["t", "id"], STEP, T.StructType.fromDDL(OUT))
    assert {r.id: r.status for r in out.collect()} == claims_brute(rows)
    assert fold.keyed_fold(spark.createDataFrame([], ROWS), ["k"], ["t"], STEP, T.StructType.fromDDL(OUT)).count() == 0


def test_claims_as_a_stream(spark, tmp_path):
    rows = sorted(some_rows(seed=2), key=lambda r: (r[3], r[1]))
    for i in range(4):  # files in order of time
        spark.createDataFrame(rows[i * 100 : (i + 1) * 100], ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = state.read_stream(spark, str(tmp_path / "in"), T.StructType.fromDDL(ROWS), 1)
    got = {}
    state.run_once(state.stream_fold(stream, ["k"], ["t", "id"], STEP, T.StructType.fromDDL(OUT)), str(tmp_path / "cp"), lambda b, _: got.update({r.id: r.status for r in b.collect()}))
    assert got == claims_brute(rows)


def test_history(spark):
    rows = some_rows(200, 3)
    df = spark.createDataFrame([(k, i, f"l{i % 40}", v, t) for k, i, v, t in rows], "k string, id long, l string, v double, t double")
    got = {r.id: (r.n_before, r.median_before) for r in fold.keyed_fold(df, ["k"], ["t", "id"], fold.history_step("l", "v", "t", 60.0, 10), T.StructType.fromDDL("id long, n_before long, median_before double")).collect()}
    held: dict = {}
    for k, i, v, t in sorted(rows, key=lambda r: (r[3], r[1])):
        h = held.setdefault(k, {})
        vs = sorted(x for x, _ in h.values())
        med = None if not vs else (vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) / 2
        assert got[i] == (len(vs), med)
        h[f"l{i % 40}"] = (v, t)
        new = max(x for _, x in h.values())
        for key in sorted(h, key=lambda a: (h[a][1], a)):
            if h[key][1] < new - 60 or len(h) > 10:
                del h[key]


def test_admission(spark):
    df = spark.createDataFrame([("s", i, 0.0, float(t)) for i, t in enumerate([0, 1, 2, 3, 60, 61, 62, 63])], ROWS)
    out = fold.keyed_fold(df, ["k"], ["t", "id"], fold.admission_step("t", 60.0, 2), T.StructType.fromDDL("id long, admitted boolean"))
    assert {r.id for r in out.where("admitted").collect()} == {0, 1, 4, 5}


def test_keyed_table(spark, tmp_path):
    table = state.KeyedTable(spark, str(tmp_path / "t"), lambda rows: state.latest_only(rows, ["k"], F.col("t")))
    assert table.current() is None
    a = spark.createDataFrame([("a", 1, 1.0, 5.0), ("b", 2, 2.0, 5.0)], ROWS)
    b = spark.createDataFrame([("a", 3, 9.0, 1.0), ("b", 4, 8.0, 9.0), ("c", 5, 7.0, 1.0)], ROWS)
    table(a, 0)
    table(b, 1)
    table(a, 1)  # a replay
    assert {r.k: r.v for r in table.current().collect()} == {"a": 1.0, "b": 8.0, "c": 7.0}
    for i in range(2, 6):
        table(b, i)
    assert table.versions() == [3, 4, 5]


def test_upsert_doesnt_depend_on_order(spark):
    rows = [("a", 1, None, 1.0), ("a", 2, 5.0, 2.0), ("a", 3, None, 3.0), ("b", 4, 4.0, 1.0)]
    want = None
    for s in range(4):
        random.Random(s).shuffle(rows)
        df = spark.createDataFrame(rows, ROWS)
        got = sorted(map(tuple, merge.upsert(df, ["k"], [F.col("t"), F.col("id")], ["id"], ["v"], {"first_id": "id"}, {"least": "v"}, "t").collect()))
        assert want in (None, got)
        want = got
    assert want == [("a", 3, 5.0, 1, 5.0, 1.0, 3.0), ("b", 4, 4.0, 4, 4.0, 1.0, 1.0)]


def test_dead_letters(spark):
    raw = spark.createDataFrame([('{"a": 1}',), ("{broken",), ('{"a": "x"}',), (None,)], "p string")
    good, bad = state.split_payloads(raw, "p", T.StructType.fromDDL("a int"))
    assert [r.a for r in good.collect()] == [1]
    assert bad.count() == 3


def test_windows_drop_late_rows(spark, tmp_path):
    got = []
    for at, n in (("2025-01-01 00:00:30", 3), ("2025-01-01 02:00:00", 1), ("2025-01-01 00:01:00", 5), ("2025-01-01 04:00:00", 1)):
        spark.createDataFrame([("x",)] * n, "k string").withColumn("at", F.lit(at).cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.read_stream(spark, str(tmp_path / "in"), T.StructType.fromDDL("k string, at timestamp"), 1)
        state.run_once(state.windowed_counts(stream, "at", ["k"]), str(tmp_path / "cp"), lambda b, _: got.extend((str(r.start), r.n) for r in b.collect()))
    assert ("2025-01-01 00:00:00", 3) in got and sum(n for at, n in got if at.startswith("2025-01-01 00")) == 3


def test_asof(spark):
    left = spark.createDataFrame([("a", 10), ("a", 5), ("b", 1), (None, 3)], "k string, at int")
    right = spark.createDataFrame([("a", 4, 1.0), ("a", 10, 2.0), ("b", 2, 3.0), (None, 3, 4.0)], "k string, r int, v double")
    assert {(r.k, r["at"]): r.v for r in asof.asof_join(left, right, "k", "at", "r", ["v"]).collect()} == {("a", 10): 2.0, ("a", 5): 1.0, ("b", 1): None, (None, 3): 4.0}


def test_own_source(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps({"source": "s", "source_id": "1", "title": "t", "price": 1.5}), "{bad", "7"]))
    spark.dataSource.register(FeedSource)
    assert [tuple(r) for r in spark.read.format("feed").load(str(tmp_path)).collect()] == [("s", "1", "t", 1.5)]
