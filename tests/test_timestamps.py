import datetime as dt

import numpy as np
import pandas as pd
import pytest
from marketloom.operators import timestamps as ts
from pyspark.sql import functions as F

CASES = [
    ("2025-03-09T02:30:00", "n-nyc", "2025-03-09 07:30:00"),  # skipped: the offset before
    ("2025-11-02 01:30:00", "n-nyc", "2025-11-02 05:30:00"),  # twice: the first
    ("Nov 2, 2025 1:30 AM EDT", "n-nyc", "2025-11-02 05:30:00"),
    ("Nov 2, 2025 1:30 AM EST", "n-nyc", "2025-11-02 06:30:00"),  # the abbreviation is only the second's
    ("01/09/2025 4:49 AM", "n-ber", "2025-09-01 02:49:00"),
    ("01/09/2025", "n-nyc", "2025-01-09 05:00:00"),
    ("30/03/25 01:25", "n-lon", "2025-03-30 01:25:00"),
    ("2025.09.01 05:50", "n-tyo", "2025-08-31 20:50:00"),
    ("Sun, 31 Aug 2025 19:58:10 GMT", "n-nyc", "2025-08-31 19:58:10"),
    ("Sun, 31 Aug 2025 10:04:21 -0400", "n-ber", "2025-08-31 14:04:21"),
    ("2025-09-01T06:07:51+05:45", "n-nyc", "2025-09-01 00:22:51"),
    ("2025-08-31T22:58:08-04:00[America/New_York]", None, "2025-09-01 02:58:08"),
    ("2025-08-31 22:59:53 America/Los_Angeles", "n-ber", "2025-09-01 05:59:53"),
    ("20250825T012319Z", "n-nyc", "2025-08-25 01:23:19"),
    ("2025-08-31T23:23:02.235793Z", "n-nyc", "2025-08-31 23:23:02.235"),
    ("1756684257", "n-nyc", "2025-08-31 23:50:57"),
    ("1756671868387239", "n-nyc", "2025-08-31 20:24:28.387"),
    ("1756653695.5", "n-nyc", "2025-08-31 15:21:35.500"),
    ("31 March 2024 00:32", None, "2024-03-31 00:32:00"),
    ("an hour ago", "n-nyc", "2025-08-31 23:00:00"),
    ("Listed 3w ago", "n-nyc", "2025-08-11 00:00:00"),
    (" 2025-09-01T01:40:02 ", "n-nyc", "2025-09-01 05:40:02"),
    ("2025-08-31T22:32:17Z", "n-nyc", None),  # already in the form
    ("0", "n-nyc", None),
    ("", "n-nyc", None),
    ("N/A", "n-nyc", None),
    (None, "n-nyc", None),
    ("0001-01-01T00:00:00", "n-nyc", None),
    ("1970-01-01 00:00:00.000", "n-nyc", None),
    ("2025-02-30 10:00:00", "n-nyc", None),
    ("2025-02-28 10:00:00 Mars/Base", "n-nyc", None),
    ("x" * 100_000, "n-nyc", None),
]
NODES = [("n-nyc", "America/New_York", "mdy"), ("n-ber", "Europe/Berlin", "dmy"), ("n-lon", "Europe/London", "dmy"), ("n-tyo", "Asia/Tokyo", "ymd")]


def _run(spark, cases):
    rows = [(i, c[0], dt.datetime(2025, 9, 1), c[1], "zone") for i, c in enumerate(cases)]
    items = spark.createDataFrame(rows, "item_id long, posted_at string, received_at timestamp, node_id string, home_zone string")
    out = ts.instants(items, spark.createDataFrame(NODES, "node_id string, home_zone string, date_order string"))
    return {r.item_id: r.posted_ms for r in out.collect()}


def test_cases(spark):
    got = _run(spark, CASES)
    for i, (text, _, want) in enumerate(CASES):
        ms = None if want is None else round(dt.datetime.fromisoformat(want).replace(tzinfo=dt.UTC).timestamp() * 1000)
        assert got.get(i) == ms, text


def test_empty(spark):
    assert _run(spark, []) == {}


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/London", "Asia/Tokyo", "Australia/Lord_Howe"])
def test_transitions_against_zoneinfo(zone):
    import zoneinfo

    import numpy as np

    z = zoneinfo.ZoneInfo(zone)
    local = np.arange(1_700_000_000, 1_765_000_000, 1_234_567)
    for s, u in zip(local.tolist(), ts.to_utc(local, zone).tolist(), strict=True):
        naive = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s)
        assert u == s - naive.replace(tzinfo=z, fold=0).utcoffset().total_seconds()


def test_abbreviations_tell_occurrences_apart():
    texts = ["2024-11-03 01:30:00 EST", "2024-11-03 01:30:00 EDT", "2024-11-03 01:30:00", "2024-11-03 01:30:00 PST", "2024-11-03 00:30:00 EST", "2024-11-03 02:30:00 EDT"]
    n = len(texts)
    ms, ok = ts.parse_instants(pd.Series(texts), np.zeros(n, np.int64), np.array(["America/New_York"] * n, object), np.array(["mdy"] * n, object))
    hour = lambda h, m: int(pd.Timestamp(2024, 11, 3, h, m, tz="UTC").timestamp() * 1000)
    assert ok.all() and ms.tolist() == [hour(6, 30), hour(5, 30), hour(5, 30), hour(5, 30), hour(4, 30), hour(7, 30)]


def test_versions_of_zone_data(tmp_path, spark):
    own = ts.zone_data()
    (tmp_path / "Etc").mkdir()
    (tmp_path / "Etc/UTC").write_bytes(own.files["Etc/UTC"])
    (tmp_path / "UTC").write_bytes(own.files["Etc/UTC"])
    (tmp_path / "Made").mkdir()
    (tmp_path / "Made/Up").write_bytes(own.files["Asia/Kolkata"])  # this release has a zone that others lack
    (tmp_path / "+VERSION").write_text("2099z\n")
    data = ts.zone_data("2099z", str(tmp_path))
    assert data.version == "2099z" and sorted(data.files) == ["Etc/UTC", "Made/Up", "UTC"]
    with pytest.raises(ValueError):
        ts.zone_data("1999a", str(tmp_path))
    items = spark.createDataFrame([(1, "2026-01-01 12:00:00", "n"), (2, "2026-01-01 12:00:00 Asia/Tokyo", "n")], "item_id long, posted_at string, node_id string").withColumn("received_at", F.current_timestamp())
    nodes = spark.createDataFrame([("n", "Made/Up", "ymd")], "node_id string, home_zone string, date_order string")
    assert [tuple(r) for r in ts.instants(items, nodes, data=data).collect()] == [(1, 1767249000000)]
    assert ts.instants(items, nodes).count() == 1
