from datetime import datetime, timedelta

from marketloom.plans import registry


def test_keeps_as_many_per_key_as_the_history_does(spark, tmp_path):
    at = datetime(2026, 1, 1)
    rows = [("big", "new", "s", str(i), 1.0 + i, at + timedelta(minutes=i), 100 * i, True) for i in range(450)] + [("mid", "new", "t", str(i), 2.0, at, 100_000 + 100 * i, None) for i in range(60)]
    rows += [("mid", "new", "t", "sold", 2.0, at, 200_000, False), ("mid", "new", "t", "risky", 2.0, at, 200_190, True), ("mid", "new", "t", "old", 2.0, at - timedelta(days=200), 200_200, True), (None, "new", "t", "none", 2.0, at, 200_300, True)]
    rows += [("mid", "new", "t", "0", 9.0, at + timedelta(minutes=1), 300_000, True)]  # newer than the listing's first
    df = spark.createDataFrame(rows, "query string, item_condition string, source string, source_id string, total_price double, received_at timestamp, item_id long, in_stock boolean")
    df.write.parquet(f"{tmp_path}/deal_items.parquet")
    got = registry.QUERIES["warm_start_history"](spark, str(tmp_path)).collect()
    assert sorted(x.listing_key for x in got) == sorted([*(f"s:{i}" for i in range(50, 450)), *(f"t:{i}" for i in range(60))])
    assert [x.position for x in got if x.listing_key == "t:0"] == [60] and [x.total_price for x in got if x.listing_key == "t:0"] == [9.0]
