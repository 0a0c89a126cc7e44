import json

from marketloom.functions import render, specs
from pyspark.sql import functions as F


def test_embed_limits(spark):
    d = spark.createDataFrame([("t" * 999, "u", "d*" * 9000, "v" * 5000, None)], "t string, u string, d string, v string, n string")
    j = json.loads(d.select(render.embed(F.col("t"), F.col("u"), F.col("d"), {"A": F.col("v"), "B": F.col("n")}).alias("j")).first().j)
    assert len(j["title"]) <= 256 and [f["name"] for f in j["fields"]] == ["A"] and len(j["fields"][0]["value"]) <= 1024
    assert len(j["title"]) + len(j["description"]) + sum(len(f["name"]) + len(f["value"]) for f in j["fields"]) <= 6000


def test_message_fits(spark):
    d = spark.createDataFrame([("A & B", 'https://x/?a="1"', "short", "y" * 300, None), (None, None, None, None, None)], "t string, u string, a string, b string, c string")
    out = [r.m for r in d.select(render.html_message(F.col("t"), F.col("u"), [(1, F.col("a")), (9, F.col("b")), (5, F.col("c"))], 353).alias("m")).collect()]
    assert out[0].startswith('<a href="https://x/?a=&quot;1&quot;">A &amp; B</a>') and len(out[0]) <= 353 and "y" * 300 in out[0] and "short" not in out[0]
    assert out[1] == ""


def test_specs(spark):
    d = spark.createDataFrame([("[TAG] [x] Monitor 27-inch 165Hz OLED 16 GB 24gb", 1)], "t string, n int")
    s = specs.specs(F.col("t"))
    r = d.select(*(s[c].alias(c) for c in s), specs.tags(F.col("t")).alias("tags"), specs.untagged(F.col("t")).alias("rest")).first()
    assert (r.memory_gb, r.refresh_hz, r.size_in, r.panel, r.tags) == (24, 165, 27, "oled", ["TAG", "x"]) and r.rest.startswith("Monitor 27")


def test_histogram_quantile(spark):
    q = lambda upto, n: spark.range(1).select(specs.histogram_quantile(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), F.array(*(F.lit(u) for u in upto)), F.lit(n), 0.5).alias("q")).first().q
    assert q([5, 10, 10], 10) == 1.0 and q([0, 10, 10], 10) == 1.5 and q([0, 0, 0], 10) == 4.0 and q([0, 0, 0], 0) is None
