import pytest
from marketloom.functions import text, values
from marketloom.operators import rules
from pyspark.sql import functions as F


def one(spark, c, v, kind="string"):
    return spark.createDataFrame([(v,)], f"x {kind}").select(c(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("<b>A&amp;nbsp;B</b> &lt;x&gt; “q”", 'A B "q"'), ("a<script>x<y</script>b", "a b"), ("a<!-- c -->b", "a b"), ("a<script>never closed", "a"), ("Brand™ X®", "Brand X"), ("ﬁ １２", "fi 12"), ("a​b", "ab"), (None, None), ("", ""),
    ],
)
def test_clean(spark, raw, want):
    assert one(spark, text.clean_text, raw) == want


def test_clean_cuts_nothing_by_default(spark):
    raw = "<b>word</b> &amp; " * 3000
    assert one(spark, text.clean_text, raw) == ("word & " * 3000).strip()
    assert len(one(spark, lambda c: text.clean_text(c, 300), raw)) <= 300


def test_truncate_and_hostile(spark):
    assert one(spark, lambda c: text.truncate(c, 10), "abcdefgh ijk") == "abcdefgh"
    assert one(spark, lambda c: text.truncate(c, 10), "abcdefghijkl") == "abcdefghij"
    assert len(one(spark, lambda c: text.clean_text(c, 50), "<" * 200_000 + "a" * 200_000)) <= 50


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTPS://User:pw@Shop.Example.:443/a?utm_source=x&b=2&GCLID=1#f", "https://shop.example/a?b=2"), ("http://x.example:80", "http://x.example/"), ("http://x.example:8080/?a=1&&c", "http://x.example:8080/?a=1&c"), ("ftp://x", None), ("", None), (None, None),
    ],
)
def test_canonical(spark, raw, want):
    assert one(spark, text.canonical_url, raw) == want


def test_small_functions(spark):
    assert one(spark, text.redact_url, "https://a:b@x/?token=abc&q=1") == "https://***@x/?token=***&q=1"
    assert one(spark, text.utf16_length, "a😀") == 3
    assert one(spark, text.escape_html, "<a&b>") == "&lt;a&amp;b&gt;"
    assert one(spark, text.escape_markdown, "a*b_") == r"a\*b\_"
    assert one(spark, text.host_of, "https://www.Shop.example/x") == "shop.example"
    assert one(spark, values.bracket_depth, "a(b[c]))(") == 2
    assert one(spark, lambda c: values.json_path(c, "a[-1].b"), '{"a":[1,{"b":"x y"}]}') == "x y"
    assert one(spark, lambda c: values.json_path(c, "a[-1]"), '{"a":[1,"z"]}') == "z"
    assert one(spark, lambda c: values.json_path(c, "a.b"), "nope") is None
    assert one(spark, values.noisy_or, [0.5, 0.5], "array<double>") == 0.75
    assert one(spark, lambda c: values.merge_maps(c, F.create_map(F.lit("a"), F.lit(9), F.lit("b"), F.lit(2))), {"a": 1}, "map<string,int>") == {"a": 1, "b": 2}
    assert one(spark, lambda c: values.distinct_urls(c, 2), ["http://a/1", "x", "http://a/1", "https://b/2", "https://c/3"], "array<string>") == ["http://a/1", "https://b/2"]
    assert [one(spark, values.lenient_bool, v) for v in ("Yes", "soldout", "sold", "?")] == [True, None, False, None]
    assert one(spark, values.lenient_number, " $1,234.5 ") == 1234.5
    for bad in ("", "a..b", "[x]", "a[1"):
        with pytest.raises(ValueError):
            values.compile_path(bad)


DAMAGE = rules.Group("damage", (r"\bscratch\w*", r"dead pixels?"), negatable=True)


@pytest.mark.parametrize(
    ("t", "want"),
    [("has scratches", True), ("no scratches", False), ("without any visible scratches", False), ("no box. scratches on the back", True), ("Dead pixels: none", False), ("no scratches but dead pixel", True), ("isn't scratched", False), ("fine", False), (None, False), ("", False)],
)
def test_negation(spark, t, want):
    assert one(spark, lambda c: rules.group_match(c, DAMAGE), t) is want


def test_identify(spark):
    ps = (rules.Profile("low", ("card",)), rules.Profile("hi", ("card",), all=("gpu",), none=("broken",), priority=1, variants=(rules.Variant("x", ("xt",)),)), rules.Profile("must", ("disk",), variants=(rules.Variant("1t", ("1tb",)),), variant_required=True))
    got = {t: tuple(one(spark, lambda c: rules.identify(c, ps), t)) for t in ("GPU card XT", "gpu card", "broken gpu card", "disk", "disk 1TB", "shoe")}
    assert got == {"GPU card XT": ("hi", "x", 1.0, None), "gpu card": ("hi", None, 0.85, None), "broken gpu card": ("low", None, 1.0, None), "disk": (None, None, None, "variant_unknown"), "disk 1TB": ("must", "1t", 1.0, None), "shoe": (None, None, None, "no_profile_match")}


def test_strongest(spark):
    s = [("a", 0.2), ("b", 0.9), ("c", 0.2), ("d", 0.5)]
    assert one(spark, rules.strongest, s, "array<struct<code: string, weight: double>>") == ["b", "d", "a"]
