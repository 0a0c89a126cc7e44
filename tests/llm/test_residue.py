import json

import pytest
from marketloom.llm import residue

FLAGGED = ["{{ product.title }}", "%%TITLE%%!", "<%= title %>", "&lt;%price_fmt%&gt;", "Hyvant [object Object]", "Ombrel NaN inch", "null null 1000GB", "Zephrax undefined undefined", "Dear [CUSTOMER], the Wexley is back", "Meet the Kalmira: ${brand}, now in {{title}}.", "[sku]", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "test test test", "xxxxxxxxxx", "asdf asdf asdf", "qwerty uiop", "Insert description here", "TODO write copy", "Description coming soon", "Sample Product - do not publish", "TBD TBD TBD", "Please enable JavaScript to continue.", "403 Forbidden", "Bitte aktivieren Sie JavaScript in Ihrem Browser.", "{0} - {1} ({2})", "__item_name__", "*|SHORT_DESC|*", "Sed do eiusmod tempor. sample sample sample"]
REAL = ["Null & Void Sticker Sheet", "Captcha Card Game, Unusual Traffic Edition", "Lorem Ipsum Typography Poster, 18x24", "Access Denied: The Board Game", "Error 404 Sleep Not Found Hoodie 404", "Template Set {12-Pack} Stencils", "100% Cotton Cable Wrap %", "The firmware templating language uses {{ name }} for variables, see the manual.", "Supports ${VAR} style macros in the keypad editor.", "Use the {brackets} to hang it; no placeholder frames included.", "Prints lorem ipsum dolor sit amet on both sides.", "Setup page needs JavaScript turned on in your browser; instructions are in the box.", "If the router shows 503 Service Unavailable, hold reset for ten seconds.", "Test Tube Rack - do not microwave", "", "x", "Karta graficzna 8 GB"]


@pytest.mark.parametrize("text", FLAGGED)
def test_residue(text):
    assert residue.residue_kind(text)


@pytest.mark.parametrize("text", REAL)
def test_real(text):
    assert residue.residue_kind(text) is None


def page(title="Card", description="Fine card.", **more):
    return json.dumps({"data": {"product_summaries": [{"tcin": "1", "item": {"product_description": {"title": title, "downstream_description": description}}}]}, **more})


@pytest.mark.parametrize(
    ("body", "flagged"),
    [
        (page(), False), (page(blockScript=""), False), (page(blockScript="none"), False), (page(blockScript=None), False), (page(title="{{title}}"), True), (page(description="Bad gateway"), True),
        ('{"appId":"A","blockScript":"/x/captcha.js"}', True), ('{"error":{"blockScript":"//x.js"}}', True), ('{"data":{"product":null},"message":"Bad gateway"}', True), ('{"data":{"product":null}}', False),
        ('{"status":"error","detail":"no healthy upstream"}', True), ('{"errors":[{"message":"Are you a robot? Press and hold.","code":418}]}', True),
        ("<html><noscript>Activez JavaScript pour continuer.</noscript></html>", True), ("no healthy upstream", True), (page()[:-9], False), ("", False), ("   ", False), (None, False), ("[]", False), ("{}", False), ("[" * 200_000, False), (page(description="fine card works well " + "abcdefg hij klm nop " * 50_000), True), (page(description=" ".join(f"part{i}" for i in range(100_000))), False),
    ],
)
def test_pages(body, flagged):
    assert (residue.page_kind(body) is not None) == flagged


@pytest.mark.parametrize(
    ("body", "kind"),
    [
        ('{"response":{"message":"Please enable JavaScript"}}', "notice"), ('{"a":[{"b":{"c":{"d":{"e":{"f":["Are you a robot?"]}}}}}]}', "notice"), ('{"fault":{"blockScript":"/x.js"}}', "wall"), ('{"a":{"b":[{"c":{"blockScript":"/x.js"}}]}}', "wall"),
        ('{"data":{"product":null},"request":"id 512","price":"499"}', None), ('{"fault":{"blockScript":"none"}}', None), ('{"data":{"product":null},"message":"404"}', "notice"), ('{"a":' * 800 + '"Bad gateway"' + "}" * 800, "notice"),
    ],
)
def test_wrapped_notices(body, kind):
    assert residue.page_kind(body) == kind


@pytest.mark.parametrize(
    ("body", "kind"),
    [("Solid oak desk, 120 cm, ships tomorrow.", None), ("<p>Our store ships worldwide.</p>", None), ('"A fine desk"', None), ('"Bad gateway"', "notice"), ("<h1>Shop</h1><p>Bad gateway</p>", "notice"), ("{% include 'partials/" + "x" * 90 + "' %}", "placeholder"), ("<b>{% " + "y" * 300 + " %}</b>", "placeholder")],
)
def test_bodies_that_are_text(body, kind):
    assert residue.page_kind(page(title=body) if "%" in body else body) == kind


def test_long_placeholders_need_their_end():
    assert residue.placeholder_share("<!-- " + "note " * 40 + "-->") == 1.0 and residue.placeholder_share("<!-- " * 40) == 0.0
    assert residue.placeholder_share("<% " + "x" * 200 + " %>") == 1.0 and residue.placeholder_share("{% never closed") == 0.0


def test_operator(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "Bad gateway", "b"), (2, "Bad gateway", "b"), (3, page(), "c")], "page_id long, body string, residue_kind string")
    assert sorted(r.page_id for r in residue.residue_pages(df).collect()) == [2, 2]
    assert residue.residue_pages(df.limit(0)).count() == 0
