import pytest
from marketloom.operators import units

L = "obs_id long, price_raw string, price_num double, shipping_raw string, shipping_num double, currency string, description string, extra string, rate string, amount string"
RATES = [("USD", 1.0), ("CAD", 0.7312), ("EUR", 1.0847), ("GBP", 1.2719), ("JPY", 0.00672), ("CHF", 1.1264), ("MXN", 0.0521), ("AUD", 0.6583)]


def run(spark, rows):
    """rows: (price_raw, price_num, currency, description, extra)"""
    data = [(i, a, b, None, None, c, d, e, "x", "y") for i, (a, b, c, d, e) in enumerate(rows)]
    out = units.money_in_cents(spark.createDataFrame(data, L), spark.createDataFrame(RATES, "currency string, usd_per_unit double"))
    return {r.obs_id: r.usd_cents for r in out.collect()}


CASES = [
    (("$1,234.50", None, "USD", None, None), 123450),
    (("1.234,50 €", None, "USD", None, None), 133906),
    (("1’118.40 CHF", None, None, None, None), 125977),
    (("1 604,99 €", None, "EUR", None, None), 174093),
    (("１０，０７０円", None, "JPY", None, None), 6767),
    (("219,- €", None, "EUR", None, None), 23755),
    (("$1.2k", None, "USD", None, None), 120000),
    (("$100", None, "CAD", None, None), 7312),
    (("US$100", None, "CAD", None, None), 10000),
    (("12800 cents", None, "USD", None, None), 12800),
    (("1.234", None, "USD", None, None), 123400),
    (("free to a good home", None, "EUR", None, None), 0),
    (("$164.99 (2 available)", None, "USD", None, None), 16499),
    ((None, 100.0, "eur", None, None), 10847),
    ((None, 100.0, None, "Fine card. prices in pounds, not dollars", None), 12719),
    ((None, 36599.0, "USD", None, '{"price_divisor": "100"}'), 36599),
    ((None, 36599.0, "USD", None, '{"note": "integer amounts are hundredths"}'), 36599),
    ((None, 100.0, "USD", None, "{}"), None),
    ((None, -5.0, "EUR", None, None), None),
    ((None, float("nan"), "EUR", None, None), None),
    (("call for price", None, "USD", None, None), None),
    (("-5 €", None, "EUR", None, None), None),
    (("", None, None, None, None), None),
    ((None, None, None, None, None), None),
    (("100 SEK", None, "SEK", None, None), None),
    (("9" * 30, None, "USD", None, None), None),
]


def test_amounts(spark):
    got = run(spark, [c for c, _ in CASES])
    assert {i: got.get(i) for i in range(len(CASES))} == {i: want for i, (_, want) in enumerate(CASES)}


def test_empty_and_repeated(spark):
    assert run(spark, []) == {}
    rates = spark.createDataFrame(RATES, "currency string, usd_per_unit double")
    twice = spark.createDataFrame([(1, "$5", None, "Free", None, "USD", "x" * 300_000, None, "", "")] * 2, L)
    assert sorted((r.amount_field, r.usd_cents) for r in units.money_in_cents(twice, rates).collect()) == [("price", 500), ("price", 500), ("shipping", 0), ("shipping", 0)]


@pytest.mark.parametrize(
    ("text", "field", "want"),
    [("kw", "power", ("power", "W", 3)), ("mah", "power", ("charge", "Ah", -3)), ("m", "size", ("length", "m", 0)), ("pounds", "weight", ("mass", "lb", 0)), ("pounds", "price", ("money", "GBP", 0)), ("m2", "size", ("length", "m2", 0))],
)
def test_priors_decide(text, field, want):
    (g,) = units.segment(text, field)
    assert g[:3] == want
