from marketloom.llm import products


def test_gtin():
    assert products.gtin_valid("4006381333931") and products.gtin_valid("036000291452") and products.gtin_valid("73513537")
    assert not products.gtin_valid("4006381333930") and not products.gtin_valid("0000000000000") and not products.gtin_valid("12")


def key(title, description=None, sku=None):
    return products.model_key(products.parse(title, description, sku))


def test_spellings_agree():
    a = key("M.2&nbsp;solid state drive 4000GB Dexruva 9353-Max FALMOR [FA-DEX9353MA-4000]")
    assert a == key("FALMOR DEXRUVA9353 MAX nvme ssd 4 TB") == key("Falmor Dexruva 9353 Max internal SSD", None, "fadex9353ma4000") == key("Dexruva 9353 max NVMe drive", "Fast. Spec: 4,000 GB. Weight with packaging is 2 kg.")
    assert key("Kansen 2933S 0.65kW PSU") == key("650 watt zero-rpm fan psu kansen-2933s iskan2933s650")
    assert key("Torvex Lumzur 16599-Pro gaming monitor 34-inch") == key("LED screen 86.4 cm Lumzur 16599 Pro 165Hz")


def test_differences_matter():
    one = key("Kanlin 4620 Max NVMe SSD 2 TB")
    for other in ("Kanlina 4620 Max NVMe SSD 2 TB", "Kanlin 4621 Max NVMe SSD 2 TB", "Kanlin 4620 NVMe SSD 2 TB", "Kanlin 4620 Max NVMe SSD 1 TB", "Kanlin 4620 Pro NVMe SSD 2 TB"):
        assert key(other) != one


S = "item_id long, source string, source_id string, title string, description string, sku string, retailer string, item_id_a string"


def pairs(spark, rows):
    return sorted(tuple(r) for r in products.same_product_pairs(spark.createDataFrame([(*r, "clash") for r in rows], S)).collect())


def test_pairs(spark):
    t = "Kanlin 4620 Max NVMe SSD 2 TB"
    rows = [
        (1, "a", "1", t, None, None, None), (2, "b", "1", t + " NEW", "", "", None), (3, "a", "1", t, None, None, None), (4, "c", None, None, None, None, None), (5, "c", "9", "", "", "", ""),
        (6, "d", "1", "solid state drive, great", None, "7654321", "Voltmart"), (7, "e", "1", "Kanlin 4620 Max NVMe SSD 2 TB", None, "7654321", "voltmart "), (None, "f", "1", t, None, None, None),
        (8, "g", "1", "router, as new", None, "7654321", "Voltmart"), (9, "h", "1", "lamp", None, "5555555", "Gridhaus"), (10, "i", "1", "lamp, used", None, "5555555", "Gridhaus"),
    ]
    # 8 states another class than the shop number's product and stays out.
    assert pairs(spark, rows) == [(1, 2), (1, 6), (1, 7), (2, 3), (2, 6), (2, 7), (3, 6), (3, 7), (6, 7), (9, 10)]
    assert pairs(spark, []) == []


def test_keys_join_all_listings(spark):
    upc = "UPC 036000291452"
    rows = [
        (1, "a", "1", f"fast storage, {upc}", None, None, None), (2, "b", "1", f"ssd, boxed, {upc}", None, None, None),  # one leaves its class open
        (3, "c", "1", "router GTIN 4006381333931", None, None, None), (4, "d", "1", "monitor GTIN 4006381333931", None, None, None), (5, "e", "1", "thing GTIN 4006381333931", None, None, None),  # 5 fits both, joins none
        (6, "f", "1", "Kanlin 4620 Max NVMe SSD 2 TB EAN 73513537", None, None, None), (7, "g", "1", "Xanlinium 4620 Max NVMe SSD 2 TB EAN 73513537", None, None, None),  # series spelled quite differently
        (8, "h", "1", "Kanlin 4621 Max NVMe SSD 2 TB EAN 73513537", None, None, None),  # another number
    ]
    assert pairs(spark, rows) == [(1, 2), (6, 7)]
    got = {r.item_id: r.class_id for r in products.same_product_classes(spark.createDataFrame([(*r, "clash") for r in rows], S)).collect()}
    assert got[1] == got[2] and got[6] == got[7] != got[8]


def test_slips_of_the_keyboard(spark):
    spell = ["Dexruva", "Dexrvua", "Deexruva", "Dexuva", "Dexruv", "Dexruba", "Rexruva"]
    rows = [(i, "a", str(i), f"{w} 9353-Max NVMe SSD 4TB", None, None, None) for i, w in enumerate(spell)]
    assert pairs(spark, rows) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in products.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
