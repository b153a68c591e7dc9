"""Extraction, geometry, cascades, files and streams on inline cases."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import cascade as K
from labelloom.operators import extract as X
from labelloom.operators import geometry as G
from labelloom.operators import label_text as L
from labelloom.operators import tables as O
from labelloom.operators import windows as W
from labelloom.operators import workflow
from labelloom.sources import files
from labelloom.streaming import decisions

LABEL = """NUTRA
VITAMIN C
GUMMIES
Mango Flavour
Supports Immunity.
30 Gummies
Serving size: 2 gummies daily
Ingredients: Sugar, Water, Citric Acid (regulator, E330), Pectin.
Nutritional Information
Manufactured by: Maker Foods Ltd
FSSAI Lic. No. 11111111111111
Marketed by: Bright Health Pvt Ltd
12 Park Street, Pune
FSSAI Lic No: 2222 2222 2222 22
Customer care: +91 20 1234 5678, care@bright.example.com."""


def value(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression.alias("x")).first()["x"]


def test_label_text(spark):
    rows = spark.createDataFrame([(1, LABEL), (2, None), (3, "")], "id int, t string")
    got = {r["id"]: r for r in L.label_fields(rows, "id", "t", ["Mango"]).collect()}
    one = got[1]
    assert (one["brand"], one["product"], one["flavour"]) == ("NUTRA", "VITAMIN C GUMMIES", "Mango")
    assert (one["marketing_company"], one["address"], one["package_size"]) == ("Bright Health Pvt Ltd", "12 Park Street, Pune", "30 Gummies")
    assert (one["fssai_number"], one["customer_care_email"], one["customer_care_number"]) == ("22222222222222", "care@bright.example.com", "+91 20 1234 5678")
    assert L.label_fields(rows, "id", "t", only=["address", "claims"]).columns == ["id", "address", "claims"]
    assert one["claims"] == ["Supports Immunity"] and got[2]["brand"] == got[3]["product"] == "" and got[2]["claims"] == []


def answers(spark, expression, cases):
    """The expression on every text, in one query."""
    rows = spark.createDataFrame([(i, *case) for i, case in enumerate(cases)], "i int, t string, u string")
    return [r["x"] for r in rows.select("i", expression(F.col("t"), F.col("u")).alias("x")).orderBy("i").collect()]


PACKS = (
    [
        ("Net Weight: 40 Gummies", "40 Gummies"), ("Contains 25 Sticks", "25 Sticks"), ("Net Content: 40 N", "40 N"), ("Net Qty: 60 Nos", "60 Nos"), ("40Gummies in a pack", "40 Gummies"),
        ("Serving Size: 1 Gummy\nNet Content: 40 N", "40 N"), ("2 Gummies daily.\nContains 60 Gummies", "60 Gummies"), ("nothing here", ""), ("Net Content: 40 N\n40\nGUMMIES\nStrong bones", "40 GUMMIES"),
        ("10\nGUMMIES\nServing Size: 2 Gummies\nNo. of Serving: per container 20\nNet Content: 40 N", "40 GUMMIES"), ("10\nGUMMIES\nNet Content: 40 N", "10 GUMMIES"), ("Net Content: 40 N\nGUMMIES\n40\nHelps", "40 GUMMIES"),
        ("Serving Size:\nGummy 1\nNet Content: 40 N", "40 N"), ("Gummies 2 daily.\nNet Content: 60 N", "60 N"), ("40 Gummies\nSticks 12", "40 Gummies"), ("Herbs) GUMMIES 60 NUTRA\nNet Content: 40 N", "40 N"), ("GUMMIES\n40\nHelps", "40 GUMMIES"), ("Net Content: 100 g", ""), ("Net Content: 40 Nutritional Information", ""), ("Net Quantity: 12 units", "12 units"),
        ("1 Gummy to be taken as suggested by your dietitian", ""), ("Serving size for all adults is 2 gummies", ""), ("Recommended usage:\n1 Gummy\n\n60 Gummies", "60 Gummies"), ("60 Gummies\n\nTake 2 gummies, on most days, a day", "60 Gummies"),
        ("How to use\n\n30 Gummies", "30 Gummies"), ("1 Tablet daily 30 Tablets", "30 Tablets"), ("Dosage: 2 tablets", ""), ("Sticks 12\nserving size: 1 stick", "12 Sticks"),
    ]
)


def test_package_size(spark):
    assert answers(spark, lambda t, _: L.package_size(t), [(t, None) for t, _ in PACKS] + [(None, None)]) == [w for _, w in PACKS] + [""]


FLAVOURS = (
    [
        ("Lemon & Lime", ["Lemon", "Lime", "Red Plum"], "Lemon & Lime"), ("Lemon & Lime Flavour", [], "Lemon & Lime"), ("Red Plum Flavour", [], "Red Plum"), ("Lime", ["Lime"], "Lime"), ("Lime", [], ""), ("Natural Lime Flavouring", ["Lime"], ""),
        ("Free from Artificial Flavours", [], ""), ("Lemon, Lime & Plum Flavour", [], "Lemon, Lime & Plum"), ("Lemon-Lime Flavour", [], "Lemon-Lime"), ("Vitamin D Chews - Lime Flavour", [], "Lime"), ("Lemon &\nLime Flavour", [], "Lemon & Lime"),
        ("Lemon and Lime Flavour", [], "Lemon And Lime"), ("Lemon & Lime Flavour\n\nIngredients: Sugar, Water, Lemon-Lime Flavour, Colours", [], "Lemon & Lime"), ("Regulator (330), Dicalcium Phosphate, Lemon & Lime Flavour and Colour", [], "Lemon & Lime"),
        ("Sodium Citrate, Lime Flavour.", [], "Lime"), ("Dicalcium Phosphate Flavour", [], "Dicalcium Phosphate"),
        ("Contains no artificial colours or Lime Flavour", [], ""), ("Lime\nFlavour", [], "Lime"), ("made without " + "x" * 300 + "\nLime Flavour", [], "Lime"), ("Lime Flavour in a long line of words\nPlum Flavour", [], "Plum"),
    ]
)


def test_flavour(spark):
    for known in ([], ["Lime"], ["Lemon", "Lime", "Red Plum"]):
        cases = [(t, w) for t, k, w in FLAVOURS if k == known]
        assert answers(spark, lambda t, _: L.flavour(t, known), [(t, None) for t, _ in cases]) == [w for _, w in cases]


BLOCK = """BRIGHTCARE HEALTH PVT. LTD.
(An ISO Certified Company)
12, Lake Road,
Pune, India
Pincode - 411001
Customer Care: +91 20 1234 5678
Marketed By :
LIC. NO. 11111111111111
Pouches not to be sold loose."""


PLACES = (
    [
        (BLOCK, "BRIGHTCARE HEALTH PVT. LTD.", "12, Lake Road, Pune, India, Pincode - 411001"), ("Marketed By: Sun Chew Pvt. Ltd.\n42 Park, Mumbai", "Sun Chew Pvt. Ltd.", "42 Park, Mumbai"), ("Marketed By:\nSun Chew Pvt. Ltd.\n42 Park", "Sun Chew Pvt. Ltd.", "42 Park"),
        ("Marketed By:\nSun Labs Pvt Ltd.\nA Division of Sun Labs Pvt Ltd\nPlot No. 7/8, Baddi", "Sun Labs Pvt Ltd.", "Plot No. 7/8, Baddi"), ("Marketed By:\nSun Labs Pvt Ltd.\nTower 3, New Delhi- 110015", "Sun Labs Pvt Ltd.", "Tower 3, New Delhi - 110015"),
        ("Marketed By:\nSun Labs Pvt Ltd.\nPlot no.- 3/416, Jaipur - 302021", "Sun Labs Pvt Ltd.", "Plot no.- 3/416, Jaipur - 302021"),
        ("Sun Labs Ltd\nCustomer care: 1\nSun Labs Ltd\nOne\nTwo\n(Three)\nFour\nFive\nSix\nfor Sun Labs Ltd", "Sun Labs Ltd", "One, Two, Four, Five"), ("nothing", "", ""),
    ]
)


def test_company_and_address(spark):
    texts = [(t, None) for t, _, _ in PLACES]
    assert answers(spark, lambda t, _: L.marketing_company(t), texts) == [c for _, c, _ in PLACES]
    assert answers(spark, L.address, [(t, c) for t, c, _ in PLACES]) == [p for _, _, p in PLACES]


def test_column_extractors(spark):
    assert value(spark, X.licence(F.col("t")), LABEL) == "22222222222222"
    assert value(spark, X.care_number(F.col("t")), LABEL) == "+91 20 1234 5678"
    assert value(spark, X.email(F.col("t")), LABEL) == "care@bright.example.com"
    text = value(spark, X.ingredients_text(F.col("t")), LABEL)
    assert text.startswith("Sugar, Water")
    assert value(spark, X.top_level_items(F.col("t")), text) == ["Sugar", "Water", "Citric Acid (regulator, E330)", "Pectin"]
    assert value(spark, X.offsets(F.col("t"), "a"), "banana𝕏a") == [1, 3, 5, 7]
    assert value(spark, X.badge_claims(F.col("t")), "NON-GMO, no added sugar & halal") == ["No Added Sugar", "Non GMO", "Halal"]
    assert value(spark, X.free_from_claims(F.col("t")), "Gluten-free. Free from soy and dairy") == ["Gluten Free"]
    assert value(spark, X.table_format(F.col("t"), ["protein"]), "Protein per 100 g") == "Detailed (per 100g)"


@pytest.mark.parametrize("text, want", [("xxxx", True), ("----", True), ("(brand)", True), ("<<name>>", True), ("xxx", False), ("Insert your brand name here", True), ("dummy  text", True), ("For reference only", True), ("Kindly note the margins", True), ("Please do not edit", True), ("Marketed by:", True), ("Best before", True), ("PRICE", True), ("N/A", True), ("Not specified", False), ("to be confirmed by QA", True), ("Sample Textile Co", False), ("Brightol", False), ("Company Name & Logo", True), ("(if another address)", True), ("Complete Address with Pincode", True), ("Customer care phone number", True), ("email id", True), ("TBD", True), ("Company Name Foods Ltd.", False), ("Zinc (as citrate)", False), ("", False), (None, False)])
def test_placeholders(spark, text, want):
    assert value(spark, X.is_placeholder(F.col("t")), text) is want


@pytest.mark.parametrize("text, want", [("a bc de", True), ("go go gummies", True), ("Vitamin", False), ("Apple Cider", False), (None, False)])
def test_garbage(spark, text, want):
    assert value(spark, X.is_garbage(F.col("t")), text) is want


@pytest.mark.parametrize("text, want", [("Gelatin", True), ("Gelatin Free", True), ("12.00 mm", True), ("30 g", True), ("", True), ("Mc Mc Mg", True), ("Cmyk", True), ("Matt Uv", True), ("Emboss I Gr", True), ("UV Guard Chews", False), ("Golden Milk", False), ("Sleepwell", False)])
def test_missing_names(spark, text, want):
    assert value(spark, X.name_is_missing(F.col("t")), text) is want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Ingredients: Corn Syrup, Sugar, Water\n(INS 1), Zinc,   Iodine. This\nfood is by nature gluten free.", "Corn Syrup, Sugar, Water (INS 1), Zinc, Iodine."), ("See ingredients: overleaf, a, b.", None), ("Ingredientes: Miel, Agua, Pectina.", "Miel, Agua, Pectina."),
        ("Ingredients\nCorn, Sugar, Water.", "Corn, Sugar, Water."), ("Claims are\ningredient-based.\nFree of:\nA, B, C.\nIngredients: Malt, Water, Salt.", "Malt, Water, Salt."), ("Composition: A, B, C.\nPouches Mfg by: X Ltd. Y.", "A, B, C."), ("Ingredients: one, two", "one, two"), ("Ingredients: one", None), ("Ingredient List: Malt, Salt\nUsage instructions: two a day.", "Malt, Salt"),
    ],
)
def test_ingredients(spark, text, want):
    assert value(spark, X.ingredients_text(F.col("t")), text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("FREE FROM   GLUTEN | MILK | SOY \nFor all. Gluten free. By nature egg free", ["Free From Gluten | Milk | Soy"]), ("free from artificial | colours", []), ("This food is by its nature gluten free. NUT FREE", ["Nut Free"]),
        ("NO\nGELATIN no sugar, no doubt", ["No Gelatin", "No Sugar"]), ("No artificial colours, no artificial fragrance", []), ("No artificial fragrance", ["No Artificial"]), ("toll-free, soya-free", ["Soya Free"]),
        ("LIBRE DE LÁCTEOS LIBRE DE MANÍ\nlibre de pago", ["Libre de Lacteos", "Libre de Mani"]),
    ],
)
def test_free_from(spark, text, want):
    assert value(spark, X.free_from_claims(F.col("t")), text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Support Strong Bones\n& Healthy Growth. Rest", ["Support Strong Bones & Healthy Growth"]), ("Supports Hair Health Helps Maintain Healthy Skin", ["Supports Hair Health", "Helps Maintain Healthy Skin"]),
        ("DAILY SUPPORT\nSUPPORTS IMMUNITY", ["SUPPORTS IMMUNITY"]), ("Supports Sleep*", []), ("Helps you sleep well at night", []), ("Supports 100% Natural Wellness! Boosts 5 Enzymes", ["Supports 100% Natural Wellness"]),
        ("Provides 30 mg Zinc", []), ("Promotes the Growth of Bones. PROMOTES THE GROWTH OF BONES", ["Promotes the Growth of Bones"]), ("Supports Acme Foods Ltd", []), ("Helps Road Safety", []), ("Aids Digestion Store in a Dry Place", []),
        ("Supports", []), ("Nothing here", []), ("Helps One Two Three Four Five Six Seven Eight", []), ("", []), (" ".join(f"Supports {a}{b}." for a in "ABCD" for b in "abcde"), [f"Supports {a}{b}" for a in "ABCD" for b in "abcde"]),
    ],
)
def test_generic_claims(spark, text, want):
    assert value(spark, X.generic_claims(F.col("t")), text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Customer care: x@y.in 12345678901234", "12345678901234"), ("12345678901234\nhelpline", "12345678901234"), ("Customer care " + "." * 50 + " 12345678901234", None), ("12345678901234", None),
        ("Manufactured by: A FSSAI 11111111111111 " + "." * 50 + "\nToll free 22222222222222", "22222222222222"), ("email a@b.de 123456789012345", None), ("FSSAI No. 1111 1111 1111 11 email 22222222222222", "11111111111111"),
    ],
)
def test_licence(spark, text, want):
    assert value(spark, X.licence(F.col("t")), text) == want


NOISY = [("Acme Foods ™ x", "Acme Foods"), ("Acme Foods Vitamin C", "Acme Foods"), ("a b cd Foods", ""), ("12 Rd of St", "12 Rd of St"), ("ab", ""), ("Sun Labs Pvt lid.", "Sun Labs Pvt Ltd")]


def test_noise(spark):
    assert [x.rstrip(".") for x in answers(spark, lambda t, _: L.cut_noise(t), [(t, None) for t, _ in NOISY])] == [w for _, w in NOISY]


def test_long_texts_take_time_in_proportion(spark):
    """A megabyte of claims, items or lines in seconds."""
    texts = {
        "claims": ("Supports Immunity. Helps The Heart. Plain words and more of them here. " * 15_000, lambda t, _: F.size(X.generic_claims(t)), 2),
        "items": ("Sugar, Water (pure, soft), Citric Acid [E330, E331], " * 20_000, lambda t, _: F.size(X.top_level_items(t)), 60_000),
        "brackets": ("(" * 50_000 + "," + ")" * 50_000 + ",", lambda t, _: F.size(X.top_level_items(t)), 1),
        "lines": ("Sun Labs Ltd\nLime Flavour\n30 Gummies\nBIG NAME\n" * 20_000, lambda t, _: F.concat_ws("|", L.title(t)["product"], L.flavour(t, ["Plum"]), L.package_size(t), L.address(t, F.lit("sun labs"))), "BIG NAME|Lime|30 Gummies|Lime Flavour, 30 Gummies, BIG NAME, Sun Labs Ltd"),
    }
    for name, (text, expression, want) in texts.items():
        began = time.perf_counter()
        assert answers(spark, expression, [(text, None)]) == [want], name
        assert time.perf_counter() - began < 40, name


@pytest.mark.parametrize("text, want", [("a (b, c), d", ["a (b, c)", "d"]), ("a), b", ["a)", "b"]), (")),(,", ["))", "(,"]), ("a [b (c, d], e), f.", ["a [b (c, d], e)", "f"]), (" , ,", []), ("x" * 70 + ", y" * 70, ["x" * 70] + ["y"] * 70)])
def test_items(spark, text, want):
    assert value(spark, X.top_level_items(F.col("t")), text) == want


def test_badges(spark):
    text = "natural colors and flavors; NON GMO, no preservatives. GMP certified, Usfda registered facility"
    assert value(spark, X.badge_claims(F.col("t")), text) == ["Natural Colours & Flavours", "No Preservatives", "Non GMO", "USFDA Registered Facility", "GMP Certified"]


def test_lines_and_tables():
    rows = [["Title"], ["Nutritional Information"], ["Energy", "10 kcal"], ["Protein (g)", "2 g", "4%"], ["Sodium 7 mg"], ["Vitamin B12 2 mcg"], ["Vitamin D3 400 IU"], ["A", "1 g", "5%", "B", "2 g", "6%"], ["Energy", "99"], ["Storage"], ["Iron", "1"]]
    assert G.nutrition_rows(rows) == {"Energy": "10 kcal", "Protein (g)": "2 g", "Sodium": "7 mg", "Vitamin B12": "2 mcg", "Vitamin D3": "400 IU", "A": "1 g", "B": "2 g"}
    assert len(np.unique(G.components(np.array([[1, 1, 0, 1], [0, 1, 0, 1], [1, 0, 0, 0]], dtype=bool)))) == 4


def test_overlapping_lines(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, 0.9, "a"), (1, 0.0, 0.0, 10.0, 9.0, 0.8, "b"), (1, 5.0, 0.0, 15.0, 10.0, 0.7, "c")], "page int, x0 double, y0 double, x1 double, y1 double, confidence double, text string")
    assert {r["text"] for r in G.without_overlaps(rows, "page").collect()} == {"a", "c"}


@pytest.mark.parametrize("most", [200_000, 40, 3])
def test_overlaps_of_a_crowded_page(spark, monkeypatch, most):
    """Settled by page, by component, and in rounds."""
    monkeypatch.setattr(G, "SETTLED", most)
    def iou(a, b):
        w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
        both = max(w, 0) * max(h, 0)
        return both / (400 - both)

    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        x, y = (float(v) for v in rng.integers(0, 12, 2) * (1 + 9 * (i % 3)))
        rows.append((int(i % 2), x, y, x + 20, y + 10, float(rng.integers(0, 5)), f"t{i % 40}"))
    got = G.without_overlaps(spark.createDataFrame(rows, "page int, x0 double, y0 double, x1 double, y1 double, confidence double, text string"), "page").collect()
    want = []
    for page in (0, 1):
        kept = []
        for r in sorted({r for r in rows if r[0] == page}, key=lambda r: (-r[5], r[2], r[1], r[6])):
            if all(iou(r, k) <= 0.7 for k in kept):
                kept.append(r)
        want += kept
    assert sorted(map(tuple, got)) == sorted(want)


def plainly_kept(rows, limit=0.7):
    """Rows (page, x0, y0, x1, y1, confidence, text) that stay, one after the other."""
    kept = []
    for r in sorted(set(rows), key=lambda r: (-r[5], r[2], r[1], r[6], r[3], r[4])):
        def far(k):
            w, h = min(r[3], k[3]) - max(r[1], k[1]), min(r[4], k[4]) - max(r[2], k[2])
            area = lambda b: (b[3] - b[1]) * (b[4] - b[2])
            return r[0] == k[0] and (r[1:5] == k[1:5] or w > 0 and h > 0 and w * h / (area(r) + area(k) - w * h) > limit)

        if not any(far(k) for k in kept):
            kept.append(r)
    return kept


def random_boxes(seed, n, pages):
    rng = np.random.default_rng(seed)
    at = rng.integers(-30, 30, (n, 2)) * 2.5
    return [(int(i % pages), float(x), float(y), float(x + w), float(y + h), float(c), f"t{i % 7}") for i, ((x, y), w, h, c) in enumerate(zip(at, rng.integers(0, 5, n) * 20.0, rng.integers(1, 4, n) * 30.0, rng.integers(0, 4, n)))]


@pytest.mark.parametrize("most", [0, 60, 2048])
def test_overlaps_of_small_and_large_pages(spark, monkeypatch, most):
    """e_14, u_10: all pages by cells, large ones by cells and small ones in a group each, all in a group each; boxes
    with a null side and boxes without a page overlap none."""
    monkeypatch.setattr(G, "PAGE_BOXES", most)
    rows = random_boxes(3, 150, 3) + random_boxes(4, 60, 1)
    unknown = [(0, None, 0.0, 40.0, 30.0, 9.0, "null"), (1, float("nan"), 0.0, 40.0, 30.0, 9.0, "nan"), (None, 0.0, 0.0, 10.0, 10.0, 1.0, "a"), (None, 0.0, 0.0, 10.0, 9.0, 1.0, "b")]
    table = spark.createDataFrame(rows + unknown, "page int, x0 double, y0 double, x1 double, y1 double, confidence double, text string")
    assert sorted(map(repr, map(tuple, G.without_overlaps(table, "page").collect()))) == sorted(map(repr, plainly_kept(rows) + unknown))


@pytest.mark.parametrize("pairs", [1, 50, 1 << 18])
def test_kept_boxes(monkeypatch, pairs):
    monkeypatch.setattr(G, "PAIRS", pairs)
    for seed in range(4):
        rows = sorted({r[1:5]: r for r in random_boxes(seed, 40, 1)}.values(), key=lambda r: (-r[5], r[2], r[1], r[6], r[3], r[4]))
        for turned in (False, True):
            sides = np.array([r[1:5] for r in rows]).T[[1, 0, 3, 2] if turned else [0, 1, 2, 3]]
            assert [r for r, k in zip(rows, G.kept_boxes(*sides, 0.3)) if k] == plainly_kept(rows, 0.3)
    assert G.kept_boxes(*np.zeros((4, 0)), 0.7).tolist() == [] and G.kept_boxes(*np.zeros((4, 3)), 0.7).all()


def test_overlaps_of_small_pages_take_one_shuffle(spark):
    """e_14, u_10"""
    table = spark.createDataFrame(random_boxes(5, 50, 2), "page int, x0 double, y0 double, x1 double, y1 double, confidence double, text string")
    plan = G.without_overlaps(table, "page")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("most", [0, 2048])
def test_best_of_equal_boxes(spark, monkeypatch, most):
    """e_14, u_10: of equal boxes the best stays, by either way, also where boxes overlap nothing: without an area, with
    unknown sides, without a page. In a group they are found by rank, without an aggregate in front."""
    monkeypatch.setattr(G, "PAGE_BOXES", most)
    nan = float("nan")
    places = [(1, 0.0, 0.0, 10.0, 10.0), (1, 0.0, 5.0, 0.0, 5.0), (1, None, 0.0, 9.0, 9.0), (1, nan, 0.0, 9.0, 9.0), (1, None, None, None, None), (None, 0.0, 0.0, 10.0, 10.0)]
    votes = [(1.0, "b"), (2.0, "z"), (2.0, "y"), (None, "n"), (nan, "x")]  # unknown confidence goes before any other
    table = spark.createDataFrame([(*p, *v) for p in places for v in votes] + [(2, 0.0, 0.0, 9.0, 9.0, 2.0, "b"), (2, -0.0, -0.0, 9.0, 9.0, 2.0, "a")], "page int, x0 double, y0 double, x1 double, y1 double, confidence double, text string")
    got = G.without_overlaps(table, "page")
    want = [(*p, None, "n") for p in places] + [(2, 0.0, 0.0, 9.0, 9.0, 2.0, "a")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert not most or "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_first_of_equal():
    nan = np.nan
    assert G.first_of_equal([np.array([1.0, nan, 1.0, nan, nan, 0.0, -0.0]), np.array([2.0, 2.0, 2.0, 2.0, nan, 1.0, 1.0])]).tolist() == [True, True, False, False, True, True, False]
    assert G.first_of_equal([np.array([nan, nan, nan]), np.array([True, False, True])]).tolist() == [True, True, False]
    assert G.first_of_equal([np.zeros(0)]).tolist() == []


def test_a_chain_of_overlaps(spark, monkeypatch):
    """Every box overlaps the next one: the number of jobs does not follow the length of the chain."""
    chain = [(1, 10.0 * i, 0.0, 10.0 * i + 100, 10.0, 1.0 - i / 10_000, f"t{i}") for i in range(5000)]
    table = spark.createDataFrame(chain, "page int, x0 double, y0 double, x1 double, y1 double, confidence double, text string")
    monkeypatch.setattr(G, "_peeled", lambda links: [] if links.isEmpty() else pytest.fail("rounds"))
    kept = {r["text"] for r in G.without_overlaps(table, "page").collect()}
    want, last = set(), None
    for r in chain:
        if last is None or (shared := last + 100 - r[1]) <= 0 or shared / (200 - shared) <= 0.7:
            want.add(r[6])
            last = r[1]
    assert kept == want and 1000 < len(want) < 3000


def test_ink_regions(spark):
    grid = np.zeros((32, 64), dtype=int)
    grid[2:6, 2:12], grid[20:30, 30:40], grid[0, 63] = 20, 15, 99
    rows = spark.createDataFrame([(1, grid.ravel().tolist())], "id int, g array<int>")
    assert [(r["rank"], r["mass"]) for r in G.ink_regions(rows, "id", "g").orderBy("rank").collect()] == [(1, 1500), (2, 800)]


def flooded(grid):
    """Regions by flood fill."""
    out, (high, wide) = np.zeros(grid.shape, dtype=int), grid.shape
    for r, c in zip(*np.nonzero(grid)):
        if not out[r, c]:
            out[r, c], todo = r * wide + c + 1, [(r, c)]
            while todo:
                y, x = todo.pop()
                for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if 0 <= v < high and 0 <= u < wide and grid[v, u] and not out[v, u]:
                        out[v, u] = r * wide + c + 1
                        todo.append((v, u))
    return out


def spiral(n):
    grid, y, x, dy, dx = np.zeros((n, n), dtype=bool), 0, 0, 0, 1
    grid[0, 0] = True
    turns = 0
    while turns < 2:
        v, u = y + dy, x + dx
        ahead = (y + 2 * dy, x + 2 * dx)
        if 0 <= v < n and 0 <= u < n and not grid[v, u] and not (0 <= ahead[0] < n and 0 <= ahead[1] < n and grid[ahead]):
            y, x, turns = v, u, 0
            grid[y, x] = True
        else:
            dy, dx, turns = dx, -dy, turns + 1
    return grid


def test_winding_regions():
    """A spiral and a comb are one region each, in a time that follows their cells."""
    comb = np.zeros((999, 999), dtype=bool)
    comb[:, ::2], comb[-1] = True, True
    for grid in (spiral(501), comb):
        began = time.perf_counter()
        assert set(np.unique(G.components(grid))) == {0, 1}
        assert time.perf_counter() - began < 5
    rng = np.random.default_rng(5)
    for share in (0.3, 0.55, 0.7):
        grid = rng.random((40, 37)) < share
        assert np.array_equal(G.components(grid), flooded(grid))
    assert not G.components(np.zeros((3, 4), dtype=bool)).any()


def test_cascade(spark):
    rows = spark.createDataFrame([(1, "Gummies", "Vitamin C", None)], "id int, text_product_name string, ocr_product_name string, vlm_product_name string")
    got = K.merged(rows, "id", ["product_name"], ["text", "ocr", "vlm"], overridable="gummies").first()
    assert (got["value"], got["source"]) == ("Vitamin C", "ocr")


def test_files(spark, tmp_path):
    (tmp_path / "a_p1.json").write_text(json.dumps({"sourceFile": "a", "page": 1, "label": {"brand_name": "B", "claims": ["x"], "nutrition_table": {"P": "1 g"}}}))
    (tmp_path / "notes.txt").write_text("no")
    row = files.annotations(spark, str(tmp_path)).first()
    assert (row["slug"], row["label"]["brand_name"], row["label"]["nutrition_table"]) == ("a_p1", "B", {"P": "1 g"})
    (tmp_path / "m.tsv").write_text("sourceFile\tpage\na\t1\na\t2\nb\t1\n")
    assert sorted((r["sourceFile"], r["pages"]) for r in files.manifest(spark, str(tmp_path / "m.tsv")).collect()) == [("a", 2), ("a", 2), ("b", 1)]
    files.write_training(spark.createDataFrame([(1, True), (2, False)], "id int, validation boolean"), str(tmp_path / "out"))
    assert {(r["id"], r["split"]) for r in spark.read.json(str(tmp_path / "out")).collect()} == {(1, "val"), (2, "train")}
    files.write_csv(spark.createDataFrame([('a"b,c',)], "x string"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, quote='"', escape='"').first()["x"] == 'a"b,c'


def test_versions(spark):
    rows = [(1, "p", "A", 1, "Approved"), (2, "p", "A", 2, "Rejected"), (3, "p", "A", 4, "Draft"), (4, "q", "A", 1, "Draft"), (5, "p", "B", 3, "Final Approved")]
    art = spark.createDataFrame(rows, "id int, product_id string, artwork_type string, version_number int, status string")
    assert {r["id"] for r in W.latest_approved(art).collect()} == {1, 5}
    assert {r["id"] for r in W.version_gaps(art).collect()} == {3, 5}
    assert {(r["id"], r["reference_id"]) for r in W.with_baseline(art).collect()} == {(1, None), (2, 1), (3, 1), (4, None), (5, None)}


def test_decisions_by_role(spark):
    tried = spark.createDataFrame([(1, "QA", "approve", "qa"), (2, "QA", "approve", "manager"), (3, "Manager", "reject", "manager"), (4, "Technical", "reject", "technical")], "comparison_id int, stage string, decision string, role string")
    assert {r["comparison_id"] for r in workflow.refused(tried).collect()} == {2, 4}
    log = spark.createDataFrame([], "comparison_id int, stage string, resulting_status string, action string")
    assert {(r["comparison_id"], r["resulting_status"]) for r in workflow.decided(log, tried).collect()} == {(1, "Pending Manager Approval"), (3, "Rejected")}


def test_stale_and_valid_sessions(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    rows = spark.createDataFrame([(1, "u", "2024-01-10", None), (2, "u", "2024-01-10", "2024-01-02"), (3, "v", "2023-01-01", None)], "id int, user_id string, e string, r string")
    rows = rows.select("id", "user_id", F.col("e").cast("timestamp").alias("expires_at"), F.col("r").cast("timestamp").alias("revoked_at"))
    users = spark.createDataFrame([("u", "Active"), ("v", "Inactive")], "user_id string, status string")
    assert [r["id"] for r in O.valid_sessions(rows, users, at("2024-01-05")).collect()] == [1]
    assert [r["id"] for r in rows.where(O.stale_sessions(at("2024-01-05"), 30)).collect()] == [3]


def test_streams(spark, sf, tmp_path):
    log = spark.read.parquet(f"{sf}/events.parquet")
    for i in range(3):
        log.where(F.col("event_id") % 3 == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(decisions.LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))

    def drained(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    twice = stream.unionByName(stream)
    assert len(drained(decisions.without_repeats(twice, "400 days"), "append", "once")) == log.count()
    newest = {}
    for r in drained(decisions.latest_state(stream), "update", "state"):
        newest[r["user_id"]] = max(newest.get(r["user_id"], -1), r["event_id"])
    want = {r["user_id"]: r["e"] for r in log.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}
    assert newest == want


@pytest.mark.parametrize("r, g, b, want", [(255, 255, 255, "White"), (240, 235, 225, "Cream"), (250, 250, 248, "White"), (30, 30, 30, "Black"), (128, 120, 128, "Grey"), (120, 70, 30, "Brown"), (255, 140, 0, "Orange"), (255, 0, 0, "Red"), (250, 230, 20, "Yellow"), (0, 160, 60, "Green"), (0, 128, 128, "Teal"), (20, 40, 200, "Blue"), (120, 20, 180, "Purple"), (255, 20, 147, "Pink"), (255, 0, 60, "Red"), (244, 232, 209, "Orange")])
def test_colour_names(spark, r, g, b, want):
    from labelloom.operators.aggregates import hue_name

    assert spark.range(1).select(hue_name(F.lit(r), F.lit(g), F.lit(b)).alias("x")).first()["x"] == want
