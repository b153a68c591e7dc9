"""Operators on written-out cases: every row of a table takes one case by its id, and SQL has the expected answers.

These stand beside the queries of the same operators over whole tables, whose rules SQL cannot state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators import boxes as D
from labelloom.operators import cascade as K
from labelloom.operators import extract as X
from labelloom.operators import geometry as G
from labelloom.operators import label_text as L
from labelloom.operators import scoring as S
from labelloom.operators.shared import spread
from labelloom.sources.domain import table

Q: dict = {}
SQL: dict = {}


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_sql, value)) + "]" + "::VARCHAR[]" * (not value)
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def values(name: str, kind: str, cases: list[tuple], answer: Callable[[DataFrame], DataFrame]) -> None:
    """A query (id, x) over the parts: x is the answer to the case of the id. cases: (text, expected)."""
    cast = {"string": "VARCHAR", "boolean": "BOOLEAN", "list": "VARCHAR[]", "long": "BIGINT"}[kind]
    SQL[name] = f"SELECT p_partkey AS id, ([{', '.join(f'{_sql(want)}::{cast}' for _, want in cases)}])[p_partkey % {len(cases)} + 1] AS x FROM part"

    def run(spark, sf):
        texts = F.array(*[F.lit(t).cast("string") for t, _ in cases])
        ids = spread(table(spark, sf, "part").select(F.col("p_partkey").alias("id")))
        rows = ids.select("id", F.get(texts, (F.col("id") % len(cases)).cast("int")).alias("t"))
        return answer(rows).select("id", "x")

    Q[name] = run


def pages(name: str, schema: str, given: list[list[tuple]], wanted: str, expected: list[list[tuple]], answer: Callable[[DataFrame], DataFrame]) -> None:
    """A query over the suppliers as pages: page p holds the rows of case p modulo the number of cases."""
    names = [c.split()[0] for c in wanted.split(", ")]
    kinds = [{"long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}[c.split()[1]] for c in wanted.split(", ")]
    lines = [(k, *row) for k, rows in enumerate(expected) for row in rows]
    listed = ", ".join("(" + ", ".join(f"{_sql(v)}::{kind}" for v, kind in zip(line, ["BIGINT", *kinds], strict=True)) + ")" for line in lines)
    SQL[name] = f"SELECT s_suppkey AS page, {', '.join(names)} FROM supplier JOIN (VALUES {listed}) AS v(k, {', '.join(names)}) ON s_suppkey % {len(given)} = k"

    def run(spark, sf):
        rows = spark.createDataFrame([(k, *row) for k, page in enumerate(given) for row in page], f"k long, {schema}")
        keys = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page"), (F.col("s_suppkey") % len(given)).alias("k"))
        return answer(keys.join(F.broadcast(rows), "k").drop("k")).select("page", *names)  # the cases are few and fixed

    Q[name] = run


def by_column(expression) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.select("id", expression(F.col("t")).alias("x"))


def by_field(field: str, flavours: list[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: L.label_fields(rows, "id", "t", flavours, [field]).withColumnRenamed(field, "x")


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
BLOCK = """BRIGHTCARE HEALTH PVT. LTD.
(An ISO Certified Company)
12, Lake Road,
Pune, India
Customer Care: +91 20 1234 5678
Marketed By :
LIC. NO. 11111111111111"""
DIVISION = "Marketed By:\nSun Labs Pvt Ltd.\nA Division of Sun Labs Pvt Ltd\nPlot No. 7/8, Baddi"


def cut(text):
    return L.cut_noise(text)


values("x_05_cases", "string", [("Acme Foods ™ x", "Acme Foods"), ("Acme Foods Vitamin C", "Acme Foods"), ("a b cd Foods", ""), ("12 Rd of St", "12 Rd of St"), ("ab", ""), (None, ""), ("| Acme", ""), ("Acme — Foods", "Acme")], by_column(cut))
values("x_06_cases", "string", [(LABEL, "Bright Health Pvt Ltd"), (BLOCK, "BRIGHTCARE HEALTH PVT. LTD."), (DIVISION, "Sun Labs Pvt Ltd."), ("Marketed By: Sun Chew Pvt. Ltd.\n42 Park", "Sun Chew Pvt. Ltd."), ("Sun Chew Pvt. Ltd.\n42 Park", ""), ("", ""), (None, "")], by_field("marketing_company"))
values("x_07_cases", "string", [(LABEL, "12 Park Street, Pune"), (BLOCK, "12, Lake Road, Pune, India"), (DIVISION, "Plot No. 7/8, Baddi"), ("Address: 1 Low Road, Delhi- 110015", "1 Low Road, Delhi - 110015"), ("Regd. Office: 9 High Street", "9 High Street"), ("no place", ""), (None, "")], by_field("address"))
values(
    "x_08_cases", "string",
    [(LABEL, "22222222222222"), ("FSSAI No. 1234 5678 9012 34", "12345678901234"), ("Customer care: x@y.in 12345678901234", "12345678901234"), ("Customer care " + "." * 50 + " 12345678901234", None), ("12345678901234", None), ("Manufactured by: A Lic. No. 11111111111111", None), ("FSSAI 123", None), (None, None)],
    by_column(X.licence),
)
values(
    "x_09_cases", "string",
    [(LABEL, "30 Gummies"), ("Net Content: 40 N", "40 N"), ("Serving Size: 1 Gummy\nNet Content: 40 N", "40 N"), ("2 Gummies daily.\nContains 60 Gummies", "60 Gummies"), ("Net Content: 40 N\nGUMMIES\n40\nHelps", "40 GUMMIES"), ("Net Content: 100 g", ""), ("10\nGUMMIES\nNet Content: 40 N", "10 GUMMIES"), ("1 Gummy to be taken as suggested by your dietitian", ""), ("Serving size for all adults is 2 gummies", ""), ("Recommended usage:\n1 Gummy\n\n60 Gummies", "60 Gummies"), ("", "")],
    by_field("package_size"),
)
values("x_11_cases", "string", [(LABEL, "+91 20 1234 5678"), ("Toll free 1800 123 4567", "1800 123 4567"), ("call (no number)", None), ("Phone: 12", None), ("+91 20 1234 5678", None), (None, None)], by_column(X.care_number))
values(
    "x_13_cases", "string",
    [(LABEL, "Mango"), ("Lemon & Lime Flavour", "Lemon & Lime"), ("Free from Artificial Flavours", ""), ("Sodium Citrate, Lime Flavour.", "Lime"), ("Flavour: red plum", "Red Plum"), ("A lime drink", "Lime"), ("Natural Lime Flavouring", ""), ("Ingredients: lime", ""), ("", "")],
    by_field("flavour", ["Lime", "Red Plum"]),
)
values("x_14_cases", "string", [(LABEL, "VITAMIN C GUMMIES"), ("ZINC TABLETS\nfor all", "ZINC TABLETS"), ("words only\nin lower case", ""), ("BEST BEFORE\nSUN\nSLEEP WELL\nSOFT CHEWS", "SLEEP WELL SOFT CHEWS"), (None, "")], by_field("product"))
values("x_15_cases", "string", [(LABEL, "NUTRA"), ("ZINC TABLETS\nfor all", ""), ("Sun Valley\nwords", "Sun Valley"), ("Marketed by: X\nSun Valley", ""), ("all of it in lower case", ""), (None, "")], by_field("brand"))
values(
    "x_17_cases", "list",
    [(LABEL, ["NUTRA", "VITAMIN C GUMMIES", "Mango", "Bright Health Pvt Ltd", "12 Park Street, Pune", "30 Gummies", "22222222222222", "care@bright.example.com", "+91 20 1234 5678", "Supports Immunity"]), ("", [""] * 10), (None, [""] * 10)],
    lambda rows: L.label_fields(rows, "id", "t", ["Mango"]).select("id", F.array(*L.FIELDS, "fssai_number", "customer_care_email", "customer_care_number", F.array_join("claims", " | ")).alias("x")),
)
values(
    "x_18_cases", "string",
    [
        (LABEL, "Sugar, Water, Citric Acid (regulator, E330), Pectin."), ("Ingredients: one, two", "one, two"), ("Ingredients: one", None), ("See ingredients: a, b", None), ("Ingredientes: Miel, Agua, Pectina.", "Miel, Agua, Pectina."),
        ("Claims are\ningredient-based.\nComposition: A, B.\nPouches not for sale", "A, B."), ("Ingredient List: Malt, Salt\nUsage instructions: two.", "Malt, Salt"), (None, None),
    ],
    by_column(X.ingredients_text),
)
values("x_21_cases", "list", [("NON-GMO, no added sugar & halal", ["No Added Sugar", "Non GMO", "Halal"]), ("natural colors and flavors. Usfda registered facility", ["Natural Colours & Flavours", "USFDA Registered Facility"]), ("no added preservatives; GMP certified", ["No Added Preservatives", "GMP Certified"]), ("no preservatives, 100% Vegetarian", ["No Preservatives", "Vegetarian"]), ("no artificial colour", ["No Artificial Colours"]), ("vegetarians, nongmos", [])], by_column(X.badge_claims))
values(
    "x_22_cases", "list",
    [
        ("FREE FROM   GLUTEN | MILK | SOY \nGluten free", ["Free From Gluten | Milk | Soy"]), ("free from artificial | colours", []), ("This food is by its nature gluten free. NUT FREE", ["Nut Free"]), ("NO\nGELATIN no sugar, no doubt", ["No Gelatin", "No Sugar"]),
        ("No artificial colours", []), ("toll-free, soya-free", ["Soya Free"]), ("LIBRE DE LÁCTEOS LIBRE DE MANÍ\nlibre de pago", ["Libre de Lacteos", "Libre de Mani"]), ("Free from soy and dairy", []),
    ],
    by_column(X.free_from_claims),
)
values(
    "x_24_cases", "list",
    [
        ("Support Strong Bones\n& Healthy Growth. Rest", ["Support Strong Bones & Healthy Growth"]), ("Supports Hair Health Helps Maintain Healthy Skin", ["Supports Hair Health", "Helps Maintain Healthy Skin"]), ("DAILY SUPPORT\nSUPPORTS IMMUNITY", ["SUPPORTS IMMUNITY"]),
        ("Supports Sleep*", []), ("Helps you sleep well at night", []), ("Supports 100% Natural Wellness! Boosts 5 Enzymes", ["Supports 100% Natural Wellness"]), ("Provides 30 mg Zinc", []), ("Supports Acme Foods Ltd", []), ("Helps Road Safety", []), ("Aids Digestion Store in a Dry Place", []),
        ("Promotes the Growth of Bones. PROMOTES THE GROWTH OF BONES", ["Promotes the Growth of Bones"]), ("Supports", []), ("Reduces Fees at www.example.org", []), (None, None),
    ],
    by_column(X.generic_claims),
)
values("x_25_cases", "string", [("Protein per 100 g", "Detailed (per 100g)"), ("Energy per serving", "Standard (per serving)"), ("Energy and protein", ""), ("per Gummy: sodium", "Standard (per gummy)"), ("per 100ml", "Detailed (per 100ml)"), ("", "")], by_column(lambda t: X.table_format(t, ["protein", "sodium", "energy"])))
PLACEHOLDERS = [
    ("xxxx", True), (" . xXxXx .", True), ("xxx", False), ("----", True), (". . . .", True), ("--", False), ("(brand)", True), ("[any text]", True), ("Zinc (as citrate)", False), ("Lorem ipsum dolor", True), ("to be confirmed by QA", True),
    ("Insert your brand name here", True), ("dummy  text", True), ("Sample Textile Co", False), ("For reference only", True), ("Kindly note the margins", True), ("A kindly note", False), ("Please do not edit", True), ("TBD", True), ("n/a", True), ("TBD Foods", False),
    ("Company Name & Logo", True), ("Company Name Foods Ltd.", False), ("Marketed by:", True), ("Best before", True), ("PRICE", True), ("Priceless", False), ("email id", True), ("Brightol", False), ("", False), (None, False),
]
values("x_26_cases", "boolean", PLACEHOLDERS, by_column(X.is_placeholder))
values("x_27_cases", "string", [(t, None if x else t) for t, x in PLACEHOLDERS], lambda rows: X.scrubbed(rows.withColumn("x", F.col("t")), ["x"]))
values(
    "x_30_cases", "boolean",
    [("None.", True), (" Not visible. ", True), ("No brand is visible", True), ("I cannot read it", True), ("Unable to say", True), ("unknown", True), ("Nonesuch", False), ("Not a bad day", False), ("Visible", False), ("", False)],
    by_column(X.is_non_answer),
)
values("e_11_cases", "boolean", [("Vitamin C", True), ("AB", False), ("one two three four five six seven", False), ("#$%&* ab!c", False), ("1a 2b 3c abc", False), ("B12 D3 chews", True), ("", False)], by_column(G.is_display_text))
values("e_20_cases", "boolean", [("Gummies|gummies!|90", True), ("Gum|gummies|90", False), ("Gummies|gummies|69", False), ("Gummies|ummies|70", True), ("Gummies|tablets|99", False)], by_column(lambda t: D.cross_validated(F.split(t, r"\|")[0], F.split(t, r"\|")[1], F.split(t, r"\|")[2].cast("double"))))
values("e_21_cases", "string", [("no of Serving Size one", "3:2"), ("serving size", "1:2"), ("serving of size", None), ("a b c", None), ("size serving size serving size", "2:2")], lambda rows: rows.select("id", D.anchor_windows(F.split("t", " "), "serving size").alias("f")).select("id", F.when(F.col("f").isNotNull(), F.concat_ws(":", "f.start", "f.size")).alias("x")))
values("e_28_cases", "string", [("Soft - chews", "Soft-chews"), ("Vita  min", "Vita min"), ("abc", None), ("Vita* min", None), ("12345", None), ("C'est bon & fin.", "C'est bon & fin.")], by_column(D.clean_heading))


def both_sides(t):
    return F.split(t, r"\|")[0], F.split(t, r"\|")[1]


def counted(struct):
    return F.concat_ws(":", struct["correct"], struct["wrong"], struct["missing"])


FUZZY = [("Vitamin C|vitamin c", True), ("Mango Punch|Mango", True), ("abc|abcd", True), ("abc|xabcyz", False), ("abcdefghij|abcdefghiX", True), ("abcdefghij|abcdXXXXXX", False), ("|abc", False), ("20 mg|20mg", True), ("colour|color", True), ("red|rod", False)]
values("q_06_cases", "boolean", FUZZY, by_column(lambda t: S.fuzzy_match(*both_sides(t))))
values("q_07_cases", "string", [("a b c d|a b c d", "1:0:0"), ("Mango Punch|Mango", "1:0:0"), ("red|rod", "0:1:0"), ("|", "1:0:0"), ("|red", "0:0:1"), ("red|", "0:1:0"), ("abcdefghij|abcdefghiX", "1:0:0")], by_column(lambda t: counted(S.fuzzy_tri_state(*both_sides(t)))))
values(
    "q_08_cases", "string",
    [("sugar,water,zinc|water,sugar,zinc", "3:0:0"), ("sugar|sugar,sugar", "1:0:1"), ("citric acid,salt|acid citric", "1:1:0"), ("cane sugar|sugar", "1:0:0"), ("iron|zinc", "0:1:1"), ("|zinc", "0:0:1"), ("|", "1:0:0"), ("corn syrup|corn sirup", "1:0:0")],
    lambda rows: S.greedy_list_score(rows.select("id", *[F.split(c, ",").alias(n) for n, c in zip("gw", both_sides(F.col("t")), strict=True)]), "id", "g", "w").select("id", F.concat_ws(":", "correct", "wrong", "missing").alias("x")),
)


# pages of spans: (x, y, width, font_size, rotation, text), y upwards

SPAN = "x double, y double, width double, font_size double, rotation double, text string"
UP, SIDE = 0.0, 1.5707963267948966
FLAT = [(50.0, 700.0, 20.0, 10.0, UP, "world"), (10.0, 701.0, 30.0, 10.0, UP, "hello"), (10.0, 680.0, 40.0, 10.0, UP, "next"), (55.0, 677.0, 20.0, 4.0, UP, "small"), (10.0, 500.0, 90.0, 40.0, UP, "BIG"), (10.0, 400.0, 5.0, 40.0, UP, "7")]
TURNED = [(100.0, 10.0, 20.0, 10.0, SIDE, "a"), (101.0, 40.0, 20.0, 10.0, SIDE, "b"), (10.0, 20.0, 10.0, 8.0, UP, "c")]
grouped = lambda rows: G.lines(G.rotated(rows), ["page", "bucket"])
LINES = [[(0, 0, "hello world", 2), (0, 1, "next", 1), (0, 2, "small", 1), (0, 3, "BIG", 1), (0, 4, "7", 1)], [(157, 0, "a b", 2), (0, 0, "c", 1)]]
for _name in ("e_02_cases", "w_08_cases"):
    pages(_name, SPAN, [FLAT, TURNED], "bucket long, line long, text string, n long", LINES, grouped)
pages("e_04_cases", SPAN, [FLAT, TURNED], "text string", [[("hello world\nnext\nsmall\nBIG\n7",)], [("c\n\na b",)]], lambda rows: G.reading_text(grouped(rows), "page", "bucket"))
for _name in ("e_06_cases", "t_07_cases"):
    pages(_name, SPAN, [FLAT, TURNED], "text string, font_size double, rank int", [[("BIG", 40.0, 1)], []], lambda rows: G.display_lines(grouped(rows), ["page"]))
ROW = [(10.0, 0.0, 20.0, 10.0, UP, "Energy"), (60.0, 0.0, 10.0, 10.0, UP, "12"), (72.0, 0.0, 20.0, 10.0, UP, "kcal"), (120.0, 0.0, 9.0, 10.0, UP, "5%")]
for _name in ("e_05_cases", "w_09_cases"):
    pages(_name, SPAN, [ROW, FLAT[:1]], "cell long, text string", [[(1, "Energy"), (2, "12 kcal"), (3, "5%")], [(1, "world")]], lambda rows: G.cells(G.rotated(rows), ["page"]))
pages("s_09_cases", SPAN, [[(10.0, 0.0, 20.0, 10.0, UP, "Vita"), (32.0, 0.0, 20.0, 10.0, UP, "min"), (60.0, 0.0, 5.0, 10.0, UP, "C")], FLAT[:1]], "text string, x double, end_ double", [[("Vitamin", 10.0, 52.0), ("C", 60.0, 65.0)], [("world", 50.0, 70.0)]], lambda rows: D.merged_runs(rows, ["page"]).withColumnRenamed("end", "end_"))
pages("w_10_cases", "x0 double, y0 double, text string", [[(5.0, 10.0, "a"), (1.0, 14.0, "b"), (9.0, 16.0, "c"), (0.0, 17.0, "d")], [(0.0, 0.0, "z")]], "text string, row long", [[("a", 0), ("b", 0), ("c", 0), ("d", 1)], [("z", 0)]], lambda rows: G.clustered_rows(rows, ["page"], 6.0))
BOX = "x0 double, y0 double, x1 double, y1 double, confidence double, text string"
NEAR = [(0.0, 0.0, 10.0, 10.0, 0.9, "a"), (0.0, 0.0, 10.0, 9.0, 0.8, "b"), (5.0, 0.0, 15.0, 10.0, 0.7, "c"), (5.0, 0.0, 15.0, 9.5, 0.95, "d")]
for _name in ("e_14_cases", "u_10_cases"):
    pages(_name, BOX, [NEAR, NEAR[:1]], "text string", [[("a",), ("d",)], [("a",)]], lambda rows: G.without_overlaps(rows, "page"))
pages(
    "e_07_cases", "line long, cell int, text string",
    [
        [(0, 0, "Title"), (1, 0, "Nutritional Information"), (2, 0, "Energy"), (2, 1, "10 kcal"), (3, 0, "Protein (g)"), (3, 1, "2 g"), (3, 2, "4%"), (4, 0, "Sodium 7 mg"), (5, 0, "Energy"), (5, 1, "99"), (6, 0, "Storage"), (7, 0, "Iron"), (7, 1, "1 mg")],
        [(0, 0, "Nutrition Facts"), (1, 0, "A"), (1, 1, "1 g"), (1, 2, "5%"), (1, 3, "B"), (1, 4, "<2 g"), (1, 5, "6%"), (2, 0, "in adults"), (2, 1, "(18 years)")],
        [(0, 0, "Energy"), (0, 1, "10 kcal")],
        [(0, 0, "Nutritional Value"), (1, 0, "Vitamin B12 2 mcg"), (2, 0, "Vitamin D3 400 IU"), (3, 0, "Omega 3"), (3, 1, "12 mg")],
    ],
    "nutrient string, amount string", [[("Energy", "10 kcal"), ("Protein (g)", "2 g"), ("Sodium", "7 mg")], [("A", "1 g"), ("B", "<2 g")], [], [("Vitamin B12", "2 mcg"), ("Vitamin D3", "400 IU"), ("Omega 3", "12 mg")]],
    lambda rows: G.nutrition_tables(rows, "page").select("page", F.explode("nutrition").alias("nutrient", "amount")),
)
pages(
    "e_12_cases", "id long, x0 double, y0 double, x1 double, y1 double, confidence double, coverage double, text string",
    [[(1, 0.0, 5.0, 9.0, 50.0, 0.9, 0.1, "SUN"), (2, 0.0, 80.0, 9.0, 125.0, 0.9, 0.0, "SUN"), (3, 0.0, 0.0, 9.0, 30.0, 0.9, 0.0, "LOW"), (4, 0.0, 0.0, 9.0, 50.0, 0.5, 0.0, "DIM"), (5, 0.0, 0.0, 9.0, 50.0, 0.9, 0.4, "HID")], [(6, 0.0, 0.0, 9.0, 40.0, 0.6, 0.3, "EDGE")]],
    "id long, text string", [[(1, "SUN")], [(6, "EDGE")]], lambda rows: D.outlined_lines(rows.drop("coverage"), rows.select("page", "id", "coverage"), ["page"]),
)
pages(
    "e_16_cases", BOX,
    [[(0.0, 0.0, 9.0, 10.0, 90.0, "gummies"), (0.0, 0.0, 9.0, 40.0, 90.0, "Gummies"), (0.0, 0.0, 9.0, 10.0, 90.0, "x"), (0.0, 0.0, 9.0, 60.0, 59.0, "capsules"), (0.0, 0.0, 9.0, 10.0, 90.0, "y")], NEAR],
    "text string", [[("Gummies",)], []], lambda rows: G.prominent_word(rows, ["page"], "gummies|capsules"),
)
pages(
    "e_18_cases", BOX,
    [[(0.0, 0.0, 9.0, 10.0, 1.0, "BRAND"), (0.0, 20.0, 9.0, 32.0, 0.0, "Title"), (0.0, 15.0, 9.0, 18.0, 0.0, "fine print"), (150.0, 12.0, 159.0, 24.0, 0.0, "aside"), (0.0, 200.0, 9.0, 212.0, 0.0, "far")], [(0.0, 0.0, 9.0, 10.0, 1.0, "BRAND"), (0.0, 161.0, 9.0, 171.0, 0.0, "far")]],
    "text string", [[("Title",)], []], lambda rows: D.title_rows(rows.where("confidence = 1"), rows.where("confidence = 0"), "page"),
)
pages(
    "e_23_cases", "x0 double, y0 double, x1 double, y1 double, text string",
    [
        [(0.0, 0.0, 50.0, 12.0, "Malt, salt"), (5.0, 14.0, 55.0, 26.0, "sugar, water"), (0.0, 28.0, 40.0, 40.0, "pectin"), (0.0, 100.0, 40.0, 112.0, "apart, but, listed"), (60.0, 0.0, 90.0, 12.0, "other"), (60.0, 14.0, 90.0, 26.0, "column"), (60.0, 28.0, 90.0, 40.0, "without"), (60.0, 42.0, 90.0, 54.0, "lists")],
        [(0.0, 0.0, 50.0, 12.0, "a, b"), (0.0, 14.0, 50.0, 60.0, "LARGE"), (0.0, 62.0, 50.0, 74.0, "c, d"), (0.0, 76.0, 50.0, 88.0, "e"), (0.0, 90.0, 50.0, 102.0, "f, g")],
        [(0.0, 0.0, 50.0, 12.0, "a, b, c"), (0.0, 14.0, 50.0, 26.0, "d")],
    ],
    "n long, text string, x0 double, y1 double", [[(3, "Malt, salt sugar, water pectin", 0.0, 40.0)], [(3, "c, d e f, g", 0.0, 102.0)], []], lambda rows: D.ingredients_panel(rows, ["page"]),
)
CANDIDATE = "position long, text string, confidence double, occurrences int, top double, height double"
pages(
    "e_25_cases", CANDIDATE,
    [
        [(1, "Sunny", 0.9, 1, 0.0, 20.0), (2, "Days", 0.9, 1, 25.0, 18.0), (3, "SUNNY", 0.9, 1, 300.0, 20.0), (4, "Net wt 30 g", 0.9, 1, 46.0, 18.0), (5, "abc", 0.9, 1, 500.0, 20.0), (6, "dim words", 0.5, 1, 600.0, 20.0)],
        [(1, "abc", 0.9, 3, 0.0, 20.0), (2, "Chews", 0.7, None, 21.0, 60.0), (3, "Mango flavour", 0.9, 1, 82.0, 60.0), (4, "Far Away", 0.9, 1, None, 20.0)],
    ],
    "options string", [[("Sunny|Days|Sunny Days",)], [("abc|Chews|Far Away",)]], lambda rows: D.role_options(rows, "page").select("page", F.array_join("options", "|").alias("options")),
)
INKED = [20 if 2 <= i // 64 < 6 and 2 <= i % 64 < 12 else 15 if 20 <= i // 64 < 30 and 30 <= i % 64 < 40 else 99 if i == 63 else 0 for i in range(2048)]
for _name, _covered, _regions in (("t_09_cases", None, [(1, 1500), (2, 800)]), ("e_27_cases", [20 <= i // 64 < 25 for i in range(2048)], [(1, 800), (2, 750)])):
    pages(
        _name, "cells array<int>, covered array<boolean>", [[(INKED, _covered)], [([0] * 2048, None)]], "rank int, mass long", [_regions, []],
        lambda rows: G.ink_regions(rows, "page", "cells", covered="covered"),
    )
pages("s_09_matrix", "a double, b double, x double, y double, width double, text string", [[(3.0, 4.0, 1.0, 2.0, 9.0, "slanted")], [(0.0, 8.0, 1.0, 2.0, 9.0, "up"), (10.0, 0.0, 1.0, 2.0, 9.0, "flat")]], "text string, font_size double, degrees double", [[("slanted", 5.0, 53.1301)], [("up", 8.0, 90.0), ("flat", 10.0, 0.0)]], lambda rows: G.from_matrix(rows).select("page", "text", "font_size", F.round(F.degrees("rotation"), 4).alias("degrees")))
values("e_29_cases", "boolean", [("100x50|0.1", True), ("100x50|0.5", False), ("600x100|0.1", False), ("10x10|0.1", False), ("400x400|0.1", False), ("90x500|0.0", False), ("100x0|0.1", False)], by_column(lambda t: D.logo_box_ok(F.regexp_extract(t, r"^(\d+)x", 1).cast("double"), F.regexp_extract(t, r"x(\d+)", 1).cast("double"), F.lit(500000.0), F.regexp_extract(t, r"\|(.*)$", 1).cast("double"))))
values(
    "e_26_cases", "string",
    [("Sunny Days|the sunny days|Other", "Sunny Days:0.9"), ("Sunny Days|nothing|Other", "Other:0.5"), ("Rainy Days|rainy days|Other", "Other:0.5"), ("Rainy Days|rainy days|", None), ("|sunny|Other", "Other:0.5")],
    lambda rows: rows.select("id", *[F.split("t", r"\|")[i].alias(c) for i, c in enumerate(("answer", "heard", "again"))])
    .select("id", D.resolved_role(F.col("answer"), F.lit(0.9), F.col("heard"), F.filter(F.array("again"), lambda x: x != ""), F.array(F.lit("Sunny"), F.lit("Days of"))).alias("r"))
    .select("id", F.when(F.col("r").isNotNull(), F.concat_ws(":", "r.value", "r.confidence")).alias("x")),
)
values("x_42_cases", "list", [("brandName", ["brand_name"]), ("productName,fssai", ["fssai", "product_name"]), ("other,brandName", ["brand_name", "other"])], lambda rows: rows.select("id", F.array_sort(F.map_keys(X.renamed_keys(F.map_from_entries(F.transform(F.split("t", ","), lambda k: F.struct(k, F.lit("v")))), {"brandName": "brand_name", "productName": "product_name"}))).alias("x")))
values("k_01_cases", "string", [("text:x", "x/text/false"), ("vlm:x", "x/vlm/true"), ("llm: y ", "y/llm/true"), ("ocr:", None), ("vlm:  ", None)], lambda rows: rows.select("id", F.coalesce(*[F.when(F.startswith("t", F.lit(f"{s}:")), K.tagged(F.substring_index("t", ":", -1), s)) for s in ("text", "vlm", "llm", "ocr")]).alias("r")).select("id", F.when(F.col("r").isNotNull(), F.concat_ws("/", "r.value", "r.source", F.col("r.needs_review").cast("string"))).alias("x")))
values("k_07_cases", "list", [('{"a": "1", "b": " "}', ["a"]), ('{"b": "2"}', ["b"]), ('{"a": null, "c": "3"}', []), ("{}", [])], lambda rows: rows.select("id", F.array_sort(F.map_keys(K.kept_meta(F.create_map(F.lit("a"), F.lit("ocr"), F.lit("b"), F.lit("vlm")), F.from_json("t", "map<string,string>")))).alias("x")))
values("k_08_cases", "string", [('{"a": "1", "b": "2"}', "/"), ('{"a": " "}', "b/a"), ("{}", "a,b/"), ('{"a": "1", "b": null, "z": ""}', "/b")], lambda rows: rows.select("id", K.retry_targets(F.array(F.lit("a"), F.lit("b")), F.from_json("t", "map<string,string>")).alias("r")).select("id", F.concat(F.array_join("r.omitted", ","), F.lit("/"), F.array_join("r.hollow", ",")).alias("x")))
