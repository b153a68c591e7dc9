"""The comparison engines on the cases that define them."""

import pytest
from pyspark.sql import functions as F

from labelloom.operators import compare as B
from labelloom.operators import resolve as C
from labelloom.operators import scoring as S


def one(spark, expression, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("Boost Immunity", "Boosts Immunity", "SIMILAR"), ("Supports Immunity", "Boosts Immunity", "SIMILAR"), ("Apple Cider Vinegar Gummies", "Herbal Honey Gummies", "CONFLICT"),
        ("", None, "NOT_COMPARED"), ("x", " ", "MISSING"), ("Hill Ltd.", "HILL  ltd", "MATCH"), ("Sugar Free", "Gluten Free", "CONFLICT"), ("2 g", "5 g", "CONFLICT"), ("7.7 mg", "7.7mg", "SIMILAR"), (" ", "", "NOT_COMPARED"),
    ],
)
def test_five_states(spark, a, b, want):
    assert one(spark, B.five_state(F.col("a"), F.col("b")), a=a, b=b) == want


@pytest.mark.parametrize("a, b, want", [("", "", "MISSING"), ("A", " a", "MATCH"), ("red apple gummies", "green apple gummies", "CONFLICT"), ("a b c d", "a b c", "SIMILAR"), ("ab", "cd", "CONFLICT")])
def test_parameter_states(spark, a, b, want):
    assert one(spark, B.parameter_state(F.col("a"), F.col("b")), a=a, b=b) == want


def test_nutrition(spark):
    rows = [(1, '{"Protein":"2 g"}', '{"Protein":"5 g"}'), (2, '{"Sodium":"7.7 mg"}', '{"Sodium":"7.7mg"}'), (3, '{"Vitamin C":"1"}', '{"vitamin  c":"1"}'), (4, "not json", "{broken"), (5, '{"A":"1"}', None)]
    got = B.nutrition_comparison(spark.createDataFrame(rows, "id int, a string, b string"), "a", "b", "id").collect()
    assert sorted((r["id"], r["nutrient"], r["status"]) for r in got) == [(1, "Protein", "CONFLICT"), (2, "Sodium", "SIMILAR"), (3, "Vitamin C", "MATCH"), (5, "A", "MISSING")]


def test_weighted_score_keeps_missing_in_the_denominator(spark):
    rows = spark.createDataFrame([(1, 2, "product_name", "a", "a"), (1, 2, "flavour", "x", None), (1, 2, "claims", None, None), (1, 2, "address", "q", "z")], "a_id int, b_id int, field string, a string, b string")
    all_fields = B.weighted_comparison(B.weighted_fields(rows)).first()
    own = B.weighted_comparison(B.weighted_fields(rows, same_company=True)).first()
    assert (all_fields["score"], all_fields["missing"], all_fields["not_compared"]) == (43, 1, 1) and own["score"] == 60


@pytest.mark.parametrize("distance, want", [(0, "MATCH"), (4, "MATCH"), (5, "SIMILAR"), (12, "SIMILAR"), (13, "CONFLICT"), (64, "CONFLICT")])
def test_hash_states(spark, distance, want):
    a, b = 0, (1 << distance) - 1 if distance < 64 else -1
    d = B.hash_distance(F.lit(a).cast("long"), F.lit(b if b < 2**63 else b - 2**64).cast("long"))
    assert spark.range(1).select(B.hash_state(d)).first()[0] == want


def test_fingerprint_rows(spark):
    side = lambda h, logo: F.struct(F.lit(h).cast("long").alias("hash"), F.array(F.lit(0.5), F.lit(0.5)).alias("histogram"), F.lit(logo is not None).alias("logo_ran"), F.lit(None).cast("long").alias("logo_hash"))
    got = lambda x, y: [tuple(r) for r in spark.range(1).select(B.fingerprint_rows(side(1, x), side(1, y))).first()[0]]
    assert got(None, None) == [("layout", "MATCH"), ("colour", "MATCH")]
    assert got(1, None)[-1] == ("logo", "MISSING")


@pytest.mark.parametrize(
    "value, masters, want",
    [("brightol", ["Brightol"], ("Brightol", 1.0)), ("The Brightol Gummies", ["Brightol"], ("Brightol", 0.9)), ("Chew", ["ChewSpring"], None), ("SunnycalKid", ["Sunnycal-Kid"], ("Sunnycal-Kid", None)), ("BRIGHTOU", ["BRIGHTOL"], ("BRIGHTOL", None)), (" ", ["a"], None), ("x", [], None)],
)
def test_snapping(spark, value, masters, want):
    listed = spark.createDataFrame([(m, i) for i, m in enumerate(masters)], "m string, o int")
    got = C.snapped(spark.createDataFrame([(value,)], "v string"), "v", listed, "m", "o").collect()
    if want is None:
        assert got == []
    else:
        assert got[0]["master"] == want[0] and (got[0]["score"] == want[1] if want[1] else got[0]["score"] >= 0.85)


def test_snapping_ties_go_to_the_first(spark):
    listed = spark.createDataFrame([("Alpha One", 0), ("Alpha Two", 1)], "m string, o int")
    assert C.snapped(spark.createDataFrame([("alpha",)], "v string"), "v", listed, "m", "o").first()["master"] == "Alpha One"


def test_families_follow_chains(spark):
    shared = spark.createDataFrame([(i, f"s{i}") for i in range(30)] + [(i + 1, f"s{i}") for i in range(29)] + [(100, "t")], "id long, signal string")
    records = spark.createDataFrame([(i,) for i in [*range(30), 100, 200]], "id long")
    got = {r["id"]: r["family"] for r in C.families(records, "id", shared).collect()}
    assert got == {**dict.fromkeys(range(30), 0), 100: 100, 200: 200}


def test_indel_ratio():
    assert S.indel_ratio("abc", "abc") == 1 and S.indel_ratio("", "") == 1 and S.indel_ratio("ab", "cd") == 0
    assert S.indel_ratio("abcd", "abxd") == pytest.approx(6 / 8)
    assert S.token_set_ratio("vitamin c extra", "c vitamin") == 1.0 and S.token_set_ratio("", "a") == 0.0


def test_common_length_against_a_table():
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for a, b in (("kitten", "sitting"), ("aaaa", "aa"), ("abcabc", "cbacba"), ("", "x"), ("vitamin b12 mcg", "b12 vitamins")):
        assert S.common_length(a, b) == table(a, b)


SCORER = [("a", "A ", (1, 0, 0)), ("a", "b", (0, 1, 0)), (None, "b", (0, 0, 1)), ("a", None, (0, 1, 0)), (None, "", (1, 0, 0))]


@pytest.mark.parametrize("got, want, counts", SCORER)
def test_tri_state(spark, got, want, counts):
    assert tuple(one(spark, S.tri_state(F.col("g"), F.col("w")), g=got, w=want)) == counts


def test_list_map_and_detail(spark):
    rows = spark.createDataFrame([(["a", "z"], ["a", "b"], {"P": "2g", "X": "1"}, {"p": "3 g", "Q": "1"}), ([], None, {}, None)], "g array<string>, w array<string>, gm map<string,string>, wm map<string,string>")
    got = rows.select(S.list_score(F.col("g"), F.col("w")).alias("l"), S.map_score(F.col("gm"), F.col("wm")).alias("m"), S.list_detail(F.col("g"), F.col("w")).alias("d")).collect()
    assert [tuple(r["l"]) for r in got] == [(1, 1, 1), (1, 0, 0)] and [tuple(r["m"]) for r in got] == [(0, 2, 1), (1, 0, 0)]
    assert [sum(x["result"] == k for x in got[0]["d"]) for k in ("correct", "wrong", "missing")] == [1, 1, 1]


def test_fuzzy(spark):
    assert one(spark, S.fuzzy_match(F.col("a"), F.col("b")), a="Brightol Gummies", b="brightol gummis")
    assert not one(spark, S.fuzzy_match(F.col("a"), F.col("b")), a="abc", b="abcdef")
    assert tuple(one(spark, S.fuzzy_tri_state(F.col("a"), F.col("b")), a="mango", b="mango flavour")) == (1, 0, 0)
    rows = spark.createDataFrame([(1, ["vitamin c", "c vitamin"], ["vitamin c"]), (2, [], [])], "id int, g array<string>, w array<string>")
    assert {tuple(r) for r in S.greedy_list_score(rows, "id", "g", "w").collect()} == {(1, 1, 1, 0), (2, 1, 0, 0)}
