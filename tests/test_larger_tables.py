"""Queries and operators on what only larger tables bring: high keys, ties, many groups."""

from collections import Counter

from pyspark.sql import functions as F

from pyspark.sql import functions as F

from labelloom.operators import extract as X
from labelloom.operators import geometry as G
from labelloom.operators import label_text as L
from labelloom.operators import scans
from labelloom.operators import scoring as S
from labelloom.plans import registry
from tests.test_scans import fold


def test_listed_numbers_stay_unknown_beyond_a_million(spark, tmp_path):
    """s_06b: keys above a million, and numbers that are listed twice."""
    spark.range(1_000_000, 1_000_300).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    customers = spark.range(0, 200).unionByName(spark.range(1_000_000, 1_000_100))
    customers.withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = Counter(r[0] for r in registry.QUERIES["s_06b"](spark, str(tmp_path)).collect())
    assert got == {1_000_000: 2, 1_000_050: 2, 1_000_100: 1, 1_000_150: 1}


def test_strips_of_equal_intervals(spark):
    """e_13: intervals that tie at a page's first start are one strip with what follows."""
    rows = [(1, 0.0, 30.0)] * 5 + [(1, 20.0, 50.0), (1, 54.0, 60.0), (1, 64.5, 70.0)]
    got = G.strips(spark.createDataFrame(rows, "page int, s double, e double"), ["page"], "s", "e", 4.0).collect()
    assert sorted(map(tuple, got)) == [(1, 0.0, 60.0), (1, 64.5, 70.0)]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_nutrition_of_many_pages(spark):
    """e_07: pages go through Python in batches, not as a frame of each page."""
    rows = [(page, line, cell, text) for page in range(300) for line, cells in enumerate([["Nutrition Facts"], ["Zinc", f"{page} mg"], ["Iron 2 mg"], ["Zinc", "0 mg"]][: page % 5]) for cell, text in enumerate(cells)]
    got = G.nutrition_tables(spark.createDataFrame(rows, "page long, line long, cell int, text string"), "page")
    want = {page: dict([("Zinc", f"{page} mg"), ("Iron", "2 mg")][: page % 5 - 1]) for page in range(300) if page % 5}
    assert {r["page"]: r["nutrition"] for r in got.collect()} == want
    assert "MapInArrow" in plan(got) and "FlatMapGroups" not in plan(got)


def test_grid_is_filled_in_order(spark):
    """t_09, e_27: a grid from its entries, without looking every place up among them."""
    rows = [(1, [(0, 5), (3, 7)]), (2, []), (3, [(7, 9)]), (4, [(i, i + 1) for i in range(8)])]
    got = spark.createDataFrame(rows, "id int, at array<struct<p:int,v:int>>").select("id", G.filled_grid(F.col("at"), 8).alias("x")).collect()
    assert {r["id"]: r["x"] for r in got} == {1: [5, 0, 0, 7, 0, 0, 0, 0], 2: [0] * 8, 3: [0] * 7 + [9], 4: list(range(1, 9))}


def test_values_are_scored_once(spark):
    """q_09, q_10: the plan names each side once, so no key brings its maps to be parsed again."""
    df = spark.createDataFrame([('{"A":"1 mg","B":"2","C":"3"}', '{"a ":"1mg","B":"4","D":"5"}')], "a string, b string")
    parse = lambda c: F.from_json(c, "map<string,string>")
    by_key = df.select(S.map_score(parse("a"), parse("b")).alias("t"))
    by_item = df.select(S.list_score(F.split("a", ","), F.split("b", ",")).alias("t"))
    assert tuple(by_key.first()["t"]) == (1, 2, 1)
    assert plan(by_key).split("== Physical Plan ==")[1].count("from_json") <= 2
    assert plan(by_item).split("== Physical Plan ==")[1].count("split(") <= 2


def test_cases_are_spread(spark, sf):
    """x_17_cases: a part file of one row group is dealt out before the work on its rows."""
    assert registry.QUERIES["x_17_cases"](spark, sf).rdd.getNumPartitions() == 4


def test_counts_of_a_pack_are_looked_for_once(spark):
    """x_17, x_09: a text's counts are evaluated once, not once for each use."""
    df = spark.createDataFrame([("Serving size: 2 gummies\nMango\n30\nGummies",), ("Net Qty: 60 N",)], "t string").select(L.package_size(F.col("t")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["30 Gummies", "60 N"]
    assert plan(df).split("== Physical Plan ==")[1].count("regexp_extract_all") <= 4


def test_free_from_claims_flatten_a_text_once(spark):
    """x_22"""
    df = spark.createDataFrame([("FREE FROM  MILK | SOY\nNut free, no sugar",)], "t string").select(X.free_from_claims(F.col("t")).alias("x"))
    assert df.first()["x"] == ["Free From Milk | Soy", "Nut Free", "No Sugar"]
    assert plan(df).split("== Physical Plan ==")[1].count(r"regexp_replace(t#") <= 1


def test_fold_of_a_block_copies_no_marks(spark):
    """w_08, e_02, e_04, e_06, t_07: what the fold of a block carries along is a digit for each mark."""
    marks = [(1, -100.0 + i, -8.0 - i % 3) for i in range(40)] + [(2, 0.0, -8.0)]
    got = scans._near_lines(spark.createDataFrame(marks, "k int, __u double, __w double"), ["k"], ["__u", "__w"])
    line = fold([(-u, -w) for k, u, w in marks if k == 1])
    opened = [-u for (u, w), n in line.items() if not any(m == n and v > u for (v, _), m in line.items())]
    assert sorted(r["__u"] for r in got.collect() if r["k"] == 1 and r["__new"]) == sorted(opened)
    assert "array(struct(__u" not in plan(got)


def test_ranges_hand_over_by_broadcast(spark):
    """s_09, e_23, w_08: rows are not shuffled again to meet what the ranges in front of theirs hand over."""
    df = spark.createDataFrame([(i // 50, i % 50) for i in range(200)], "k int, v int")
    got = scans.running(scans.dealt(df, ["k"], ["v"]), ["k"], ["v"], "v", F.sum, "before")
    assert {(r["k"], r["v"]): r["before"] for r in got.collect()} == {(k, v): v * (v - 1) // 2 for k in range(4) for v in range(50)}
    assert "SortMergeJoin" not in plan(got) and "BroadcastHashJoin" in plan(got)


def test_display_lines_of_small_and_large_pages(spark, sf, monkeypatch):
    """e_06, t_07: the same display lines, whether pages are folded within a row, scanned by ranges, or some each way."""
    want = sorted(map(tuple, registry.QUERIES["e_06"](spark, sf).collect()))
    sizes = sorted(r["count"] for r in registry.QUERIES["e_01"](spark, sf).groupBy("page").count().collect())
    assert want and sizes[0] < sizes[-1]
    monkeypatch.setattr(scans, "PAGE_ROWS", sizes[len(sizes) // 2])
    assert sorted(map(tuple, registry.QUERIES["e_06"](spark, sf).collect())) == want


def test_texts_of_lines_of_small_and_large_pages(spark, monkeypatch):
    """e_02: one row for each line in one shuffle; texts that are null, places that are null, and a null page, by either way."""
    rows = [(1, 5.0, 9.0, 8.0, "b"), (1, 5.0, 9.0, 8.0, "a"), (1, 0.0, 8.0, 10.0, None), (1, 0.0, 1.0, 8.0, "z"), (1, 0.0, None, 8.0, "x"), (None, 2.0, 3.0, 4.0, "n"), (2, 1.0, 1.0, None, "y")]
    spans = spark.createDataFrame(rows, "page int, along double, cross double, font_size double, text string")
    want = {(1, 0, "a b", 9.0, 10.0, 3), (1, 1, "z", 1.0, 8.0, 1), (None, 0, "n", 3.0, 4.0, 1)}
    near = G.lines(spans, ["page"])
    assert near._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    monkeypatch.setattr(scans, "PAGE_ROWS", 2)
    far = G.lines(spans, ["page"])
    assert near.dtypes == far.dtypes == [("page", "int"), ("line", "bigint"), ("text", "string"), ("cross", "double"), ("font_size", "double"), ("n", "bigint")]
    assert set(map(tuple, near.collect())) == set(map(tuple, far.collect())) == want


def test_overlaps_of_pages_either_way(spark, sf, monkeypatch):
    """u_10: the same lines stay, whether a page's boxes meet in a group or in cells."""
    want = sorted(map(tuple, registry.QUERIES["u_10"](spark, sf).collect()))
    monkeypatch.setattr(G, "PAGE_BOXES", 100)
    got = registry.QUERIES["u_10"](spark, sf)
    assert want and sorted(map(tuple, got.collect())) == want


def test_rows_of_small_pages_are_not_gathered_in_lists(spark, sf):
    """e_02, e_06, e_04: pages are folded in batches; what is shuffled holds each number once."""
    rows = spark.createDataFrame([(1, 5.0, 9.0, 8.0, "b")], "page int, along double, cross double, font_size double, text string")
    got = plan(G.lines(rows, ["page"])).split("== Physical Plan ==")[1]
    assert got.count("Exchange") == 1 and "collect_list" not in got
    assert "__u" not in got[got.index("Exchange") :]


def test_texts_of_lines_with_odd_numbers(spark, monkeypatch):
    """e_02: places that are NaN, null or -0.0, sizes that are NaN or negative, and keys that are NaN, the same by either way."""
    odd = [float("nan"), float("inf"), 0.0, -0.0, 3.0, 2.5, 1.0, -4.0]
    rows = [(k, a, c, s, t) for k in (1.0, float("nan"), None) for i, c in enumerate(odd) for s in (odd[i - 1], 2.0) for a, t in ((None, "n"), (float("nan"), "é"), (-0.0, "y"), (0.0, "x"), (1.0, None))]
    spans = spark.createDataFrame(rows, "page double, along double, cross double, font_size double, text string")
    got = []
    for rows_of_a_page, piece in ((8192, 1 << 16), (8192, 3), (0, 3)):
        monkeypatch.setattr(scans, "PAGE_ROWS", rows_of_a_page)
        monkeypatch.setattr(scans, "PIECE", piece)
        got.append(sorted(map(str, G.lines(spans, ["page"]).selectExpr("page", "line", "text", "cross + 0.0D AS c", "font_size + 0.0D AS s", "n").collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) > 3
