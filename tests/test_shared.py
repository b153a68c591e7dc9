"""Ranks and tables that other operators stand on."""

from pyspark.sql import functions as F

from labelloom.operators import joins as J
from labelloom.operators import tables as O
from labelloom.operators.shared import cut, ranked


def test_ranks_of_a_hot_key(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k")).repartition(7)
    got = {(r["k"], r["id"]): r["rank"] for r in ranked(rows, ["k"], ["id"]).collect()}
    by_key = {}
    for k, i in sorted(got):
        by_key.setdefault(k, []).append(got[k, i])
    assert len(got) == 5000 and all(v == list(range(1, len(v) + 1)) for v in by_key.values())


def test_ranks_without_keys_and_empty(spark):
    assert [r["rank"] for r in ranked(spark.range(100).repartition(5), [], ["id"]).orderBy("id").collect()] == list(range(1, 101))
    assert ranked(spark.range(0), [], ["id"]).count() == 0


def test_cut_keeps_schema_and_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ["a"])], "id long, x array<string>")
    again = cut(rows, "t")
    assert again.schema == rows.schema and sorted(again.collect()) == sorted(rows.collect())


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, at int")
    got = O.upserted(old, new, ["id"], F.desc("at")).select("id", "v", "w").collect()
    assert sorted(map(tuple, got)) == [(1, "a", "x"), (2, "d", None), (3, "e", None)]


def test_box_overlaps_over_many_cells(spark):
    schema = "page int, id int, x0 double, y0 double, x1 double, y1 double"
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0), (2, 1, 0.0, 0.0, 1.0, 1.0)], schema)
    b = spark.createDataFrame([(1, 7, 50.0, 50.0, 150.0, 150.0), (1, 8, 100.0, 0.0, 120.0, 10.0), (2, 9, 5.0, 5.0, 6.0, 6.0)], schema)
    got = [(r["page"], r["a_id"], r["b_id"], r["area"], round(r["iou"], 4)) for r in J.box_overlaps(a, b, "page", 16.0).collect()]
    assert got == [(1, 1, 7, 2500.0, round(2500 / 17500, 4))]
