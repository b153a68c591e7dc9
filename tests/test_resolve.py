"""Snapping against every pair scored."""

import random

from pyspark.sql import functions as F

from labelloom.operators import resolve as C


def test_snapping_to_a_long_list(spark):
    """More than 10,000 masters, by all three rules; the best of every pair decides."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abeiklnorst") for _ in range(rng.choice([1, 2, 3, 5, 8])))
    masters = [(" ".join(word() for _ in range(rng.randint(1, 4))).title(), i) for i in range(10_200)] + [(None, 10_200), (" - ", 10_201), ("A" * 40, 10_202)]

    def edited(text):
        out = list(text)
        for _ in range(rng.randint(1, 1 + len(out) // 4)):
            at = rng.randrange(len(out))
            out[at : at + 1] = rng.choice([[], [rng.choice("xyz")], [out[at], rng.choice("xyz")]])
        return "".join(out)

    some = [m for m, _ in rng.sample(masters[:10_200], 60)]
    values = [edited(m) for m in some] + [m.upper() for m in some[:5]] + [f"the {m} pack" for m in some[:10]] + [m.split(" ")[0] for m in some[:10]] + [m.replace(" ", "-") for m in some[:5]] + ["", " ", None, "zq", "é" + "a" * 38]
    v, m = spark.createDataFrame([(x,) for x in values], "v string"), spark.createDataFrame(masters, "m string, o int")
    pairs = v.distinct().crossJoin(m).withColumn("score", C.snap_score(F.col("v"), F.col("m"))).where("score IS NOT NULL")
    want = {(r["v"], r["m"], r["score"]) for r in pairs.groupBy("v").agg(F.min(F.struct(-F.col("score"), "o", "m", "score")).alias("b")).select("v", "b.m", "b.score").collect()}
    got = C.snapped(v, "v", m, "m", "o").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    scores = {r["score"] for r in got}
    assert {1.0, 0.9} <= scores and len(scores) > 6


def test_snapping_of_long_values(spark):
    """Values of 1,000 characters: keys in proportion to the length, the same pairs as brute force."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(n))

    def edited(x, share):
        out = list(x)
        for _ in range(int(len(out) * share)):
            at = rng.randrange(len(out))
            out[at : at + 1] = rng.choice([[], [rng.choice("uvwxyz")], [out[at], rng.choice("uvwxyz")]])
        return "".join(out)

    masters = [(text(n), i) for i, n in enumerate([1000] * 12 + [950, 700, 100, 40, 40, 12, 9, 5, 4])]
    values = [edited(m, share) for m, _ in masters for share in (0.05, 0.25, 0.29, 0.33, 0.4)]
    v, m = spark.createDataFrame([(x,) for x in values], "v string"), spark.createDataFrame(masters, "m string, o int")
    pairs = v.distinct().crossJoin(m).withColumn("score", C.snap_score(F.col("v"), F.col("m"))).where("score IS NOT NULL")
    want = {(r["v"], r["m"], r["score"]) for r in pairs.groupBy("v").agg(F.min(F.struct(-F.col("score"), "o", "m", "score")).alias("b")).select("v", "b.m", "b.score").collect()}
    assert {tuple(r) for r in C.snapped(v, "v", m, "m", "o").collect()} == want and len(want) > 40
