"""Counters, rollups and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def counters(df: DataFrame, conditions: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])


def weighted_score(result: str = "status", weight: str = "weight", similarity: str = "similarity") -> Column:
    """Weighted share in percent over compared fields, rounded; 0 when none was compared."""
    considered = F.col(result) != "NOT_COMPARED"
    total = F.sum(F.when(considered, F.col(weight)))
    return F.coalesce(F.round(F.sum(F.when(considered, F.col(weight) * F.col(similarity))) / total * 100), F.lit(0.0)).cast("int")


def mean_of_points(result: str = "result") -> Column:
    """MATCH 100, SIMILAR 65, CONFLICT 0; MISSING left out."""
    points = F.when(F.col(result) == "MATCH", 100).when(F.col(result) == "SIMILAR", 65).when(F.col(result) == "CONFLICT", 0)
    return F.coalesce(F.round(F.avg(points)), F.lit(0.0)).cast("int")


def verdict(result: str = "result") -> Column:
    any_of = lambda *names: F.coalesce(F.bool_or(F.col(result).isin(*names)), F.lit(False))
    return F.when(any_of("CONFLICT"), "CONFLICT").when(any_of("SIMILAR", "MISSING") | (F.count("*") == 0), "REVIEW REQUIRED").otherwise("MATCH")


def accuracy_rollup(rows: DataFrame, level: str) -> DataFrame:
    """correct, wrong, missing and accuracy for each level and for all (null level)."""
    sums = rows.rollup(level).agg(*[F.sum(c).alias(c) for c in ("correct", "wrong", "missing")])
    total = F.col("correct") + F.col("wrong") + F.col("missing")
    return sums.withColumn("accuracy", F.coalesce(F.col("correct") / F.nullif(total, F.lit(0)), F.lit(0.0)))


def fabrication(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Invented values over chances to invent one (truth absent); fields without a chance are left out."""
    chance = F.col("expected").isNull()
    out = rows.groupBy(*keys).agg(F.count_if(chance & F.col("predicted").isNotNull()).alias("fabricated"), F.count_if(chance).alias("opportunities"))
    return out.where("opportunities > 0").withColumn("rate", F.col("fabricated") / F.col("opportunities"))


def colour_histogram(pixels: DataFrame, image: str, levels: int = 6) -> DataFrame:
    """Share of each of levels**3 colour bins among the pixels (r, g, b) of an image."""
    level = lambda c: F.least(F.floor(F.col(c) * levels / 256), F.lit(levels - 1))
    binned = pixels.select(image, (level("r") * levels * levels + level("g") * levels + level("b")).cast("int").alias("bin"))
    counted = binned.groupBy(image, "bin").agg(F.count("*").alias("n"))
    total = counted.groupBy(image).agg(F.sum("n").alias("total"))
    return counted.join(total, image).select(image, "bin", (F.col("n") / F.col("total")).alias("share"))


# Colour words, and where each hue band ends, in degrees.
HUES = [(15, "Red"), (45, "Orange"), (70, "Yellow"), (165, "Green"), (195, "Teal"), (255, "Blue"), (290, "Purple"), (345, "Pink"), (360, "Red")]
NEUTRAL = ["White", "Black", "Grey", "Cream"]


def hue_name(r: Column, g: Column, b: Column) -> Column:
    """Colour word of an RGB triple: light, dark and grey first, then pale warm and dark warm hues, then the hue bands."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = high - low  # whole numbers up to one division, so that a hue on a band's edge is exact
    light = (high + low) / 510.0
    sat = F.when(spread == 0, 0.0).otherwise(spread / (255.0 - F.abs(high + low - 255)))
    sixth = lambda a, b: F.lit(60.0) * (a - b) / spread
    turn = F.when(spread == 0, 0.0).when(high == r, sixth(g, b)).when(high == g, sixth(b, r) + 120).otherwise(sixth(r, g) + 240)
    hue = F.when(turn < 0, turn + 360).otherwise(turn)
    word = F.when((light >= 0.9) & (sat < 0.2), "White").when(light <= 0.12, "Black").when(sat < 0.12, "Grey")
    word = word.when((light >= 0.8) & (sat < 0.35) & (hue >= 20) & (hue < 70), "Cream").when((light < 0.42) & (hue >= 10) & (hue < 50), "Brown")
    for limit, name in HUES:
        word = word.when(hue < limit, name)
    return word


def palette(pixels: DataFrame, image: str) -> DataFrame:
    """Named colours of an image: pixels, mean colour and coverage."""
    named = pixels.withColumn("name", hue_name(F.col("r"), F.col("g"), F.col("b")))
    each = named.groupBy(image, "name").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "rgb"])
    total = each.groupBy(image).agg(F.sum("n").alias("total"))
    mean = [F.round(F.col(c) / F.col("n")).cast("int").alias(c) for c in "rgb"]
    return each.join(total, image).select(image, "name", "n", *mean, (F.col("n") / F.col("total")).alias("coverage"))


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sorted distinct trimmed values of each column, one row a value: (column, value)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.nullif(F.trim(F.col(c)), F.lit("")).alias("value")) for c in columns]))
    return df.select(each.alias("x")).select("x.*").where(F.col("value").isNotNull()).distinct()


def first_values(pages: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """First non-blank value of each column in page order."""
    blankless = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return pages.groupBy(key).agg(*[F.min_by(blankless(c), F.when(blankless(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def ordered_union(pages: DataFrame, key: str, order: str, items: str) -> DataFrame:
    """Items of all pages, each once, where it was first seen."""
    each = pages.select(key, order, F.posexplode(items).alias("pos", "item"))
    first = each.groupBy(key, "item").agg(F.min(F.struct(order, "pos")).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias(items))


def map_conflicts(entries: DataFrame, keys: list[str], name: str, value: str, order: str) -> DataFrame:
    """First value of each name and the values that differ from it."""
    each = entries.groupBy(*keys, name).agg(F.min_by(value, order).alias("kept"), F.array_sort(F.collect_set(value)).alias("all"))
    return each.select(*keys, name, "kept", F.array_except("all", F.array("kept")).alias("conflicts"))


