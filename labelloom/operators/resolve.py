"""Entity resolution: snapping to masters, duplicates, and families over shared signals."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import folded
from labelloom.operators.shared import connected, cut, ranked

RATIO = 0.85
CLASS = 1.36  # lengths of one class, from the shortest to the longest


def master_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[\s-]+", " "))


def form_score(a: Column, b: Column) -> Column:
    padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    inside = (a != "") & (b != "") & (F.contains(padded(a), padded(b)) | F.contains(padded(b), padded(a)))
    size = F.length(a) + F.length(b)
    ratio = (size - F.levenshtein(a, b)) / size
    return F.when((a == "") | (b == ""), None).when(a == b, 1.0).when(inside, 0.9).when(ratio >= RATIO, ratio)


def snap_score(candidate: Column, master: Column) -> Column:
    """1 for equal, 0.9 for whole-word containment either way, else the edit ratio over both lengths, from 0.85 on."""
    return form_score(master_form(candidate), master_form(master))


def _counts(forms: DataFrame, number: Column) -> Column:
    """The distinct numbers (of words or characters) of all forms, as a literal array: as many as the longest at most."""
    return F.lit(sorted(r[0] for r in forms.select(number).distinct().collect())).cast("array<int>")


def _shorter_runs(form: str, counts: Column) -> Column:
    """All runs of neighbouring words of a form, without the whole, of the lengths in ``counts``."""
    words = F.split(form, " ")
    starts = lambda n: F.sequence(F.lit(1), F.size(words) - n + 1)
    runs = F.transform(F.filter(counts, lambda n: n < F.size(words)), lambda n: F.transform(starts(n), lambda i: F.array_join(F.slice(words, i, n), " ")))
    return F.array_distinct(F.flatten(runs))


def _sized(forms: DataFrame) -> DataFrame:
    """Forms (id, form) with their length and its class; at an edit ratio of 0.85 the longer of two forms has at most
    1.353 times the characters of the shorter, so its class is the same or the next."""
    n = F.length("form")
    return forms.select("id", "form", n.alias("n"), F.floor(F.log(n.cast("double")) / math.log(CLASS)).cast("int").alias("class"))


def _place(at: Column) -> Column:
    """Bucket of a place in a form: as wide as the edits that two forms of the class may differ by."""
    width = F.floor(0.354 * F.pow(F.lit(CLASS), F.col("class") + 1)) + 1
    return F.floor(at / width)


def _near_pairs(longer: DataFrame, shorter: DataFrame, same_length: bool) -> DataFrame:
    """(long, short): ids of pairs of forms (id, form) whose edit ratio may be 0.85 or more, by keys in proportion to the
    length of a form.

    At this ratio forms of n and x <= n characters are at most k = 0.15 (n + x) edits apart, and k is at most
    e = 0.3 n. The longer form is cut into e + 1 segments of two to four characters. An edit spoils one segment at most,
    so e + 1 - k of them stand whole in the shorter form, at most k places off: they meet its runs of two, three and
    four characters there, and the pairs that meet often enough are left.
    """
    segments = _sized(longer).withColumn("e", F.expr("(30 * n) div 100")).where("e > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "e")))
    cuts = segments.select("id", "n", "e", "i", "form", F.expr("cast((i * n) div (e + 1) as int)").alias("p"), F.expr("cast(((i + 1) * n) div (e + 1) as int)").alias("q"), F.explode(F.array(F.col("class"), F.col("class") - 1)).alias("class"))
    around = cuts.withColumn("b", F.explode(F.array(*[_place(F.col("p")) + d for d in (-1, 0, 1)])))
    mine = around.select(F.col("id").alias("long"), "n", "e", "i", F.xxhash64("class", "b", F.substring("form", F.col("p") + 1, F.col("q") - F.col("p"))).alias("k"))
    runs = _sized(shorter).withColumn("size", F.explode(F.array(*map(F.lit, (2, 3, 4))))).where("size <= n").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))))
    other = runs.select(F.col("id").alias("short"), F.col("n").alias("x"), F.xxhash64("class", _place(F.col("at")), F.substring("form", F.col("at") + 1, F.col("size"))).alias("k")).distinct()
    met = mine.join(other, "k").where(F.expr("100 * (n - x) <= 15 * (n + x)") & (F.col("x") <= F.col("n") if same_length else F.col("x") < F.col("n")))
    counted = met.groupBy("long", "short", "n", "x", "e").agg(F.count_distinct("i").alias("whole"))
    return counted.where(F.expr("whole >= e + 1 - (15 * (n + x)) div 100")).select("long", "short")


def snapped(values: DataFrame, value: str, masters: DataFrame, master: str, order: str) -> DataFrame:
    """(value, master, score): the best master for each distinct value that has one; ties go to list order.

    Values and masters meet by keys that are exact for the three rules, so lists of any length do: equal forms, forms
    equal to a run of words, and segments for the edit ratio (``_near_pairs``). Only the last gives pairs that are to be
    scored.
    """
    listed = masters.select(master_form(F.col(master)).alias("__b"), F.struct(F.col(order).alias("o"), F.col(master).alias("m")).alias("__m"))
    forms = cut(listed.where("__b <> ''").groupBy("__b").agg(F.min("__m").alias("__m")), "masters")
    distinct = cut(values.select(value).where(F.col(value).isNotNull()).distinct().withColumn("__a", master_form(F.col(value))), "values")
    asked = distinct.select("__a").where("__a <> ''").distinct()
    words = lambda c: F.size(F.split(c, " "))

    def found(pairs: DataFrame, score: Column) -> DataFrame:
        return pairs.select("__a", F.struct((-score).alias("s"), "__m.o", "__m.m").alias("__c"))

    same = F.col("__a") == F.col("__b")
    inside_value = asked.withColumn("__b", F.explode(_shorter_runs("__a", _counts(forms, words("__b"))))).join(forms, "__b")
    runs = forms.select(F.explode(_shorter_runs("__b", _counts(asked, words("__a")))).alias("__a"), "__m").groupBy("__a").agg(F.min("__m").alias("__m"))
    left = cut(asked.join(forms, same, "left_anti").select(F.monotonically_increasing_id().alias("id"), F.col("__a").alias("form")), "left")
    right = cut(forms.select(F.monotonically_increasing_id().alias("id"), F.col("__b").alias("form"), "__m"), "right")
    long, short = F.col("long"), F.col("short")
    pairs = _near_pairs(left, right, True).select(long.alias("v"), short.alias("w")).unionByName(_near_pairs(right, left, False).select(short.alias("v"), long.alias("w")))
    named = pairs.join(left.select(F.col("id").alias("v"), F.col("form").alias("__a")), "v").join(right.select(F.col("id").alias("w"), F.col("form").alias("__b"), "__m"), "w")
    near = named.withColumn("__s", form_score(F.col("__a"), F.col("__b"))).where("__s IS NOT NULL")
    every = [found(asked.join(forms, same), F.lit(1.0)), found(inside_value, F.lit(0.9)), found(asked.join(runs, "__a"), F.lit(0.9)), found(near, F.col("__s"))]
    best = reduce(DataFrame.unionByName, every).groupBy("__a").agg(F.min("__c").alias("__c"))
    return distinct.join(best, "__a").select(value, F.col("__c.m").alias("master"), (-F.col("__c.s")).alias("score"))


def duplicate_masters(masters: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """(id, other): active masters that share the folded name (and keys) with the smallest such id."""
    active = masters.where(F.col("status") == "Active").select("id", folded(name).alias("__n"), *[folded(k).alias(k) for k in keys or []])
    first = active.groupBy("__n", *(keys or [])).agg(F.min("id").alias("other"), F.count("*").alias("n")).where("n > 1")
    return active.join(first, ["__n", *(keys or [])]).where("id <> other").select("id", "other")


def get_or_created(names: DataFrame, masters: DataFrame, name: str) -> DataFrame:
    """Masters with the names that no master has, without regard to case; new ones have no id yet."""
    known = masters.select(folded(name).alias("__f")).distinct()
    wanted = names.where(folded(name) != "").select(F.trim(name).alias(name), folded(name).alias("__f"))
    new = wanted.join(known, "__f", "left_anti").groupBy("__f").agg(F.min(name).alias(name)).drop("__f")
    return masters.unionByName(new, allowMissingColumns=True)


def short_codes(df: DataFrame, name: str, order: str) -> DataFrame:
    """Initials (three letters of a single word) in capitals; from the second use on with a number from 2."""
    words = F.filter(F.split(F.regexp_replace(name, "[^A-Za-z0-9 ]", ""), r"\s+"), lambda w: w != "")
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    base = F.upper(F.when(F.size(words) > 1, initials).otherwise(F.substring(F.element_at(words, 1), 1, 3)))
    return ranked(df.withColumn("__b", base), ["__b"], [order], "__n").withColumn("short_code", F.when(F.col("__n") == 1, F.col("__b")).otherwise(F.concat("__b", F.col("__n").cast("string")))).drop("__b", "__n")


def backfill(products: DataFrame, found: DataFrame, key: str, exact: list[str], ignoring_case: list[str]) -> DataFrame:
    """Products whose found values differ, with the columns that change."""
    joined = products.alias("p").join(found.alias("f"), key)
    changes = []
    for c in exact + ignoring_case:
        form = folded if c in ignoring_case else (lambda x: F.trim(x))
        new, old = F.col(f"f.{c}"), F.col(f"p.{c}")
        changes.append(F.when(F.coalesce(F.trim(new), F.lit("")) != "", F.when(~form(new).eqNullSafe(form(old)), F.lit(c))))
    return joined.select(key, F.array_compact(F.array(*changes)).alias("changed")).where(F.size("changed") > 0)


def signals(records: DataFrame, key: str, brand: str, product: str, licence: str) -> DataFrame:
    """(key, signal): brand and product, and with the licence where there is one."""
    b, p, x = folded(brand), folded(product), F.nullif(F.trim(licence), F.lit(""))
    some = (b != "") & (p != "")
    found = F.array_compact(F.array(F.when(some, F.concat_ws("|", F.lit("bp"), b, p)), F.when(some & x.isNotNull(), F.concat_ws("|", F.lit("bpx"), b, p, x))))
    return records.select(key, F.explode(found).alias("signal"))


def families(records: DataFrame, key: str, shared: DataFrame) -> DataFrame:
    """(key, family): records joined by shared signals, directly or through others; family is the smallest key.

    Each signal is linked to its smallest record, so a signal of n records makes n links.
    """
    nodes = shared.groupBy("signal").agg(F.min(key).alias("root"))
    label = connected(shared.join(nodes, "signal").select(F.col(key).alias("a"), F.col("root").alias("b")))
    return records.select(key).distinct().join(label.withColumnRenamed("a", key), key, "left").select(key, F.coalesce("l", key).alias("family"))


def held_out_families(rows: DataFrame, family: str, percent: int) -> DataFrame:
    """Rows with ``validation``: a family goes there whole, chosen by the first digits of its MD5."""
    share = F.conv(F.substring(F.md5(F.col(family).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 100
    return rows.withColumn("validation", share < percent)
