"""Scoring of predicted records against expected ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.arrays import let
from labelloom.functions.text import score_value

SIMILAR = 0.85


def _counts(correct: Column, wrong: Column, missing: Column) -> Column:
    return F.struct(correct.cast("long").alias("correct"), wrong.cast("long").alias("wrong"), missing.cast("long").alias("missing"))


def _sides(predicted: Column, expected: Column) -> Column:
    return F.struct(predicted.alias("g"), expected.alias("w"))


def tri_state(predicted: Column, expected: Column, contained: bool = False) -> Column:
    """correct, wrong or missing of one value; an invented value is wrong, agreeing on nothing is correct."""

    def of(s: Column) -> Column:
        got, want = F.nullif(s["g"], F.lit("")), F.nullif(s["w"], F.lit(""))
        match = (F.contains(got, want) | F.contains(want, got)) if contained else got == want
        correct = F.when(want.isNull(), got.isNull()).otherwise(F.coalesce(match, F.lit(False)))
        return _counts(correct, got.isNotNull() & ~correct, want.isNotNull() & got.isNull())

    return let(_sides(score_value(predicted), score_value(expected)), of)


def list_score(predicted: Column, expected: Column) -> Column:
    """Items as sets; two empty lists agree."""
    clean = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), score_value), lambda x: x != ""))

    def of(s: Column) -> Column:
        got, want = s["g"], s["w"]
        both = F.size(F.array_intersect(got, want)) + ((F.size(got) == 0) & (F.size(want) == 0)).cast("int")
        return _counts(both, F.size(F.array_except(got, want)), F.size(F.array_except(want, got)))

    return let(_sides(clean(predicted), clean(expected)), of)


def map_score(predicted: Column, expected: Column) -> Column:
    """Rows of two maps by key: equal, differing or invented, absent; two empty maps agree."""
    empty = F.create_map().cast("map<string,string>")
    tidy = lambda c: F.transform_values(F.map_from_entries(F.array_distinct(F.transform(F.map_entries(F.coalesce(c, empty)), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value"))))), lambda _, v: score_value(v))

    def of(s: Column) -> Column:
        got, want = s["g"], s["w"]
        keys, known = F.map_keys(want), F.map_keys(got)
        both = F.size(F.array_intersect(keys, known))
        equal = F.size(F.filter(keys, lambda k: F.coalesce(got[k] == want[k], F.lit(False))))
        none = ((F.size(keys) == 0) & (F.size(known) == 0)).cast("int")
        return _counts(equal + none, F.size(known) - equal, F.size(keys) - both)

    return let(_sides(tidy(predicted), tidy(expected)), of)


def list_detail(predicted: Column, expected: Column) -> Column:
    """One struct (item, result) for each item; their tally is ``list_score``."""
    clean = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), score_value), lambda x: x != ""))
    got, want = clean(predicted), clean(expected)
    tag = lambda items, word: F.transform(items, lambda x: F.struct(x.alias("item"), F.lit(word).alias("result")))
    none = F.when((F.size(got) == 0) & (F.size(want) == 0), F.array(F.struct(F.lit("").alias("item"), F.lit("correct").alias("result")))).otherwise(F.array().cast("array<struct<item:string,result:string>>"))
    return F.concat(tag(F.array_intersect(got, want), "correct"), tag(F.array_except(got, want), "wrong"), tag(F.array_except(want, got), "missing"), none)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = 0
    for c in b:
        hit = row | places.get(c, 0)
        row = hit & ~(hit - (row << 1 | 1))
    return row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; two empty texts are alike."""
    return 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and each side's shared and own words; 0 if a side has no word."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    if shared and (x <= y or y <= x):
        return 1.0
    one, two = (" ".join(filter(None, [shared, " ".join(sorted(own))])) for own in (x - y, y - x))
    ratios = [indel_ratio(one, two)]
    if shared:
        ratios += [indel_ratio(shared, one), indel_ratio(shared, two)]
    return max(ratios)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """Indel ratio of two columns."""
    return F.pandas_udf(_ratios, "double")(a, b)


def fuzzy_match(predicted: Column, expected: Column) -> Column:
    """Equal, one inside the other with four characters or more, or an indel ratio of 0.85."""
    x, y = score_value(predicted), score_value(expected)
    inside = (F.least(F.length(x), F.length(y)) >= 4) & (F.contains(x, y) | F.contains(y, x))
    return (x != "") & (y != "") & ((x == y) | inside | (ratio(x, y) >= SIMILAR))


def fuzzy_tri_state(predicted: Column, expected: Column) -> Column:
    """``tri_state`` where a wrong value gets a second chance."""
    strict = tri_state(predicted, expected)
    saved = (strict["wrong"] == 1) & fuzzy_match(predicted, expected)
    return _counts(strict["correct"] + saved.cast("long"), strict["wrong"] - saved.cast("long"), strict["missing"])


def greedy_pairs(predicted: list[str], expected: list[str]) -> list[int]:
    """For each expected item the best unclaimed predicted one at 0.85 or more, or -1."""
    free, out = set(range(len(predicted))), []
    for want in expected:
        best = max(((token_set_ratio(predicted[i], want), -i) for i in free), default=(0.0, 0))
        out.append(-best[1] if best[0] >= SIMILAR else -1)
        free.discard(out[-1])
    return out


def greedy_list_score(rows: DataFrame, key: str, predicted: str, expected: str) -> DataFrame:
    """(key, correct, wrong, missing) of rows with two arrays, items matched one to one in the expected order.

    Each row is scored by itself, so rows stay where they are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for got, want in zip(pdf["got"], pdf["want"], strict=True):
                hits = sum(i >= 0 for i in greedy_pairs(list(got), list(want)))
                out.append((hits if len(got) or len(want) else 1, len(got) - hits, len(want) - hits))
            yield pdf[[key]].assign(**{n: [o[i] for o in out] for i, n in enumerate(("correct", "wrong", "missing"))})

    clean = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), score_value), lambda x: x != "")
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, clean(predicted).alias("got"), clean(expected).alias("want")).mapInPandas(run, f"`{key}` {kind}, correct long, wrong long, missing long")
