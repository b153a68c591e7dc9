"""Spans of regular expressions in texts, as column expressions whose work grows with the text and its matches alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.functions.arrays import let, prefixes

SPAN = "struct<s:int,k:int,e:int,m:string,before:string>"
CONTEXT = 24
FEW = 4096  # pairs of spans that are compared one by one
BLOCK_BITS = 10


def find_spans(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost, non-overlapping matches as structs (s, k, e, m, before), in code points.

    The text between matches gives the offsets: gap, match, gap, and so on. before is up to CONTEXT characters of
    the gap in front.
    """

    def placed(matches: Column, gaps: Column) -> Column:
        lengths = F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

        def spans(of: Column, before: Column) -> Column:
            end = lambda i: F.get(before, i) + F.get(of, i)
            return F.transform(matches, lambda m, i: F.struct((end(i) - F.length(m)).alias("s"), F.lit(kind).alias("k"), end(i).alias("e"), m.alias("m"), F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before")))

        return let(lengths, lambda of: let(prefixes(of, lambda a, b: a + b, F.lit(0)), lambda before: spans(of, before))).cast(f"array<{SPAN}>")

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda matches: F.when(F.size(matches) > 0, let(F.split(text, pattern, -1), lambda gaps: placed(matches, gaps))).otherwise(none()))


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of every span by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def of_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")


def apart(spans: Column, base: Column) -> Column:
    """The spans that overlap none of ``base``. Many of them are sorted by where they end among the starts of the base;
    a span overlaps if the largest end of what starts before its own end lies behind its start."""

    def merged(own: Column, other: Column) -> Column:
        ends = F.transform(own, lambda x: F.struct(x["e"].alias("at"), F.lit(0).alias("rank"), x.alias("x")))
        starts = F.transform(other, lambda b: F.struct(b["s"].alias("at"), F.lit(1).alias("rank"), b.alias("x")))

        def kept(events: Column, reach: Column) -> Column:
            return F.transform(F.filter(F.transform(events, lambda v, i: F.struct(v["x"].alias("x"), ((v["rank"] == 0) & (F.get(reach, i) <= v["x"]["s"])).alias("free"))), lambda v: v["free"]), lambda v: v["x"])

        largest = lambda a, b: F.greatest(a, b)
        return let(F.array_sort(F.concat(ends, starts)), lambda events: let(F.transform(events, lambda v: F.when(v["rank"] == 1, v["x"]["e"]).otherwise(F.lit(0))), lambda reach: let(prefixes(reach, largest, F.lit(0)), lambda before: F.array_sort(kept(events, before)))))

    def both(own: Column, other: Column) -> Column:
        few = F.filter(own, lambda x: ~F.exists(other, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
        return F.when(F.size(own) * F.size(other) <= FEW, few).otherwise(merged(own, other))

    return let(spans, lambda own: let(base, lambda other: both(own, other)))


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark for every span; a span that starts inside earlier ones gets none of its own.

    What stays is taken from blocks of the text, since finding a place in a long text takes as many steps as the
    place is far.
    """
    size = 1 << BLOCK_BITS

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        i, j, low = F.shiftright(a, BLOCK_BITS), F.shiftright(b, BLOCK_BITS), F.lit(size - 1)
        block = lambda at: F.coalesce(F.get(blocks, at), F.lit(""))
        one = F.substring(block(i), a.bitwiseAND(low) + 1, b - a)
        several = F.concat(F.substring(block(i), a.bitwiseAND(low) + 1, F.lit(size)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(block(j), F.lit(1), b.bitwiseAND(low)))
        return F.when(i == j, one).otherwise(several)

    def cut(ordered: Column, reach: Column, blocks: Column) -> Column:
        gaps = F.filter(F.transform(ordered, lambda x, i: F.struct(F.get(reach, i).alias("a"), x["s"].alias("b"))), lambda g: g["a"] <= g["b"])
        front = F.array_join(F.transform(gaps, lambda g: F.concat(piece(blocks, g["a"], g["b"]), F.lit(mark))), "")
        return F.concat(front, piece(blocks, F.array_max(F.transform(ordered, lambda x: x["e"])), F.length(text)))

    largest = lambda a, b: F.greatest(a, b)
    split = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    done = lambda ordered: let(F.transform(ordered, lambda x: x["e"]), lambda ends: let(prefixes(ends, largest, F.lit(0)), lambda reach: let(split, lambda blocks: cut(ordered, reach, blocks))))
    return F.when(F.size(spans) > 0, let(F.array_sort(spans), done)).otherwise(text)
