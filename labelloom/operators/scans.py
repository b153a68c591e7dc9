"""Ordered scans over keys of any size.

Rows are dealt by ranges of keys and order, so a key is spread over many tasks. A task scans its own range; a table with
one row for each range and key hands what has been gathered over to the ranges behind it. Medians, gap sessions and line
numbers are built on that, so no task holds a whole key that is large. Lines of a key of up to ``PAGE_ROWS`` rows are
found in Arrow batches, where its rows meet in a single shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions.arrays import let
from labelloom.operators.shared import by_size, cut, drop, joined, ranked

PAGE_ROWS = 8192  # rows of a key whose lines are found in one batch; larger keys are scanned by ranges
PIECE = 1 << 16  # rows of such keys that are taken at a time, up to the end of a key
BLOCK_MARKS = 2048  # marks that are folded within one row; longer blocks are settled by pointers


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with ``__p``, the number of its range of keys and order, as a table."""
    return cut(df.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id()), "dealt")


_JOINED = {F.max: F.greatest, F.min: F.least, F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}


def _handed(rows: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what ``before`` hands over. A range goes on with one key at most, the one it begins with, so what
    there is to hand over is a row for each range and is broadcast; the rows stay where they are."""
    return joined(rows, F.broadcast(before.where("__c IS NOT NULL")), ["__p", *keys], "left")


def running(rows: DataFrame, keys: list[str], order: list[str], value: str, how: Callable[[str], Column], name: str, inclusive: bool = False) -> DataFrame:
    """``rows`` (as ``dealt`` gives them) with the max, min or sum (``how``) of ``value`` over the rows of the key in front."""
    line = Window.partitionBy("__p", *keys).orderBy(*order)
    here = rows.withColumn("__h", how(value).over(line.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)))
    ends = rows.groupBy("__p", *keys).agg(how(value).alias("__e"))
    before = how("__e").over(Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    met = _handed(here, ends.select("__p", *keys, before.alias("__c")), keys)
    return met.withColumn(name, _JOINED[how](F.col("__h"), F.col("__c"))).drop("__h", "__c")


def previous(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` (as ``dealt`` gives them) with ``value`` of the row in front, null for the first of a key."""
    line = Window.partitionBy("__p", *keys).orderBy(*order)
    here = rows.withColumns({"__h": F.lag(value).over(line), "__first": F.row_number().over(line) == 1})
    ends = rows.groupBy("__p", *keys).agg(F.max_by(F.struct(value.alias("v")), F.struct(*order)).alias("__e"))
    before = F.lag("__e").over(Window.partitionBy(*keys).orderBy("__p"))
    met = _handed(here, ends.select("__p", *keys, before.alias("__c")), keys)
    return met.withColumn(name, F.when(F.col("__first"), F.col("__c.v")).otherwise(F.col("__h"))).drop("__h", "__c", "__first")


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median, upper_median): exact, interpolated and as an element. Counts of equal values are added up along
    the order of values, so many different values of one key are spread over many tasks. Nulls do not count."""
    counts = dealt(df.groupBy(*keys, F.col(value).alias("__v")).agg(F.count(value).alias("__n")), keys, ["__v"])
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("__t"))
    placed = joined(running(counts, keys, ["__v"], "__n", F.sum, "__b"), total, keys)
    holds = lambda at: (F.col("__b") <= at) & (at < F.col("__b") + F.col("__n"))
    lower, upper = F.expr("(__t - 1) div 2"), F.expr("__t div 2")
    found = placed.groupBy(*keys).agg(F.max(F.when(holds(lower), F.col("__v"))).alias("__l"), F.max(F.when(holds(upper), F.col("__v"))).alias("upper_median"))
    return found.select(*keys, (F.col("__l").cast("double") * 0.5 + F.col("upper_median").cast("double") * 0.5).alias("median"), "upper_median")


def sessions_by_gap(df: DataFrame, keys: list[str], start: str, end: str, gap: Column) -> DataFrame:
    """df with ``band``: a new band where a row starts beyond the furthest end in front of it by more than ``gap``.

    Rows go by their start; the gap is 0 or more and one for each key; an end before its start counts as the start, so
    rows of one start share a band, and only distinct starts are scanned.
    """
    marks = df.groupBy(*keys, start).agg(F.max(F.greatest(start, end)).alias("__e"), F.max(gap).alias("__g"))
    reach = running(dealt(marks, keys, [start]), keys, [start], "__e", F.max, "__r")
    opens = F.when(F.col("__r").isNull() | (F.col(start) > F.col("__r") + F.col("__g")), 1).otherwise(0)
    flagged = cut(reach.select("__p", *keys, start, opens.alias("__new")), "bands")
    return joined(df, running(flagged, keys, [start], "__new", F.sum, "band", inclusive=True).drop("__p", "__new"), [*keys, start])


def line_numbers(rows: DataFrame, keys: list[str], cross: Column, size: Column, name: str) -> DataFrame:
    """``rows`` with the number of their line, from 0, by falling ``cross``, larger ``size`` first.

    A row opens a line if it lies below the line's first row by more than half of the smaller of two sizes: its own, and
    the largest of the line so far. Rows of one position share a line. Keys of up to ``PAGE_ROWS`` rows are folded in
    batches of whole keys (``_page_lines``), larger ones are scanned by ranges (``_ranged_lines``).
    """
    few, many, place = _places(rows, keys, cross, size)
    schema = T.StructType([*rows.schema, T.StructField(name, T.LongType())])
    found = _page_lines(few, keys, place, name, rows.columns, lambda numbered, *_: numbered, schema)
    return found if many is None else found.unionByName(_ranged_lines(many.withColumns(place), keys, name))


def lined(rows: DataFrame, keys: list[str], cross: Column, size: Column, name: str) -> DataFrame:
    """(keys, ``name``, rows): the other columns of the rows of each line, as ``line_numbers`` counts them."""
    rest = [f for f in rows.schema if f.name not in keys]

    def gathered(numbered: pa.Table, starts: np.ndarray, *_: np.ndarray) -> pa.Table:
        fields = [numbered.schema.field(f.name) for f in rest]
        each = pa.StructArray.from_arrays([numbered[f.name].combine_chunks() for f in fields], fields=fields)
        ends = pa.array(np.append(starts, numbered.num_rows), pa.int32())
        return numbered.select([*keys, name]).take(pa.array(starts)).append_column("rows", pa.ListArray.from_arrays(ends, each))

    return lines_of(rows, keys, cross, size, name, [f.name for f in rest], gathered, [T.StructField("rows", T.ArrayType(T.StructType(rest)))], lambda far: far)


def lines_of(
    rows: DataFrame, keys: list[str], cross: Column, size: Column, name: str, taken: list[str],
    near: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table], fields: list[T.StructField], far: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """(keys, ``name``, fields): a row for each line. Where keys meet in a batch ``near`` makes them of the columns
    ``taken`` of rows that go by lines, the first row of each line, and the negated places; elsewhere ``far`` makes them
    of (keys, ``name``, rows)."""
    few, many, place = _places(rows, keys, cross, size)
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField(name, T.LongType()), *fields])
    found = _page_lines(few, keys, place, name, [*keys, *taken], near, schema)
    if many is None:
        return found
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    return found.unionByName(far(_ranged_lines(many.withColumns(place), keys, name).groupBy(*keys, name).agg(F.collect_list(rest).alias("rows"))))


def _places(rows: DataFrame, keys: list[str], cross: Column, size: Column) -> tuple[DataFrame, DataFrame | None, dict[str, Column]]:
    """Rows of small and of large keys, and the columns they are sorted by: none of them null."""
    place = {"__u": -cross.cast("double"), "__w": -size.cast("double")}
    return *by_size(rows.where(place["__u"].isNotNull() & place["__w"].isNotNull()), keys, PAGE_ROWS), place


def _page_lines(few: DataFrame, keys: list[str], place: dict[str, Column], name: str, taken: list[str], near: Callable, schema: T.StructType) -> DataFrame:
    """What ``near`` makes of the rows of whole keys with the number of their line. Rows are dealt and sorted by key as
    they are, their places are sorted in the batch."""
    most, names = PIECE, schema.names

    def folded(rows: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, w, key = rows["__u"].to_numpy(), rows["__w"].to_numpy(), np.cumsum(new)
        order = np.lexsort((w, u, key))
        u, w = u[order], w[order]
        starts = line_starts(new, u, w)
        line = np.cumsum(starts)
        line -= line[new][key - 1]
        numbered = rows.select(taken).take(pa.array(order)).append_column(name, pa.array(line))
        yield from near(numbered, np.flatnonzero(starts), u, w).select(names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                rows = pa.Table.from_batches(held).combine_chunks()
                new = key_starts(rows, keys)
                last = int(np.flatnonzero(new)[-1])  # its key may go on in the next batch
                if last:
                    yield from folded(rows.slice(0, last), new[:last])
                held, n = rows.slice(last).to_batches(), n - last
        if n:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from folded(rows, key_starts(rows, keys))

    sorted_ = few.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return sorted_.withColumns(place).select(*taken, *place).mapInArrow(run, schema)


def key_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Which rows, sorted by keys, are the first of their key; null is a key, and so is NaN."""
    new = np.arange(rows.num_rows) == 0
    for k in keys:
        a, b = (rows[k].combine_chunks().slice(i, rows.num_rows - 1) for i in (0, 1))
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
        if pa.types.is_floating(a.type):
            differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        new[1:] |= np.asarray(differ)
    return new


def line_starts(new: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of places that are sorted within keys which open a line; ``new`` are the first of a key. NaN is the largest number."""
    moved, starts = new.copy(), np.zeros(len(new), dtype=bool)
    for c in (u, w):
        moved[1:] |= (c[1:] != c[:-1]) & ~(np.isnan(c[1:]) & np.isnan(c[:-1]))
    at = np.flatnonzero(moved)
    cross, size = -u[at], -w[at]
    with np.errstate(invalid="ignore"):
        low = cross + size * 0.5
    first = largest = 0.0
    for i, begins, c, s, bottom in zip(at.tolist(), new[at].tolist(), cross.tolist(), size.tolist(), low.tolist(), strict=True):
        if begins or bottom < first or c + largest * 0.5 < first:
            first, largest, starts[i] = c, s, True
        elif s > largest or s != s:
            largest = s
    return starts


def _ranged_lines(marked: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``line_numbers`` of keys of any size. Only distinct positions are looked at. One that lies below its neighbour by
    more than half its own size opens a line whatever came before. That cuts a key into blocks, which are settled on
    their own: within a row if they are short, else by pointers (``_far_lines``).
    """
    order, block = ["__u", "__w"], [*keys, "__b"]
    marks = dealt(marked.select(*keys, *order).distinct(), keys, order)
    apart = previous(marks, keys, order, F.col("__u"), "__q").withColumn("__new", F.when(F.col("__q").isNull() | (-F.col("__u") - F.col("__w") * 0.5 < -F.col("__q")), 1).otherwise(0))
    blocks = cut(running(cut(apart.drop("__q"), "marks"), keys, order, "__new", F.sum, "__b", inclusive=True).drop("__new", "__p"), "blocks")
    sizes = cut(blocks.groupBy(*block).agg(F.count("*").alias("__n")), "sizes")
    short = joined(blocks, sizes.where(F.col("__n") <= BLOCK_MARKS).drop("__n"), block)
    opened, longest = _near_lines(short, block, order), sizes.agg(F.max("__n")).first()[0] or 0
    if longest > BLOCK_MARKS:
        far = cut(sizes.where(F.col("__n") > BLOCK_MARKS).select(*block, F.monotonically_increasing_id().alias("__id")), "far")
        found = _far_lines(joined(blocks, far, block).select("__id", *order), ["__id"], longest)
        opened = opened.unionByName(found.join(far, "__id").drop("__id"))
    lines = running(dealt(opened, keys, order), keys, order, "__new", F.sum, name, inclusive=True)
    return joined(marked, lines.select(*keys, *order, (F.col(name) - 1).alias(name)), [*keys, *order]).drop(*order)


def _opens(first: Column, largest: Column, cross: Column, size: Column) -> Column:
    return (cross + size * 0.5 < first) | (cross + largest * 0.5 < first)


def _near_lines(marks: DataFrame, block: list[str], order: list[str]) -> DataFrame:
    """(block, order, __new): one fold over the marks of each block, which writes down a digit for each mark."""

    def step(acc: Column, x: Column) -> Column:
        cross, size = -x["__u"], -x["__w"]
        new = acc["first"].isNull() | _opens(acc["first"], acc["largest"], cross, size)
        turn = F.struct(cross.alias("first"), size.alias("largest"), F.concat(acc["out"], F.lit("1")).alias("out"))
        return F.when(new, turn).otherwise(F.struct(acc["first"].alias("first"), F.greatest(acc["largest"], size).alias("largest"), F.concat(acc["out"], F.lit("0")).alias("out")))

    none = F.lit(None).cast("double")
    zero = F.struct(none.alias("first"), none.alias("largest"), F.lit("").alias("out"))
    gathered = marks.groupBy(*block).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("__m"))
    digits = F.split(F.aggregate("__m", zero, step, lambda acc: acc["out"]), "")
    flagged = let(digits, lambda of: F.transform("__m", lambda x, i: F.struct(x["__u"].alias("__u"), x["__w"].alias("__w"), F.get(of, i).cast("int").alias("__new"))))
    return gathered.select(*block, F.explode(flagged).alias("x")).select(*block, "x.*")


def _far_lines(marks: DataFrame, block: list[str], longest: int) -> DataFrame:
    """(block, order, __new) of blocks of up to ``longest`` marks, in a number of rounds that grows with its logarithm.

    The line that would start at a mark i ends at one of two places, whichever comes first: n2, the first mark j behind
    it with cross_j + size_j / 2 below cross_i; and n1, which looks at the largest size so far. That size changes at the
    next mark as large (``up``), so n1 is up(p) for the first p of the chain i, up(i), up(up(i)), ... where
    cross_up(p) + size_p / 2 lies below cross_i. up and n2 are found by halving steps over the largest size and the
    smallest cross + size / 2 of 2^k marks, n1 by the same steps along the chain. What the first mark reaches over these
    pointers, which double every round, are the lines.
    """
    rounds = math.ceil(math.log2(longest + 1))
    at = [*block, "__z"]
    base = cut(ranked(marks, block, ["__u", "__w"], "__z").select(*at, (-F.col("__u")).alias("__c"), (-F.col("__w")).alias("__s")), "ranks")

    def moved(table: DataFrame, by: int) -> DataFrame:
        return table.withColumn("__z", F.col("__z") - by)

    # over 2^k marks: the largest size and the lowest cross + size / 2
    levels = [cut(base.select(*at, F.col("__s").alias("__x"), (F.col("__c") + F.col("__s") * 0.5).alias("__y")), "level")]
    for k in range(rounds - 1):
        other = moved(levels[-1], 1 << k).select(*at, F.col("__x").alias("__x2"), F.col("__y").alias("__y2"))
        both = levels[-1].join(other, at, "left")
        levels.append(cut(both.select(*at, F.greatest("__x", "__x2").alias("__x"), F.least("__y", "__y2").alias("__y")), "level"))
    # each mark looks for ``up`` and for n2
    place = F.explode(F.array(F.lit(False), F.lit(True))).alias("__low")
    seeks = base.select(*block, F.col("__z").alias("__i"), "__c", "__s", place, (F.col("__z") + 1).alias("__z"))
    for k in reversed(range(rounds)):
        passed = F.coalesce(F.when(F.col("__low"), F.col("__y") >= F.col("__c")).otherwise(F.col("__x") < F.col("__s")), F.lit(False))
        seeks = cut(seeks.join(levels[k], at, "left").withColumn("__z", F.col("__z") + F.when(passed, 1 << k).otherwise(0)).drop("__x", "__y"), "seeks")
    drop(*levels)
    there = base.select(*at, F.col("__c").alias("__d"))
    met = cut(seeks.join(there, at).select(*block, "__i", "__low", F.col("__z").alias("__to"), (F.col("__d") + F.col("__s") * 0.5).alias("__q")), "pointers")
    # along the chains of ``up``: the target of 2^k steps and the lowest cross + size / 2 on the way
    tree = [cut(met.where("NOT __low").select(*block, F.col("__i").alias("__z"), "__to", "__q"), "chain")]
    for _ in range(rounds - 1):
        other = tree[-1].select(*block, F.col("__z").alias("__to"), F.col("__to").alias("__to2"), F.col("__q").alias("__q2"))
        tree.append(cut(tree[-1].join(other, [*block, "__to"]).select(*at, F.col("__to2").alias("__to"), F.least("__q", "__q2").alias("__q")), "chain"))
    walk = base.select(*block, F.col("__z").alias("__i"), "__c", "__z")
    for k in reversed(range(rounds)):
        free = F.coalesce(F.col("__q") >= F.col("__c"), F.lit(False))
        walk = cut(walk.join(tree[k], at, "left").withColumn("__z", F.when(free, F.col("__to")).otherwise(F.col("__z"))).drop("__to", "__q"), "walk")
    hits = walk.join(tree[0], at).where(F.col("__q") < F.col("__c")).select(*block, F.col("__i").alias("__z"), "__to")
    ends = hits.unionByName(met.where("__low").select(*block, F.col("__i").alias("__z"), "__to"))
    jump = cut(ends.groupBy(*at).agg(F.min("__to").alias("__to")), "jumps")
    drop(*tree, met)
    opened = base.where("__z = 1").select(*at)
    for _ in range(rounds):
        step = jump.select(*block, F.col("__z").alias("__to"), F.col("__to").alias("__to2"))
        opened = cut(opened.unionByName(opened.join(jump, at).select(*block, F.col("__to").alias("__z"))).distinct(), "opened")
        last, jump = jump, cut(jump.join(step, [*block, "__to"]).select(*at, F.col("__to2").alias("__to")), "jumps")
        drop(last)
    flagged = base.join(opened.withColumn("__new", F.lit(1)), at, "left")
    return flagged.select(*block, (-F.col("__c")).alias("__u"), (-F.col("__s")).alias("__w"), F.coalesce("__new", F.lit(0)).alias("__new"))
