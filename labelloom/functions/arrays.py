"""Folds over arrays whose work grows with their length alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 6  # prefixes are folded in blocks of 2**BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def prefixes(values: Column, step: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each value the fold of those before it by an associative ``step``; values is a column or lambda variable.

    Folds of blocks, and of blocks of blocks, stand for their values, so that no array is copied for every element.
    """
    size = 1 << BITS

    def fold(of: Column, first: Column, n: Column) -> Column:
        return F.aggregate(F.slice(of, first + 1, n), zero, step)

    def blocks(of: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(of) - 1, BITS)), lambda c: fold(of, c * size, F.lit(size)))

    def inside(of: Column, before: Column) -> Column:
        return F.transform(of, lambda _, i: step(F.get(before, F.shiftright(i, BITS)), fold(of, F.shiftright(i, BITS) * size, i.bitwiseAND(F.lit(size - 1)))))

    few = F.transform(values, lambda _, i: fold(values, F.lit(0), i))
    many = let(blocks(values), lambda b1: let(blocks(b1), lambda b2: let(F.transform(b2, lambda _, i: fold(b2, F.lit(0), i)), lambda p2: let(inside(b1, p2), lambda p1: inside(values, p1)))))
    return F.when(F.size(values) <= size, few).otherwise(many)
