"""Arrays within a row: values bound once, and running sums in less than quadratic time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _before(numbers: Column, first: Column) -> Column:
    """``first`` plus the sum of the numbers before each. Copies what it has at each step, so for short arrays."""

    def step(done: Column, x: Column) -> Column:
        return F.struct((done.at + x).alias("at"), F.concat(done.out, F.array(done.at)).alias("out"))

    return F.aggregate(numbers, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda done: done.out)


def sums_before(numbers: Column) -> Column:
    """For each number (int) of an array the sum of those before it.

    The array is summed in blocks of about the root of its size, then within each block, so n numbers
    take about n * sqrt(n) copies, a second for 100,000.
    """

    def blocked(a: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(a))).cast("int")
        last = F.ceil(F.size(a) / width).cast("int") - 1
        return bind(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(a, b * width + 1, width)), within)

    def within(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b))
        return F.flatten(F.zip_with(blocks, _before(sums, F.lit(0)), _before))

    return F.when(F.size(numbers) > 0, bind(numbers, blocked)).otherwise(F.array().cast("array<int>"))


def spans(pieces: Column, found: Column) -> Column:
    """Structs (start, end), in code points, of the matches ``found`` of a text whose other parts are ``pieces``, in order."""
    gaps = F.slice(pieces, F.lit(1), F.size(found))
    lengths = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))

    def placed(sizes: Column) -> Column:
        before = sums_before(F.transform(sizes, lambda s: s.gap + s.size))
        return F.zip_with(sizes, before, lambda s, b: F.struct((b + s.gap).alias("start"), (b + s.gap + s.size).alias("end")))

    return bind(lengths, placed)
