"""Running values and text pieces inside one row, near-linear in the row's size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of a block of text in `cut`.
BLOCK = 4096


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """Inclusive running results of an associative operation with neutral element `start` over an array of longs.

    Steps of doubling width, n log n in all; a fold that grows an array would copy it n times.
    """
    n = F.size(values)
    widths = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.expr("1L") * F.pow(F.lit(2), k)),
                      lambda w: w < n)

    def step(acc, w):
        width = w.cast("int")
        behind = F.concat(F.array_repeat(F.lit(start).cast("long"), width), F.slice(acc, F.lit(1), F.size(acc) - width))
        return F.zip_with(acc, behind, combine)

    return F.aggregate(widths, values, step)


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def blocks(text: Column, size: int = BLOCK) -> Column:
    """A text in blocks of `size` code points, for `cut`."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))


def cut(parts: Column, start: Column, length: Column, size: int = BLOCK) -> Column:
    """`length` code points from `start` (0-based) of a text in `blocks`; only its own blocks are touched."""
    first = F.floor(start / size).cast("int")
    last = F.floor((start + F.greatest(length, F.lit(1)) - 1) / size).cast("int")
    near = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    return F.substring(near, (start - first * size + 1).cast("int"), length.cast("int"))
