"""Folds over long arrays in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def scan(xs: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What a fold over ``xs`` puts out, as ``array<kind>``; nothing for a null or empty array.

    ``step(state, x)`` gives the next state and an array of what is put out. The
    fold goes through blocks of about the root of the size, so that what was put
    out is copied as often as there are blocks, not once for each element.
    """
    none = F.array().cast(f"array<{kind}>")

    def both(state: Column, out: Column) -> Column:
        return F.struct(state.alias("state"), out.alias("out"))

    def blocks(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda b: F.slice(v, b * width + 1, width))

    def one(acc: Column, x: Column) -> Column:
        after, more = step(acc["state"], x)
        return both(after, F.concat(acc["out"], more))

    def block(acc: Column, part: Column) -> Column:
        return let(F.aggregate(part, both(acc["state"], none), one), lambda v: both(v["state"], F.concat(acc["out"], v["out"])))

    def whole(v: Column) -> Column:
        return F.when(F.size(v) > 0, F.aggregate(blocks(v), both(state, none), block, lambda acc: acc["out"])).otherwise(none)

    return let(xs, whole)
