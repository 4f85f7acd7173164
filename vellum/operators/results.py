"""What a request returns besides its rows: rendered values, the values it was sorted by, totals, time limits."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.ordering import Key

T = TypeVar("T")


def rendered(rows: DataFrame, booleans: list[str] = (), times: dict[str, str] | None = None, many: list[str] = ()) -> DataFrame:
    """Columns as they are shown; the others stay.

    ``booleans`` hold 0 or another number and become false or true; ``times``
    become text by their pattern; ``many`` are arrays whether they hold one value
    or several, and empty instead of null. A null boolean or time stays null.
    """
    kinds = dict(rows.dtypes)
    shown = {c: F.col(c) != 0 for c in booleans}
    shown |= {c: F.date_format(c, pattern) for c, pattern in (times or {}).items()}
    for c in many:
        if kinds[c].startswith("array"):
            shown[c] = F.coalesce(F.col(c), F.array().cast(kinds[c]))
        else:
            shown[c] = F.array_compact(F.array(c))
    return rows.withColumns(shown)


def sort_values(keys: list[Key]) -> Column:
    """The values that a row is sorted by, as a struct in the order of the keys."""
    return F.struct(*[k.value.alias(f"key{i}") for i, k in enumerate(keys)])


def in_collation(text: Column, name: str = "UNICODE") -> Column:
    """Text that compares, groups and sorts by a collation, such as UNICODE_CI or de."""
    return F.collate(text, name)


def total_hits(rows: DataFrame) -> DataFrame:
    """``(value, relation)``: how many rows there are; the count is always exact."""
    return rows.agg(F.count("*").alias("value")).withColumn("relation", F.lit("EQUAL_TO"))


def within(spark: SparkSession, seconds: float, act: Callable[[], T]) -> tuple[T | None, bool]:
    """``(result, timed_out)`` of an action whose jobs are cancelled after so many seconds; no result is partial."""
    if seconds <= 0:
        raise ValueError(f"the time limit has to be positive, not {seconds}")
    context, tag, late = spark.sparkContext, f"vellum-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        return act(), False
    except Exception:
        if late.is_set():
            return None, True
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
