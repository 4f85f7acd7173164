"""Sorting with rules for missing and many values, paging, grouping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import geo


@dataclass
class Key:
    """A sort key. A missing value is the least, or with ``missing_last`` the greatest, before reversing."""

    value: Column
    reverse: bool = False
    missing_last: bool = False

    def order(self) -> Column:
        if self.reverse:
            return self.value.desc_nulls_first() if self.missing_last else self.value.desc_nulls_last()
        return self.value.asc_nulls_last() if self.missing_last else self.value.asc_nulls_first()

    def after(self, last) -> tuple[Column, Column]:
        """Conditions: the row comes after ``last`` by this key, and it is equal to it."""
        v = self.value
        nulls_first = self.reverse == self.missing_last
        if last is None:
            return (v.isNotNull() if nulls_first else F.lit(False)), v.isNull()
        beyond = (v < last) if self.reverse else (v > last)
        later = F.coalesce(beyond, F.lit(False)) if nulls_first else F.coalesce(beyond, F.lit(False)) | v.isNull()
        return later, v.eqNullSafe(F.lit(last))


def selected(values: Column, how: str = "min") -> Column:
    """One value of many: ``min``, ``max``, ``middle_min``, ``middle_max`` (the middle of the distinct sorted ones)."""
    if how == "min":
        return F.array_min(values)
    if how == "max":
        return F.array_max(values)
    s = F.sort_array(F.array_distinct(F.array_compact(values)))
    middle = F.floor((F.size(s) - 1) / 2) if how == "middle_min" else F.floor(F.size(s) / 2)
    return F.get(s, middle.cast("int"))


def distance_key(lat: Column, lon: Column, lat0: float, lon0: float) -> Key:
    return Key(geo.haversine(lat, lon, F.lit(lat0), F.lit(lon0)), missing_last=True)


def page(rows: DataFrame, keys: list[Key], id_col: str, end: int, start: int = 0) -> DataFrame:
    """Rows ``start`` to ``end`` in order; ties by id. Becomes a top-k, not a full sort."""
    ordered = rows.orderBy(*[k.order() for k in keys], F.col(id_col))
    return (ordered.offset(start) if start else ordered).limit(end - start)


def page_after(rows: DataFrame, keys: list[Key], id_col: str, size: int, last_values: list, last_id) -> DataFrame:
    """The next page after a row that is known by its key values and its id."""
    tied: Column = F.lit(True)
    later: Column = F.lit(False)
    for key, last in zip(keys, last_values):
        beyond, equal = key.after(last)
        later = later | (tied & beyond)
        tied = tied & equal
    later = later | (tied & (F.col(id_col) > last_id))
    return page(rows.where(later), keys, id_col, size)


def top_groups(rows: DataFrame, group: str, group_keys: list[Key], keys: list[Key], id_col: str, groups: int = 3, hits: int = 4, start: int = 0, score: Column | None = None) -> DataFrame:
    """The best hits of the best groups.

    Groups rank by their best row under ``group_keys``; hits in a group by
    ``keys``. Adds ``group_rank`` (from 1), ``hit_rank``, ``group_hits`` (all
    rows of the group) and, with a ``score``, ``group_max_score``. A null group is a group. The first pass is an aggregate
    with map-side combine, so a group of any size costs one row for each task.
    """
    best = F.struct(*[_ordinal(k) for k in group_keys], F.col(id_col))
    most = [F.max(score).alias("group_max_score")] if score is not None else []
    firsts = rows.groupBy(F.col(group).alias("__g")).agg(F.min(best).alias("__best"), F.count("*").alias("group_hits"), *most)
    ranked = firsts.orderBy("__best").limit(start + groups)
    ranked = ranked.withColumn("group_rank", F.row_number().over(Window.orderBy("__best"))).where(F.col("group_rank") > start)  # few rows
    chosen = rows.join(F.broadcast(ranked), rows[group].eqNullSafe(F.col("__g"))).drop("__g", "__best")
    place = F.row_number().over(Window.partitionBy("group_rank").orderBy(*[k.order() for k in keys], F.col(id_col)))
    return chosen.withColumn("hit_rank", place).where(F.col("hit_rank") <= hits)


def _ordinal(key: Key) -> Column:
    """A numeric key as a struct that sorts ascending."""
    missing = F.when(key.value.isNull(), 0 if key.reverse == key.missing_last else 2).otherwise(1)
    value = -key.value.cast("double") if key.reverse else key.value.cast("double")
    return F.struct(missing, value)
