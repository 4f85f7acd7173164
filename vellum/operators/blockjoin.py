"""Parents and children: scores of children lifted to parents, with their best children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_parent(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, mode: str = "max", score: str = "score") -> DataFrame:
    """Parents with a matching child; their score is the max, avg or total of the children's, or 0 with ``none``."""
    how = {"max": F.max, "avg": F.avg, "total": F.sum}
    lifted = how[mode](score) if mode in how else F.lit(0.0)
    scores = children.groupBy(F.col(child_key).alias("__parent")).agg(lifted.cast("double").alias("score"), F.count("*").alias("child_hits"))
    return parents.join(scores, parents[parent_key] == F.col("__parent")).drop("__parent")


def child_hits(children: DataFrame, child_key: str, order: list[Column], most: int, fields: list[str]) -> DataFrame:
    """``(parent, hits)``: the best children of each parent, at most ``most``, as an array of structs."""
    place = F.row_number().over(Window.partitionBy(child_key).orderBy(*order))
    few = children.withColumn("place", place).where(F.col("place") <= most)
    return few.groupBy(F.col(child_key).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("place", *fields))).alias("hits"))
