"""Facet counts, drill-down and drill-sideways."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flat(rows: DataFrame, dim: str, n: int = 7) -> DataFrame:
    """``(label, count, total, child_count)`` of the most frequent labels; ties by label."""
    counts = rows.where(F.col(dim).isNotNull()).groupBy(F.col(dim).cast("string").alias("label")).agg(F.count("*").alias("count"))
    return _best(counts, n)


def _best(counts: DataFrame, n: int) -> DataFrame:
    whole = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.count("*").alias("child_count"))  # one row
    return counts.orderBy(F.desc("count"), "label").limit(n).crossJoin(F.broadcast(whole))


def multi_valued(rows: DataFrame, dim: str, n: int = 7) -> DataFrame:
    """As ``flat`` over an array column; a row counts once for each distinct value."""
    labels = rows.select(F.explode(F.array_distinct(dim)).alias("label")).where("label is not null").select(F.col("label").cast("string"))
    return _best(labels.groupBy("label").agg(F.count("*").alias("count")), n)


def hierarchy(rows: DataFrame, path: Column, under: list[str] = (), n: int = 7) -> DataFrame:
    """Counts of the children of a path; ``path`` is an array column."""
    under = list(under)
    inside = rows.select(path.alias("p")).where(F.size("p") > len(under))
    if under:
        inside = inside.where(F.slice("p", 1, len(under)) == F.array(*[F.lit(x) for x in under]))
    child = F.element_at("p", len(under) + 1)
    return _best(inside.groupBy(child.alias("label")).agg(F.count("*").alias("count")), n)


def labels(rows: DataFrame, dim: str, wanted: list[str]) -> DataFrame:
    """Counts of these labels, in this order, zero included: one pass."""
    sums = rows.agg(*[F.count_if(F.col(dim) == x).alias(f"c{i}") for i, x in enumerate(wanted)])
    pairs = [F.struct(F.lit(i).alias("place"), F.lit(x).alias("label"), F.col(f"c{i}").alias("count")) for i, x in enumerate(wanted)]
    return sums.select(F.inline(F.array(*pairs)))


def ranges(rows: DataFrame, value: Column, bounds: list[tuple]) -> DataFrame:
    """Counts in ranges ``(label, low, include_low, high, include_high)``, which may overlap: one pass."""

    def inside(low, with_low, high, with_high) -> Column:
        ok = value.isNotNull()
        if low is not None:
            ok = ok & ((value >= low) if with_low else (value > low))
        if high is not None:
            ok = ok & ((value <= high) if with_high else (value < high))
        return ok

    sums = rows.agg(*[F.count_if(inside(*b[1:])).alias(f"c{i}") for i, b in enumerate(bounds)])
    pairs = [F.struct(F.lit(i).alias("place"), F.lit(b[0]).alias("label"), F.col(f"c{i}").alias("count")) for i, b in enumerate(bounds)]
    return sums.select(F.inline(F.array(*pairs)))


def many(rows: DataFrame, dims: list[str]) -> DataFrame:
    """``(dim, label, count)`` of several dimensions in one shuffle."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("label")) for d in dims])
    return rows.select(F.explode(pairs).alias("x")).where("x.label is not null").groupBy("x.dim", "x.label").agg(F.count("*").alias("count"))


def drill_down(rows: DataFrame, drills: dict[str, Column]) -> DataFrame:
    """Rows that pass the condition of every dimension; a dimension's own choices are or-ed in its condition."""
    return rows.where(reduce(lambda a, b: a & b, drills.values(), F.lit(True)))


def drill_sideways(rows: DataFrame, drills: dict[str, Column], dims: list[str] | None = None) -> DataFrame:
    """``(dim, label, count)``: a drilled dimension ignores its own condition, not the others'.

    One scan: a row that fails nowhere counts everywhere, a row that fails in
    one dimension counts there alone.
    """
    dims = dims or list(drills)
    fails = {d: (~F.coalesce(c, F.lit(False))).cast("int") for d, c in drills.items()}
    rows = rows.withColumns({f"__fail_{d}": c for d, c in fails.items()})
    total = reduce(lambda a, b: a + b, [F.col(f"__fail_{d}") for d in drills], F.lit(0))
    rows = rows.withColumn("__fails", total).where("__fails <= 1")
    pairs = []
    for d in dims:
        seen = F.col("__fails") == 0
        if d in drills:
            seen = seen | (F.col(f"__fail_{d}") == 1)
        pairs.append(F.when(seen & F.col(d).isNotNull(), F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("label"))))
    counted = rows.select(F.explode(F.array_compact(F.array(*pairs))).alias("x"))
    return counted.groupBy("x.dim", "x.label").agg(F.count("*").alias("count"))


def top_of_each(counts: DataFrame, n: int) -> DataFrame:
    """The most frequent labels of each dimension of ``many`` or ``drill_sideways``."""
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("count"), "label"))
    return counts.withColumn("place", place).where(F.col("place") <= n)
