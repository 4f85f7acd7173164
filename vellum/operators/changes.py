"""Updates and deletes over append-only rows with a sequence number.

A table is what was appended; an update is a newer row with the same key, a
delete a tombstone. The live table at a version is the last row of each key up
to that version, unless it is a tombstone. Snapshots are versions that are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live(rows: DataFrame, key: str | list[str], seq: str = "seq", deleted: str | None = "deleted", version: int | None = None) -> DataFrame:
    """The last version of each key. An aggregate with map-side combine, no window, so hot keys combine early."""
    keys = [key] if isinstance(key, str) else list(key)
    if version is not None:
        rows = rows.where(F.col(seq) <= version)
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(seq)).alias("__last")).select(*keys, "__last.*")
    if deleted is not None and deleted in rows.columns:
        last = last.where(~F.coalesce(F.col(deleted), F.lit(False)))
    return last


def delete_by_terms(rows: DataFrame, column: str, values: list) -> DataFrame:
    """Rows without those that hold one of the values."""
    return rows.where(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))


def delete_all(rows: DataFrame, key: str, seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    """Tombstones, one number later, for every key that is alive: appended, they leave an empty table and keep older versions."""
    alive = live(rows, key, seq, deleted)
    last = rows.agg(F.max(seq).alias("__last"))  # one row
    return alive.crossJoin(F.broadcast(last)).withColumns({seq: (F.col("__last") + 1).cast(rows.schema[seq].dataType), deleted: F.lit(True)}).select(*rows.columns)


def write_sorted(rows: DataFrame, path: str, by: list[Column], parts: int | None = None) -> None:
    """Files in the order of ``by``, so that each row group spans a narrow range of it and range filters skip the others."""
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def delete_by_keys(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti").select(*rows.columns)


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the rows of ``changes`` in the place of those with the same key."""
    return delete_by_keys(rows, changes, key).unionByName(changes)


def merge_top(parts: list[DataFrame], order: list[Column], k: int) -> DataFrame:
    """The best ``k`` of several result tables together; ``part`` tells where a row is from."""
    each = [p.orderBy(*order).limit(k).withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    whole = each[0]
    for p in each[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole.orderBy(*order, "part").limit(k)
