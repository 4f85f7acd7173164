"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of ids that are broadcast; beyond it the same join is shuffled.
BROADCAST_IDS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only in local mode, where the session may name none, is a temporary one made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("vellum.checkpoint.dir", None)
        if not path and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        if not path:
            path = tempfile.mkdtemp(prefix="vellum-")
            spark.conf.set("vellum.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts the lineage, so that later stages neither repeat the work nor
    depend on executors that may be lost. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellum-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, which bounds what a task works on at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def small_batches(spark: SparkSession, rows: int = 1_000, read: int = 512) -> None:
    """Texts are long: rows are read, and go to Python, in batches of so many, which bounds the buffers of both sides."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.parquet.columnarReaderBatchSize", read)):
        if int(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Free memory goes back to the system; workers are used again, and would keep it through all later stages."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A function of batches that gives memory back when they end."""

    @wraps(run)
    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return leaner


def lean_group(run: Callable) -> Callable:
    """A function of a group's key and rows that gives memory back after each group."""

    @wraps(run)
    def leaner(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        out = run(key, t)
        give_back()
        return out

    return leaner


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_or_shuffled(df: DataFrame, rows: int, limit: int = BROADCAST_IDS) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph: ``(node, root)``, root the smallest node.

    Alternates the large-star and small-star steps, each a grouped minimum and
    a join, until the edges no longer change. Only nodes with an edge to
    another node are returned. Null ends and self loops are ignored; repeated
    edges count once; an empty table gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    e = materialize(e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo"))).distinct())
    before = _digest(e)
    while before[0]:
        both = e.union(e.select("lo", "hi"))
        low = both.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, both.hi == low.u).where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = large.where("hi != lo").distinct()
        low = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        joined = large.join(low, large.hi == low.u)
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo").union(low.select("u", "m"))
        e = materialize(small.distinct())
        after = _digest(e)
        if after == before:
            break
        before = after
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select("lo", "lo").distinct())


def _digest(e: DataFrame) -> tuple:
    h = F.xxhash64("hi", "lo")
    return tuple(e.agg(F.count("*"), F.sum(h % 1_000_003), F.bit_xor(h)).first())


def fresh(columns: list[str], name: str) -> str:
    """A column name that begins like ``name`` and is none of ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
