"""Near-real-time ingest with Structured Streaming.

Each micro-batch is appended as a generation; readers take the last generation
that is complete, or an older one that they name. A batch that is tried again
writes the same generation anew, so nothing is doubled.
"""

from __future__ import annotations

from time import monotonic, sleep

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def start(stream: DataFrame, path: str, checkpoint: str, refresh: str | None = None) -> StreamingQuery:
    """Appends ``stream`` under ``path``; ``refresh`` is the least time between generations, or all at once and stop."""

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/generation={number:012d}")

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=refresh) if refresh else writer.trigger(availableNow=True)).start()


def read(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """What was ingested up to a generation (all of it by default)."""
    rows = spark.read.parquet(path)
    return rows if generation is None else rows.where(F.col("generation") <= generation)


def generations(spark: SparkSession, path: str) -> DataFrame:
    """``(generation, rows)``: how many rows each generation brought."""
    return spark.read.parquet(path).groupBy("generation").agg(F.count("*").alias("rows"))


def wait_for(spark: SparkSession, path: str, generation: int, seconds: float, query: StreamingQuery | None = None) -> bool:
    """Whether a generation was complete within so many seconds; what ended the ``query`` with an error is raised."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/generation={generation:012d}/_SUCCESS")
    files, end = done.getFileSystem(spark._jsc.hadoopConfiguration()), monotonic() + seconds
    while not files.exists(done):
        if query is not None and query.exception() is not None:
            raise query.exception()
        if monotonic() >= end:
            return False
        sleep(0.1)
    return True


def windowed_facets(stream: DataFrame, time: str, dim: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of labels in tumbling windows, with a watermark for late rows (an extension)."""
    timed = stream.withWatermark(time, late) if stream.isStreaming else stream
    counted = timed.groupBy(F.window(time, length).alias("w"), F.col(dim).alias("label")).agg(F.count("*").alias("count"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "label", "count")
