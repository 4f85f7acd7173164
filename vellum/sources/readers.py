"""Reading documents: JSON lines, blocks of parents with children, delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """One JSON document a line. Strict reading raises at a malformed one; else it is kept in ``_corrupt``."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(wide).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def delimited(spark: SparkSession, path: str, schema: T.StructType, separator: str = ",", strict: bool = True) -> DataFrame:
    """Delimited text with a header: quoted cells with doubled quotes, separators and newlines in them; an empty cell is missing.

    Columns come in the order of the header, which has to name fields of the
    schema. A cell of a ``struct<lat, lon>`` is ``lat;lon``.
    """
    names = spark.read.csv(path, sep=separator, header=True, quote='"', escape='"', multiLine=True).columns
    unknown = [n for n in names if n not in schema.fieldNames()]
    if unknown:
        raise ValueError(f"header > {unknown[0]}: unknown field; it must be one of {sorted(schema.fieldNames())}")
    point = {f.name for f in schema.fields if isinstance(f.dataType, T.StructType)}
    raw = T.StructType([T.StructField(n, T.StringType() if n in point else schema[n].dataType) for n in names])
    corrupt = [] if strict else [T.StructField("_corrupt", T.StringType())]
    rows = spark.read.schema(T.StructType([*raw.fields, *corrupt])).csv(
        path, sep=separator, header=True, quote='"', escape='"', multiLine=True, enforceSchema=True, mode="FAILFAST" if strict else "PERMISSIVE", columnNameOfCorruptRecord="_corrupt"
    )
    for n in names:
        if n in point:
            parts = F.split(n, ";")
            rows = rows.withColumn(n, F.when(F.col(n).isNotNull(), F.struct(F.get(parts, F.lit(0)).cast("double").alias("lat"), F.get(parts, F.lit(1)).cast("double").alias("lon"))))
    return rows


def blocks(rows: DataFrame, children: str = "children", key: str = "parent_id") -> tuple[DataFrame, DataFrame]:
    """Rows that hold an array of children to parents and children, tied by ``key``."""
    parents = rows.drop(children)
    return parents, rows.select(F.col(key), F.posexplode(children).alias("place", "child")).select(key, "place", "child.*")


def dates(value, pattern: str):
    """A date by a pattern, in UTC; single-digit months and days are accepted as well. Null if it is none."""
    lenient = pattern.replace("MM", "M").replace("dd", "d").replace("HH", "H")
    return F.coalesce(F.try_to_timestamp(value, F.lit(pattern)), F.try_to_timestamp(value, F.lit(lenient)))
