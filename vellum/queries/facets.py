"""Facet counts over ``documents``, ``orders``, ``lineitem`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import scalar
from vellum.operators import facets
from vellum.queries import query, scratch, table
from vellum.streaming import ingest


@query(
    """WITH c AS (SELECT source AS label, count(*) AS count FROM documents WHERE source IS NOT NULL GROUP BY 1)
    SELECT label, count, CAST((SELECT sum(count) FROM c) AS BIGINT) AS total, (SELECT count(*) FROM c) AS child_count FROM c ORDER BY count DESC, label LIMIT 7"""
)
def facet_flat_topn(spark, sf):
    return facets.flat(table(spark, sf, "documents"), "source")


@query(
    """SELECT * FROM (VALUES (0, 'es'), (1, 'en'), (2, 'xx')) v(place, label) JOIN LATERAL (SELECT count(*) AS count FROM documents WHERE lang = label) ON true"""
)
def facet_labels(spark, sf):
    return facets.labels(table(spark, sf, "documents"), "lang", ["es", "en", "xx"])


@query(
    """WITH c AS (SELECT CAST(month(o_orderdate) AS VARCHAR) AS label, count(*) AS count FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1)
    SELECT label, count, CAST((SELECT sum(count) FROM c) AS BIGINT) AS total, (SELECT count(*) FROM c) AS child_count FROM c ORDER BY count DESC, label LIMIT 7"""
)
def facet_hierarchy_path(spark, sf):
    path = F.array(F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), F.day("o_orderdate").cast("string"))
    return facets.hierarchy(table(spark, sf, "orders"), path, ["1995"])


@query(
    """WITH m AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS p FROM orders GROUP BY 1),
    c AS (SELECT label, count(*) AS count FROM (SELECT unnest(p) AS label FROM m) GROUP BY 1)
    SELECT label, count, CAST((SELECT sum(count) FROM c) AS BIGINT) AS total, (SELECT count(*) FROM c) AS child_count FROM c ORDER BY count DESC, label LIMIT 7"""
)
def facet_multivalued(spark, sf):
    each = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("p"))
    return facets.multi_valued(each, "p")


_INT = [("low", 0, True, 10, False), ("middle", 5, True, 30, True), ("high", 30, False, None, True), ("all", None, True, None, True)]


@query(
    """SELECT place, label, count FROM (SELECT count(*) FILTER (l_quantity >= 0 AND l_quantity < 10) AS a, count(*) FILTER (l_quantity BETWEEN 5 AND 30) AS b,
      count(*) FILTER (l_quantity > 30) AS c, count(l_quantity) AS d FROM lineitem),
    LATERAL (SELECT * FROM (VALUES (0, 'low', a), (1, 'middle', b), (2, 'high', c), (3, 'all', d)) v(place, label, count))"""
)
def facet_ranges_overlap_int(spark, sf):
    return facets.ranges(table(spark, sf, "lineitem"), F.col("l_quantity"), _INT)


@query(
    """SELECT place, label, count FROM (SELECT count(*) FILTER (o_totalprice >= 1000.5 AND o_totalprice <= 150000.25) AS a, count(*) FILTER (o_totalprice > 100000) AS b FROM orders),
    LATERAL (SELECT * FROM (VALUES (0, 'a', a), (1, 'b', b)) v(place, label, count))"""
)
def facet_ranges_overlap_double(spark, sf):
    return facets.ranges(table(spark, sf, "orders"), F.col("o_totalprice"), [("a", 1000.5, True, 150000.25, True), ("b", 100000.0, False, None, True)])


@query(
    """SELECT place, label, count FROM (SELECT count(*) FILTER (v < 1000) AS a, count(*) FILTER (v >= 1000) AS b FROM (SELECT l_extendedprice * (1 - l_discount) / l_quantity AS v FROM lineitem)),
    LATERAL (SELECT * FROM (VALUES (0, 'cheap', a), (1, 'dear', b)) v(place, label, count))"""
)
def virtual_range_facet(spark, sf):
    price = scalar.divide(F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_quantity"))
    return facets.ranges(table(spark, sf, "lineitem"), price, [("cheap", None, True, 1000.0, False), ("dear", 1000.0, True, None, True)])


@query(
    """SELECT 'o_orderstatus' AS dim, o_orderstatus AS label, count(*) AS count FROM orders GROUP BY 2
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2"""
)
def facet_many_dims(spark, sf):
    return facets.many(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])



def _drills():
    return {"o_orderstatus": F.col("o_orderstatus").isin("O", "F"), "o_orderpriority": F.col("o_orderpriority") == "1-URGENT"}


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority = '1-URGENT'")
def drill_down_or_and(spark, sf):
    return facets.drill_down(table(spark, sf, "orders"), _drills()).select("o_orderkey")


@query(
    """SELECT 'o_orderstatus' AS dim, o_orderstatus AS label, count(*) AS count FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1995 GROUP BY 2
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderstatus IN ('O', 'F') AND year(o_orderdate) = 1995 GROUP BY 2
    UNION ALL SELECT 'year', '1995', count(*) FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1995"""
)
def drill_sideways(spark, sf):
    orders = table(spark, sf, "orders").where(F.year("o_orderdate") == 1995).withColumn("year", F.year("o_orderdate"))
    return facets.drill_sideways(orders, _drills(), ["o_orderstatus", "o_orderpriority", "year"])


@query(
    """WITH c AS (SELECT 'lang' AS dim, lang AS label, count(*) AS count FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY dim ORDER BY count DESC, label) AS INTEGER) AS place FROM c WHERE label IS NOT NULL) SELECT * FROM r WHERE place <= 3"""
)
def facet_top_of_each(spark, sf):
    return facets.top_of_each(facets.many(table(spark, sf, "documents"), ["lang", "source"]), 3)


@query("SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type AS label, count(*) AS count FROM events GROUP BY 1, 2, 3")
def windowed_facets(spark, sf):
    return ingest.windowed_facets(table(spark, sf, "events"), "ts", "event_type")


@query("SELECT event_type AS label, count(*) AS count FROM events GROUP BY 1")
def stream_ingest_facets(spark, sf):
    folder = scratch(spark)
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(_source(sf))
    stream = stream.where("event_type is not null")
    ingest.start(stream, f"{folder}/data", f"{folder}/state").awaitTermination()
    return ingest.read(spark, f"{folder}/data").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("count"))


def _source(sf: str) -> str:
    return f"{sf}/events.parquet*"
