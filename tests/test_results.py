"""Rendered values, sort values, totals, time limits, passages, kept dictionaries and generations."""

import datetime

import pytest
from pyspark.sql import functions as F

from vellum.operators import highlight, results, suggest
from vellum.operators.ordering import Key
from vellum.streaming import ingest


def test_rendered(spark):
    at = datetime.datetime(2020, 1, 2, 3, 4, 5)
    rows = spark.createDataFrame([(1, 0, at, "a", ["x"]), (2, 1, None, None, None), (3, None, at, "b", [])], "id int, yes int, at timestamp, one string, some array<string>")
    got = results.rendered(rows, ["yes"], {"at": "yyyy-MM-dd HH:mm"}, ["one", "some"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, False, "2020-01-02 03:04", ["a"], ["x"]), (2, True, None, [], []), (3, None, "2020-01-02 03:04", ["b"], [])]
    assert results.rendered(rows.where("false"), ["yes"]).count() == 0


def test_sort_values_and_totals(spark):
    rows = spark.range(5).withColumn("v", F.col("id") % 2)
    got = rows.select("id", results.sort_values([Key(F.col("v")), Key(F.col("id"))]).alias("s")).collect()
    assert all((r.s.key0, r.s.key1) == (r.id % 2, r.id) for r in got)
    assert [tuple(r) for r in results.total_hits(rows).collect()] == [(5, "EQUAL_TO")]
    assert [tuple(r) for r in results.total_hits(rows.where("false")).collect()] == [(0, "EQUAL_TO")]


def test_collation(spark):
    rows = spark.createDataFrame([("b",), ("A",), ("a",), ("B",)], "t string")
    assert [r.t.lower() for r in rows.orderBy(results.in_collation(F.col("t"))).collect()] == ["a", "a", "b", "b"]
    assert rows.groupBy(results.in_collation(F.col("t"), "UNICODE_CI")).count().count() == 2


def test_within(spark):
    assert results.within(spark, 60, lambda: spark.range(10).count()) == (10, False)
    assert results.within(spark, 0.5, lambda: spark.range(10**13).agg(F.sum(F.hash("id"))).collect()) == (None, True)
    with pytest.raises(ZeroDivisionError):
        results.within(spark, 60, lambda: 1 // 0)
    with pytest.raises(ValueError):
        results.within(spark, 0, lambda: 1)


@pytest.mark.parametrize(("breaks", "expected"), [("line", ["A dog barks. No!\n"]), ("sentence", ["A dog barks."]), ("word", ["dog "]), ("whole", ["A dog barks. No!\nEnd"]), (r"(?s).{1,6}", ["A dog "])])
def test_passages(spark, breaks, expected):
    row = spark.createDataFrame([("A dog barks. No!\nEnd",)], "text string")
    accepts = lambda t: t == "dog"
    got = row.select(highlight.snippets(F.col("text"), accepts, breaks=breaks).alias("s"), highlight.snippet_parts(F.col("text"), accepts, breaks=breaks).alias("p")).first()
    assert [s.text for s in got.s] == expected
    assert ["".join(x.text for x in p.parts) for p in got.p] == expected
    assert [[x.text for x in p.parts if x.hit] for p in got.p] == [["dog"]]


def test_kept_dictionary(spark, tmp_path):
    entries = suggest.from_rows(spark.createDataFrame([("one", 1), ("two", 2)], "t string, w int"), F.col("t"), F.col("w"))
    suggest.save(entries, str(tmp_path / "d"))
    suggest.save(entries.where("weight > 1"), str(tmp_path / "d"))
    assert [r.text for r in suggest.by_prefix(suggest.load(spark, str(tmp_path / "d")), "t").collect()] == ["two"]


def test_generations(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(7).write.parquet(source)
    query = ingest.start(spark.readStream.schema("id long").parquet(source), path, str(tmp_path / "c"))
    assert ingest.wait_for(spark, path, 0, 60, query)
    assert not ingest.wait_for(spark, path, 1, 0.2, query)
    assert [tuple(r) for r in ingest.generations(spark, path).collect()] == [(0, 7)]
    query.awaitTermination()
