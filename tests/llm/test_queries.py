"""The registered queries: SQL where there is some, contracts, and the pipeline step by step."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.test_entry import TABLES, normal
from vellum.llm import queries

from .conftest import SF
from .test_dedup import brute
from .test_texts import brute_hits, check_packing

CONTRACT = {
    1: ["doc_id", "n_shingles", "component_id"],
    3: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    4: ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    5: ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    7: ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    8: ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    9: ["vec_id", "n_links", "component_id", "kept"],
    10: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
}


def test_each_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("n", sorted(CONTRACT))
def test_columns(spark, n):
    name = next(x for x in queries.queries() if x.startswith(f"op{n}_"))
    columns = queries.queries()[name](spark, SF).columns
    assert columns[: len(CONTRACT[n])] == CONTRACT[n]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert normal(queries.queries()[name](spark, SF).toPandas()) == normal(con.execute(queries.oracle_sql()[name]).df())


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    empty = spark.createDataFrame([(10**9, "...", "en", "src0", 3), (10**9 + 1, None, "en", None, 0)], docs.schema)
    docs = docs.unionByName(empty)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "pii", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SF).cache()
        if name == "language_id":
            assert ids(docs) == sorted(r.doc_id for r in before if r.doc_id < 10**9)
        if name == "ngram_jaccard":
            assert ids(docs) == sorted(i for i, (_, root) in brute([(r.doc_id, r.text) for r in before]).items() if root == i)
        if name == "decontamination":
            assert ids(docs) == sorted(i for i, *_, hit in brute_hits([(r.doc_id, r.text) for r in before], bench) if not hit)
        if name == "pii":
            assert ids(docs) == sorted(r.doc_id for r in before)
            assert docs.where(F.col("text").contains("@mail")).count() == 0
        if name != "best_fit_packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    check_packing(docs.collect())
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before}


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
