"""What the stages of the pipeline leave in the Python workers, which all later stages share."""

import os
import subprocess
import sys

import pyspark

import corpus_pipeline
from vellum.llm import language_id

#: Works through texts as a task does and tells the MB that the process has more afterwards.
GROWN = """
import random, re
import pyarrow as pa
from vellum.llm import ngram_jaccard

class Task:
    get = classmethod(lambda cls: cls())
    partitionId = lambda self: 0

def mb():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

ngram_jaccard.TaskContext = Task
r = random.Random(1)
words = [f"w{i}" for i in range(20_000)]
def batches():
    for lo in range(0, 4_000, 1_000):
        texts = [" ".join(r.choices(words, k=500)).encode() for _ in range(1_000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(lo, lo + 1_000), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "text"])
before = mb()
for out in WHAT(batches()):
    pass
del out
print(mb() - before)
"""


def grown(what: str) -> float:
    env = os.environ | {"PYTHONHASHSEED": "0", "PYTHONPATH": os.path.dirname(corpus_pipeline.__file__)}
    return float(subprocess.run([sys.executable, "-c", GROWN.replace("WHAT", what)], env=env, capture_output=True, text=True, check=True).stdout)


def test_workers_give_memory_back():
    assert grown("ngram_jaccard._entries(50)") < 45
    assert grown("ngram_jaccard._sets") < 45


def test_languages_need_no_workers_beside_those_of_the_batches(docs, monkeypatch):
    """Rows given as a list go through an RDD, whose Python workers are apart from those of DataFrames and stay."""

    def no(*_, **__):
        raise AssertionError("an RDD of Python rows")

    monkeypatch.setattr(pyspark.SparkContext, "parallelize", no)
    assert language_id.keep_identified(docs, host="source").count() > 0


def test_stages_read_texts_in_small_batches(spark, docs):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "4096")
        corpus_pipeline.personal_data(spark, docs, "")
        assert int(spark.conf.get(key)) <= 512
    finally:
        spark.conf.set(key, before)
