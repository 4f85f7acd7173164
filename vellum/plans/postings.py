"""A kept index: postings, lengths and term statistics as Parquet tables.

Postings are clustered by a hash of the term and sorted by term in each file, so
a query for some terms reads the row groups whose minima and maxima fit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import analysis
from vellum.operators.search import Similarity


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", analyzer=analysis.standard) -> DataFrame:
    """``(term, doc_id, freq, positions, dl)``.

    Words of a text are grouped in its own row before they are dealt out: the
    only shuffle of an index build is the one that clusters by term.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), analyzer(F.col(text_col)).alias("tok")).where(F.size("tok") > 0)
    each = rows.select("doc_id", F.size("tok").alias("dl"), F.posexplode("tok").alias("position", "term"))
    return each.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("freq"), F.sort_array(F.collect_list("position")).alias("positions"))


def frequencies(docs: DataFrame, text_col: str = "text", analyzer=analysis.standard) -> DataFrame:
    """``(term, df, tf)`` of all texts; counts combine before the shuffle."""
    tok = docs.select(analyzer(F.col(text_col)).alias("tok"))
    every = F.transform("tok", lambda t: F.struct(t.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("tf")))
    once = F.transform(F.array_distinct("tok"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("tf")))
    return tok.select(F.explode(F.concat(every, once)).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"), F.sum("x.tf").alias("tf"))


@dataclass
class Index:
    """An index on disk: ``postings``, ``lengths``, ``terms``."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(docs: DataFrame, path: str, parts: int = 64, **columns) -> Index:
        spark = docs.sparkSession
        found = postings(docs, **columns)
        found.repartition(parts, "term").sortWithinPartitions("term", "doc_id").select("term", "doc_id", "freq", "positions", "dl").write.mode("overwrite").parquet(f"{path}/postings")
        kept = spark.read.parquet(f"{path}/postings")
        kept.groupBy("term").agg(F.count("*").alias("df"), F.sum("freq").alias("tf")).write.mode("overwrite").parquet(f"{path}/terms")
        kept.groupBy("doc_id").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/stats")
        return Index(spark, path)

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    @property
    def stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/stats")

    def search(self, terms: list[str], all_: bool = False, similarity: Similarity | None = None) -> DataFrame:
        """``(doc_id, score)`` of texts with any or all of the terms: one shuffle, by document."""
        sim = similarity or Similarity()
        wanted = F.col("term").isin(terms)
        df = F.broadcast(self.terms.where(wanted).select("term", "df"))  # at most a row a term
        rows = self.postings.where(wanted).join(df, "term").crossJoin(F.broadcast(self.stats))
        one = sim.score(F.col("freq").cast("double"), sim.idf(F.col("docs").cast("double"), F.col("df").cast("double")), F.col("dl").cast("double"), F.col("avgdl"))
        found = rows.groupBy("doc_id").agg(F.sum(one).alias("score"), F.count("*").alias("n"))
        return (found.where(F.col("n") == len(set(terms))) if all_ else found).select("doc_id", "score")

    def expand(self, condition: Column, most: int | None = None, order: list[Column] = ()) -> DataFrame:
        """Terms of the dictionary that a condition on ``term`` accepts; ``most`` limits by ``order``, as expansions do."""
        found = self.terms.where(condition)
        return found.orderBy(*order, "term").limit(most) if most else found

    def containing(self, terms: DataFrame) -> DataFrame:
        """Ids of texts that hold one of the terms of a table."""
        return self.postings.join(terms.select("term"), "term", "left_semi").select("doc_id").distinct()
