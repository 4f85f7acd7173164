"""Updates, deletes and snapshots over a log of order changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import changes
from vellum.queries import query, table

_LOG = """log AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderkey AS seq, false AS deleted FROM orders
  UNION ALL SELECT o_orderkey, o_totalprice * 2, o_orderkey + 1000000, false FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey, NULL, o_orderkey + 2000000, true FROM orders WHERE o_orderkey % 15 = 0)"""
_LIVE = "SELECT k, price FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM log {where}) WHERE r = 1 AND NOT deleted"


def _log(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    first = orders.select("k", "price", F.col("k").alias("seq"), F.lit(False).alias("deleted"))
    new = orders.where("k % 5 = 0").select("k", (F.col("price") * 2).alias("price"), (F.col("k") + 1000000).alias("seq"), F.lit(False).alias("deleted"))
    gone = orders.where("k % 15 = 0").select("k", F.lit(None).cast("double").alias("price"), (F.col("k") + 2000000).alias("seq"), F.lit(True).alias("deleted"))
    return first.union(new).union(gone)


@query(f"WITH {_LOG} {_LIVE.format(where='')}")
def upsert_latest(spark, sf):
    return changes.live(_log(spark, sf), "k").select("k", "price")


@query(f"WITH {_LOG} {_LIVE.format(where='WHERE seq <= 1500000')}")
def snapshot_read(spark, sf):
    return changes.live(_log(spark, sf), "k", version=1_500_000).select("k", "price")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def delete_by_term(spark, sf):
    return changes.delete_by_terms(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey")


@query(
    """SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, 0.0 FROM customer WHERE c_custkey % 10 = 0"""
)
def upsert_batch(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    new = rows.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0))
    return changes.upsert(rows, new, "c_custkey")
