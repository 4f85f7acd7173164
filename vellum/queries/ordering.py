"""Sorting, paging, grouping and computed fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import scalar
from vellum.operators.ordering import Key, page, page_after, selected, top_groups
from vellum.queries import query, table

_SPARSE = "(SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)"


def _sparse(spark, sf):
    return table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))


def _missing(name: str, order: str, **how):
    def run(spark, sf):
        return page(_sparse(spark, sf), [Key(F.col("v"), **how)], "event_id", 600)

    run.__name__ = name
    query(f"SELECT * FROM {_SPARSE} ORDER BY v {order}, event_id LIMIT 600")(run)


_missing("sort_missing_first_asc", "ASC NULLS FIRST")
_missing("sort_missing_first_desc", "DESC NULLS LAST", reverse=True)
_missing("sort_missing_last_asc", "ASC NULLS LAST", missing_last=True)
_missing("sort_missing_last_desc", "DESC NULLS FIRST", reverse=True, missing_last=True)


def _lists(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))


_MIDDLE = "list_sort(list_distinct(list(l_quantity)))"
for _how, _sql in {
    "min": "min(l_quantity)",
    "max": "max(l_quantity)",
    "middle_min": f"{_MIDDLE}[(len({_MIDDLE}) - 1) // 2 + 1]",
    "middle_max": f"{_MIDDLE}[len({_MIDDLE}) // 2 + 1]",
}.items():

    def _run(spark, sf, how=_how):
        rows = _lists(spark, sf).select("l_orderkey", selected(F.col("q"), how).alias("v"))
        return page(rows, [Key(F.col("v"), reverse=True)], "l_orderkey", 50)

    _run.__name__ = f"sort_multivalued_{_how}"
    query(f"SELECT l_orderkey, {_sql} AS v FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")(_run)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def page_offset(spark, sf):
    return page(table(spark, sf, "orders"), [Key(F.col("o_totalprice"), reverse=True)], "o_orderkey", 30, 20).select("o_orderkey", "o_totalprice")


@query(
    """WITH l AS (SELECT o_orderpriority AS p, o_totalprice AS t, o_orderkey AS k FROM orders ORDER BY 1, 2 DESC, 3 LIMIT 1 OFFSET 99)
    SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders, l WHERE o_orderpriority > p OR (o_orderpriority = p AND (o_totalprice < t OR (o_totalprice = t AND o_orderkey > k)))
    ORDER BY 2, 3 DESC, 1 LIMIT 25"""
)
def page_search_after(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    keys = [Key(F.col("o_orderpriority")), Key(F.col("o_totalprice"), reverse=True)]
    last = page(orders, keys, "o_orderkey", 100, 99).first()  # the row that a client holds
    return page_after(orders, keys, "o_orderkey", 25, [last.o_orderpriority, last.o_totalprice], last.o_orderkey)


@query(
    """WITH g AS (SELECT o_custkey, max(o_totalprice) AS best, count(*) AS group_hits FROM orders GROUP BY 1),
    f AS (SELECT o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS k FROM orders GROUP BY 1),
    r AS (SELECT g.*, CAST(row_number() OVER (ORDER BY best DESC, k) AS INTEGER) AS group_rank FROM g JOIN f USING (o_custkey)),
    h AS (SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, r.group_rank, r.group_hits, CAST(row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey) AS INTEGER) AS hit_rank
      FROM orders o JOIN r ON o.o_custkey = r.o_custkey WHERE group_rank <= 5)
    SELECT * FROM h WHERE hit_rank <= 4"""
)
def group_top_hits(spark, sf):
    keys = [Key(F.col("o_totalprice"), reverse=True)]
    return top_groups(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", keys, keys, "o_orderkey", groups=5)


@query(
    """WITH f AS (SELECT c_nationkey, min(c_acctbal) AS best, count(*) AS group_hits FROM customer GROUP BY 1),
    r AS (SELECT *, CAST(row_number() OVER (ORDER BY best, (SELECT min(c_custkey) FROM customer c WHERE c.c_nationkey = f.c_nationkey AND c.c_acctbal = best)) AS INTEGER) AS group_rank FROM f),
    h AS (SELECT c.c_custkey, c.c_nationkey, c.c_acctbal, r.group_rank, r.group_hits, CAST(row_number() OVER (PARTITION BY c.c_nationkey ORDER BY c.c_acctbal DESC, c.c_custkey) AS INTEGER) AS hit_rank
      FROM customer c JOIN r ON c.c_nationkey = r.c_nationkey WHERE group_rank BETWEEN 3 AND 6)
    SELECT * FROM h WHERE hit_rank <= 2"""
)
def group_sorted_page(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return top_groups(rows, "c_nationkey", [Key(F.col("c_acctbal"))], [Key(F.col("c_acctbal"), reverse=True)], "c_custkey", groups=4, hits=2, start=2)


@query("SELECT count(DISTINCT o_custkey) AS groups, count(*) AS hits FROM orders WHERE o_totalprice > 100000")
def group_count(spark, sf):
    return table(spark, sf, "orders").where("o_totalprice > 100000").agg(F.countDistinct("o_custkey").alias("groups"), F.count("*").alias("hits"))


@query("SELECT event_id, round(CASE WHEN value > 0 THEN ln(value) + 2 * value ELSE -1.5 END, 6) AS v FROM events WHERE value IS NOT NULL")
def virtual_field_expr(spark, sf):
    rows = table(spark, sf, "events").where("value is not null").withColumn("double_value", F.expr("2 * value"))
    return rows.select("event_id", F.round(F.when(F.col("value") > 0, scalar.ln(F.col("value")) + F.col("double_value")).otherwise(-1.5), 6).alias("v"))


@query(
    """SELECT event_id, round(value * pow(0.5, greatest(1704153600 - floor(epoch(ts)), 0) / 3600.0), 6) AS v FROM events WHERE value IS NOT NULL
    ORDER BY value * pow(0.5, greatest(1704153600 - floor(epoch(ts)), 0) / 3600.0) DESC, event_id LIMIT 20"""
)
def recency_blend(spark, sf):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    blend = F.col("value") * scalar.recency(seconds, 1704153600.0, 3600.0)
    rows = table(spark, sf, "events").where("value is not null").select("event_id", blend.alias("v"))
    return page(rows, [Key(F.col("v"), reverse=True)], "event_id", 20).withColumn("v", F.round("v", 6))


@query(
    """WITH g AS (SELECT o_custkey AS c, max(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1),
    b AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS p FROM orders)
    SELECT g.c AS o_custkey, g.n AS group_hits, g.m AS group_max_score, b.k AS o_orderkey FROM g JOIN b ON g.c = b.c AND b.p = 1 ORDER BY g.m DESC, b.k LIMIT 5"""
)
def group_max_score(spark, sf):
    price = Key(F.col("o_totalprice"), reverse=True)
    found = top_groups(table(spark, sf, "orders"), "o_custkey", [price], [price], "o_orderkey", 5, 1, score=F.col("o_totalprice"))
    return found.select("o_custkey", "group_hits", "group_max_score", "o_orderkey")
