"""Parents and children, results of several tables, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import blockjoin, changes, suggest
from vellum.queries import query, table

_BIG = "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45"


def _lift(mode: str, sql: str):
    def run(spark, sf):
        children = table(spark, sf, "lineitem").where("l_quantity > 45").withColumn("score", F.col("l_quantity"))
        parents = table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
        out = blockjoin.to_parent(parents, children, "o_orderkey", "l_orderkey", mode)
        return out.withColumn("score", F.round("score", 6))

    run.__name__ = f"block_join_{mode}"
    query(
        f"SELECT o_orderkey, round(CAST({sql} AS DOUBLE), 6) AS score, count(*) AS child_hits FROM orders JOIN ({_BIG}) ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY 1"
    )(run)


_lift("max", "max(l_quantity)")
_lift("avg", "avg(l_quantity)")
_lift("total", "sum(l_quantity)")
_lift("none", "0")


@query(
    """SELECT conv_id AS parent, string_agg(turn || ':' || length(text), ',' ORDER BY place) AS hits FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS place FROM conversations WHERE role = 'assistant') WHERE place <= 2 GROUP BY 1"""
)
def block_join_child_hits(spark, sf):
    turns = table(spark, sf, "conversations").where("role = 'assistant'").withColumn("size", F.length("text"))
    hits = blockjoin.child_hits(turns, "conv_id", [F.desc("size"), F.col("turn")], 2, ["turn", "size"])
    return hits.select("parent", F.array_join(F.transform("hits", lambda x: F.concat_ws(":", x["turn"], x["size"])), ",").alias("hits"))


@query("SELECT conv_id FROM conversations WHERE role = 'system' AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn >= 4)")
def semi_and_anti(spark, sf):
    turns = table(spark, sf, "conversations")
    return turns.where("role = 'system'").select("conv_id").join(turns.where("turn >= 4"), "conv_id", "left_anti")


@query(
    """SELECT id, size, part FROM (SELECT doc_id AS id, length(text) AS size, 0 AS part FROM documents UNION ALL SELECT page_id, length(html), 1 FROM pages)
    ORDER BY size DESC, id, part LIMIT 15"""
)
def multi_index_merge(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("size"))
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.length("html").alias("size"))
    return changes.merge_top([docs, pages], [F.desc("size"), F.col("id")], 15)


def _parts(spark, sf):
    return suggest.from_rows(table(spark, sf, "part"), F.col("p_name"), F.round(F.col("p_retailprice") * 100), F.col("p_brand"), F.array("p_type"))


_E = "e AS (SELECT p_name AS text, max(CAST(round(p_retailprice * 100) AS BIGINT)) AS weight, arg_max(p_brand, (CAST(round(p_retailprice * 100) AS BIGINT), p_brand, [p_type])) AS payload, arg_max([p_type], (CAST(round(p_retailprice * 100) AS BIGINT), p_brand, [p_type])) AS contexts FROM part WHERE p_name IS NOT NULL GROUP BY 1)"
_N = r"array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ')"


@query(f"WITH {_E} SELECT text, weight, payload FROM e WHERE starts_with({_N}, 'small r') ORDER BY lower(text) = 'small r' DESC, weight DESC, text LIMIT 8")
def suggest_prefix(spark, sf):
    return suggest.by_prefix(_parts(spark, sf), "Small r", 8)


@query(
    rf"WITH {_E}, k AS (SELECT *, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS tok FROM e) "
    "SELECT text, weight, payload FROM k WHERE list_contains(tok, 'red') AND len(list_filter(tok, lambda x: starts_with(x, 'g'))) > 0 ORDER BY weight DESC, text LIMIT 6"
)
def suggest_infix(spark, sf):
    return suggest.by_infix(_parts(spark, sf), "red g", 6)


@query(
    f"""WITH {_E} SELECT text, weight, payload FROM e WHERE starts_with({_N}, 's') AND list_min(list_transform([5, 6, 7], lambda k: levenshtein({_N}[1:k], 'smll r'))) <= 1
    ORDER BY lower(text) = 'smll r' DESC, weight DESC, text LIMIT 5"""
)
def suggest_fuzzy(spark, sf):
    return suggest.fuzzy(_parts(spark, sf), "smll r", 5)


@query(
    f"WITH {_E}, c AS (SELECT max(p_type) AS x FROM part) SELECT text, weight, payload FROM e, c WHERE starts_with({_N}, 's') AND list_contains(contexts, x) ORDER BY lower(text) = 's' DESC, weight DESC, text LIMIT 5"
)
def suggest_context(spark, sf):
    first = table(spark, sf, "part").agg(F.max("p_type")).first()[0]
    return suggest.by_prefix(_parts(spark, sf), "s", 5, contexts=[first])


@query(
    rf"""WITH {_E}, q AS (SELECT DISTINCT p_name[1:5] AS typed FROM part),
    r AS (SELECT typed, text, weight, CAST(row_number() OVER (PARTITION BY typed ORDER BY weight DESC, text) AS INTEGER) AS place FROM q JOIN e ON starts_with({_N}, trim(typed)))
    SELECT typed, place, text, weight FROM r WHERE place <= 3"""
)
def suggest_completions(spark, sf):
    typed = table(spark, sf, "part").select(F.substring("p_name", 1, 5).alias("typed"))
    return suggest.completions(_parts(spark, sf), typed, 3)
