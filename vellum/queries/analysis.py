"""Text analysis and highlighting over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import analysis, stemming
from vellum.operators import highlight
from vellum.operators.search import Constant, Term, search, top
from vellum.queries import query, table

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(rf"SELECT doc_id, i - 1 AS position, t[i] AS token FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, {_TOK} AS t FROM documents))")
def analyze_standard(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(analysis.standard(F.col("text"))).alias("position", "token")).withColumn("position", F.col("position").cast("long"))


@query(
    rf"SELECT doc_id, i - 1 AS position, t[i] AS token FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, {_TOK} AS t FROM documents)) "
    f"WHERE NOT list_contains([{', '.join(repr(w) for w in analysis.ENGLISH_STOP)}], t[i])"
)
def analyze_stop_positions(spark, sf):
    kept = analysis.with_positions(analysis.standard(F.col("text")), analysis.ENGLISH_STOP)
    return table(spark, sf, "documents").select("doc_id", F.inline(kept)).withColumn("position", F.col("position").cast("long"))


@query(
    r"""SELECT token, count(*) AS n FROM (SELECT unnest(flatten(list_transform(t, lambda w: flatten(list_transform([2, 3], lambda k: CASE WHEN length(w) >= k
      THEN list_transform(range(1, length(w) - k + 2), lambda i: w[i:i + k - 1]) ELSE [] END))))) AS token
    FROM (SELECT regexp_extract_all(lower(p_name || ' ' || p_type), '[\p{L}\p{N}]+') AS t FROM part)) GROUP BY 1"""
)
def analyze_ngrams(spark, sf):
    words = analysis.standard(F.concat_ws(" ", "p_name", "p_type"))
    return table(spark, sf, "part").select(F.explode(analysis.ngrams(words, 2, 3)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(
    rf"""SELECT token, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS token
    FROM (SELECT {_TOK} AS t FROM documents)) GROUP BY 1 HAVING count(*) > 20"""
)
def analyze_shingles(spark, sf):
    return table(spark, sf, "documents").select(F.explode(analysis.shingles(analysis.standard(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 20")


@query(
    r"""SELECT page_id, CAST(length(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS BIGINT) AS size FROM (SELECT page_id, replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)\b[^>]*>.*?</(script|style)\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS x FROM pages)"""
)
def html_strip(spark, sf):
    text = F.trim(F.regexp_replace(analysis.strip_html(F.col("html")), r"\s+", " "))
    return table(spark, sf, "pages").select("page_id", F.length(text).cast("long").alias("size"))


@query(
    rf"""SELECT doc_id, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, list_filter(string_split(replace(replace(chr(31) || array_to_string({_TOK}, chr(31) || chr(31)) || chr(31),
      chr(31) || 'of' || chr(31) || chr(31) || 'the' || chr(31), chr(31) || 'ofthe' || chr(31)), chr(31) || 'with' || chr(31), chr(31) || 'by' || chr(31)), chr(31)), lambda x: x <> '') AS t FROM documents)"""
)
def synonyms(spark, sf):
    words = analysis.synonyms(analysis.standard(F.col("text")), {"of the": "ofthe", "with": "by"})
    return table(spark, sf, "documents").select("doc_id", F.array_join(words, " ").alias("tokens"))


@query(
    r"""SELECT stem, count(*) AS n FROM (SELECT CASE WHEN length(t) > 5 THEN regexp_replace(t, '(ations?|ingly|edly|ings?|ness|ments?|ers?|ed|ly|es|s)$', '') ELSE t END AS stem
    FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM documents WHERE lang = 'en')) GROUP BY 1"""
)
def analyze_english_stem(spark, sf):
    words = analysis.light_stem(analysis.standard(F.col("text")), "en")
    return table(spark, sf, "documents").where("lang = 'en'").select(F.explode(words).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


@query(
    rf"""WITH h AS (SELECT doc_id, text FROM documents WHERE list_contains({_TOK}, 'from') ORDER BY doc_id LIMIT 10)
    SELECT doc_id, regexp_replace(text, '\b(from)\b', '<b>\1</b>', 'gi') AS shown FROM h"""
)
def highlight_whole(spark, sf):
    hits = top(search(table(spark, sf, "documents"), Constant(Term("text", "from"))), 10)
    return hits.select("doc_id", highlight.marked(F.col("text"), lambda t: t == "from").alias("shown"))


@query(None)
def highlight_snippets(spark, sf):
    hits = top(search(table(spark, sf, "documents"), Term("text", "with")), 10)
    return hits.select("doc_id", F.inline(highlight.snippets(F.col("text"), lambda t: t == "with")))


@query(None)
def analyze_porter_stem(spark, sf):
    tokens = table(spark, sf, "documents").where("lang = 'en'").select(F.explode(analysis.standard(F.col("text"))).alias("token"))
    return stemming.english(tokens, "token").groupBy("stem").agg(F.count("*").alias("n"))
