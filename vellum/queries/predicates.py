"""Phrases, dictionary queries and ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import analysis
from vellum.operators import fuzzy
from vellum.operators.search import AnyOf, Constant, Fuzzy, Phrase, Prefix, Range, Regexp, TermRange, Wildcard, search
from vellum.plans import postings
from vellum.queries import query, table

_T = r"t AS (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS tok FROM documents), s AS (SELECT CAST(count(tok) AS DOUBLE) AS n, avg(len(tok)) AS avgdl FROM t)"


def _idf(condition: str) -> str:
    df = f"(SELECT CAST(count(*) AS DOUBLE) FROM t WHERE {condition})"
    return f"ln(1 + (s.n - {df} + 0.5) / ({df} + 0.5))"


def _phrase_sql(freq: str, conditions: list[str]) -> str:
    idf = " + ".join(_idf(c) for c in conditions)
    return (
        f"WITH {_T}, f AS (SELECT doc_id, tok, {freq} AS freq FROM t) "
        f"SELECT doc_id, round(({idf}) * freq / (freq + 1.2 * (0.25 + 0.75 * len(tok) / s.avgdl)), 6) AS score FROM f, s WHERE freq > 0"
    )


def _scored(docs, q):
    return search(docs, q, keep=["doc_id"]).withColumn("score", F.round("score", 6))


@query(_phrase_sql("len(list_filter(range(1, len(tok)), lambda i: tok[i] = 'of' AND tok[i + 1] = 'the'))", ["list_contains(tok, 'of')", "list_contains(tok, 'the')"]))
def phrase_exact(spark, sf):
    return _scored(table(spark, sf, "documents"), Phrase("text", ["of", "the"]))


@query(
    _phrase_sql(
        "len(list_filter(range(1, len(tok) + 1), lambda i: tok[i] = 'of' AND i < len(tok) AND tok[i + 1] = 'the')) + 0.5 * len(list_filter(range(1, len(tok) + 1), "
        "lambda i: tok[i] = 'of' AND NOT (i < len(tok) AND tok[i + 1] = 'the') AND (i + 2 <= len(tok) AND tok[i + 2] = 'the')))",
        ["list_contains(tok, 'of')", "list_contains(tok, 'the')"],
    )
)
def phrase_slop1(spark, sf):
    return _scored(table(spark, sf, "documents"), Phrase("text", ["of", "the"], slop=1))


@query(
    _phrase_sql(
        "len(list_filter(range(1, len(tok)), lambda i: (tok[i] = 'of' OR tok[i] = 'in') AND (tok[i + 1] = 'the' OR tok[i + 1] = 'that')))",
        ["list_contains(tok, 'of') OR list_contains(tok, 'in')", "list_contains(tok, 'the') OR list_contains(tok, 'that')"],
    )
)
def multi_phrase(spark, sf):
    return _scored(table(spark, sf, "documents"), Phrase("text", [["of", "in"], ["the", "that"]]))


@query(
    _phrase_sql("len(list_filter(range(1, len(tok) - 1), lambda i: tok[i] = 'the' AND tok[i + 2] = 'of'))", ["list_contains(tok, 'the')", "list_contains(tok, 'of')"])
)
def phrase_with_gap(spark, sf):
    return _scored(table(spark, sf, "documents"), Phrase("text", ["the", "of"], places=[0, 2]))


def _any(condition: str) -> str:
    return f"WITH {_T} SELECT doc_id, 1.0 AS score FROM t WHERE len(list_filter(tok, lambda x: {condition})) > 0"


def _ids(docs, q):
    return search(docs, q, keep=["doc_id"])


@query(_any("starts_with(x, 'theas')"))
def prefix_query(spark, sf):
    return _ids(table(spark, sf, "documents"), Prefix("text", "theas"))


@query(_any("regexp_full_match(x, 'th.*n.d')"))
def wildcard_query(spark, sf):
    return _ids(table(spark, sf, "documents"), Wildcard("text", "th*n?d"))


@query(_any("regexp_full_match(x, '(an|on)+sh(er|in)')"))
def regexp_query(spark, sf):
    return _ids(table(spark, sf, "documents"), Regexp("text", "(an|on)+sh(er|in)"))


@query(_any("x > 'thz' AND x <= 'ti'"))
def term_range_query(spark, sf):
    return _ids(table(spark, sf, "documents"), TermRange("text", "thz", "ti", include_low=False))


@query(_any("levenshtein(x, 'whhen') <= 1 AND starts_with(x, 'wh')"))
def fuzzy_query_lev(spark, sf):
    return _ids(table(spark, sf, "documents"), Fuzzy("text", "whhen", edits=1, prefix=2))


@query(
    r"""WITH x AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)
    SELECT term, CAST(damerau_levenshtein(term, 'whit') AS INTEGER) AS distance FROM x WHERE regexp_full_match(term, '[a-z0-9]+') AND damerau_levenshtein(term, 'whit') <= 2 AND abs(length(term) - 4) <= 2 ORDER BY 2, 1 LIMIT 50"""
)
def fuzzy_query_damerau(spark, sf):
    terms = table(spark, sf, "documents").select(F.explode(analysis.standard(F.col("text"))).alias("term")).distinct().where(F.col("term").rlike("^[a-z0-9]+$"))
    return fuzzy.expand(terms, "whit", 2)


@query(None)
def fuzzy_expansion_all_terms(spark, sf):
    """The whole dictionary, terms of any letters; SQL counts bytes there."""
    terms = table(spark, sf, "documents").select(F.explode(analysis.standard(F.col("text"))).alias("term")).distinct()
    return fuzzy.expand(terms, "whit", 2)


@query(None)
def fuzzy_query_swaps(spark, sf):
    """Texts with any of the 50 nearest terms within two edits, a swap being one."""
    docs = table(spark, sf, "documents")
    near = fuzzy.expand(docs.select(F.explode(analysis.standard(F.col("text"))).alias("term")).distinct(), "hwit", 2)
    return search(docs, AnyOf("text", [r.term for r in near.collect()]), keep=["doc_id"])  # at most 50 terms


@query(
    r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
    e AS (SELECT DISTINCT term FROM t WHERE starts_with(term, 'thou') ORDER BY term LIMIT 20)
    SELECT DISTINCT doc_id FROM t JOIN e USING (term)"""
)
def dictionary_expansion(spark, sf):
    found = postings.postings(table(spark, sf, "documents")).select("term", "doc_id")
    terms = found.where(F.col("term").startswith("thou")).select("term").distinct().orderBy("term").limit(20)
    return found.join(F.broadcast(terms), "term", "left_semi").select("doc_id").distinct()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount >= 0.05")
def numeric_range_int(spark, sf):
    rows = search(table(spark, sf, "lineitem"), Constant(Range("l_quantity", 10, 12)), fields={}, where=F.col("l_discount") >= 0.05)
    return rows.select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 300000")
def numeric_range_open(spark, sf):
    return search(table(spark, sf, "orders"), Range("o_totalprice", 300000.0), fields={}).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-03-15'")
def datetime_range(spark, sf):
    first, last = F.to_timestamp_ntz(F.lit("1995-03-01 00:00:00")), F.to_timestamp_ntz(F.lit("1995-03-15 00:00:00"))
    return search(table(spark, sf, "orders"), Range("o_orderdate", first, last), fields={}).select("o_orderkey")
