"""Terms, scores and boolean combinations over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions.analysis import standard
from vellum.operators.search import Boolean, Boost, Constant, DisMax, MatchAll, Range, Similarity, Term, Where, common_terms, multi_field, search, top, words_of
from vellum.plans import postings
from vellum.queries import query, scratch, table

_TOK = r"t AS (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS tok FROM documents), s AS (SELECT CAST(count(tok) AS DOUBLE) AS n, avg(len(tok)) AS avgdl FROM t)"


def _tf(word: str) -> str:
    return f"len(list_filter(tok, lambda x: x = '{word}'))"


def _bm25(word: str) -> str:
    """Score of a word, 0 where it is absent."""
    df = f"(SELECT CAST(count(*) AS DOUBLE) FROM t WHERE list_contains(tok, '{word}'))"
    return f"(ln(1 + (s.n - {df} + 0.5) / ({df} + 0.5)) * {_tf(word)} / ({_tf(word)} + 1.2 * (0.25 + 0.75 * len(tok) / s.avgdl)))"


def _has(word: str) -> str:
    return f"list_contains(tok, '{word}')"


def _round(hits):
    return hits.withColumn("score", F.round("score", 6))


@query(rf"WITH {_TOK} SELECT doc_id, round({_bm25('the')}, 6) AS score FROM t, s WHERE {_has('the')}")
def term_query_match(spark, sf):
    return _round(search(table(spark, sf, "documents"), Term("text", "the"), keep=["doc_id"]))


@query(
    rf"WITH {_TOK} SELECT doc_id, round({_bm25('the')} + {_bm25('and')}, 6) AS score FROM t, s WHERE lang = 'en' AND ({_has('the')} OR {_has('and')}) "
    rf"ORDER BY {_bm25('the')} + {_bm25('and')} DESC, doc_id LIMIT 10"
)
def bm25_top10(spark, sf):
    hits = search(table(spark, sf, "documents"), Boolean(should=[Term("text", "the"), Term("text", "and")]), keep=["doc_id"], where=F.col("lang") == "en")
    return _round(top(hits))


@query(
    rf"WITH {_TOK}, d AS (SELECT (SELECT count(*) FROM t WHERE {_has('the')}) AS df) "
    rf"SELECT doc_id, round(sqrt({_tf('the')}) * (ln((s.n + 1) / (d.df + 1)) + 1) / sqrt(len(tok)), 6) AS score FROM t, s, d WHERE {_has('the')} "
    rf"ORDER BY sqrt({_tf('the')}) / sqrt(len(tok)) DESC, doc_id LIMIT 10"
)
def tfidf_top10(spark, sf):
    return _round(top(search(table(spark, sf, "documents"), Term("text", "the"), similarity=Similarity("tfidf"), keep=["doc_id"])))


@query(
    rf"WITH {_TOK}, d AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM t WHERE {_has('of')}) AS df) "
    rf"SELECT doc_id, round(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * {_tf('of')} / ({_tf('of')} + 1.2), 6) AS score FROM t, s, d WHERE {_has('of')}"
)
def bm25_without_norms(spark, sf):
    return _round(search(table(spark, sf, "documents"), Term("text", "of"), similarity=Similarity(norms=False), keep=["doc_id"]))


@query(
    rf"WITH {_TOK} SELECT doc_id, round({_bm25('the')} + {_bm25('with')}, 6) AS score FROM t, s "
    rf"WHERE {_has('the')} AND {_has('of')} AND NOT {_has('nicht')} AND n_chars BETWEEN 200 AND 4000"
)
def bool_must_should_not_filter(spark, sf):
    q = Boolean(must=[Term("text", "the")], should=[Term("text", "with")], filter=[Term("text", "of"), Range("n_chars", 200, 4000)], must_not=[Term("text", "nicht")])
    return _round(search(table(spark, sf, "documents"), q, keep=["doc_id"]))


_FOUR = ["the", "with", "from", "this"]


@query(
    rf"WITH {_TOK} SELECT doc_id, round({' + '.join(map(_bm25, _FOUR))}, 6) AS score FROM t, s "
    rf"WHERE {' + '.join(f'CAST({_has(w)} AS INT)' for w in _FOUR)} >= 3"
)
def bool_min_should_match(spark, sf):
    return _round(search(table(spark, sf, "documents"), Boolean(should=[Term("text", w) for w in _FOUR], minimum=3), keep=["doc_id"]))


@query("SELECT doc_id, 0.0 AS score FROM documents WHERE false")
def bool_only_negative(spark, sf):
    return search(table(spark, sf, "documents"), Boolean(must_not=[Term("text", "the")]), keep=["doc_id"])


_EIGHT = ["the", "of", "and", "in", "with", "from", "is", "this"]


@query(rf"WITH {_TOK} SELECT doc_id, round({' + '.join(map(_bm25, _EIGHT))}, 6) AS score FROM t, s WHERE {' OR '.join(map(_has, _EIGHT))} ORDER BY {' + '.join(map(_bm25, _EIGHT))} DESC, doc_id LIMIT 20")
def bool_eight_clauses(spark, sf):
    return _round(top(search(table(spark, sf, "documents"), Boolean(should=[Term("text", w) for w in _EIGHT]), keep=["doc_id"]), 20))


@query(
    rf"WITH {_TOK}, x AS (SELECT doc_id, {_bm25('the')} AS a, {_bm25('de')} AS b FROM t, s WHERE {_has('the')} OR {_has('de')}) "
    "SELECT doc_id, round(greatest(a, b) + 0.3 * (a + b - greatest(a, b)), 6) AS score FROM x"
)
def dismax_tiebreak(spark, sf):
    return _round(search(table(spark, sf, "documents"), DisMax([Term("text", "the"), Term("text", "de")], 0.3), keep=["doc_id"]))


@query(rf"WITH {_TOK} SELECT doc_id, 10.0 AS score FROM t WHERE {_has('with')}")
def constant_score(spark, sf):
    return search(table(spark, sf, "documents"), Constant(Term("text", "with"), 10.0), keep=["doc_id"])


@query(rf"WITH {_TOK} SELECT doc_id, round({_bm25('the')} + 2.5 * {_bm25('is')}, 6) AS score FROM t, s WHERE {_has('the')} OR {_has('is')}")
def boosted_terms(spark, sf):
    return _round(search(table(spark, sf, "documents"), Boolean(should=[Term("text", "the"), Boost(Term("text", "is"), 2.5)]), keep=["doc_id"]))


@query("SELECT doc_id, 1.0 AS score FROM documents ORDER BY doc_id LIMIT 5 OFFSET 10")
def match_all_page(spark, sf):
    return top(search(table(spark, sf, "documents"), MatchAll(), keep=["doc_id"]), 5, offset=10)


@query("SELECT doc_id, 1.0 AS score FROM labels WHERE toxic = 1")
def boolean_field(spark, sf):
    labels = table(spark, sf, "labels").withColumn("is_toxic", F.col("toxic") == 1)
    return search(labels, Where(F.col("is_toxic")), fields={}, keep=["doc_id"])


@query(
    rf"WITH {_TOK} SELECT doc_id, round({_bm25('theasthe')} + {_bm25('onhe')} + CASE WHEN {_has('theasthe')} OR {_has('onhe')} THEN {_bm25('the')} ELSE 0 END, 6) AS score "
    rf"FROM t, s WHERE {_has('theasthe')} OR {_has('onhe')}"
)
def common_terms_query(spark, sf):
    docs = table(spark, sf, "documents")
    words = ["the", "theasthe", "onhe"]
    counted = postings.frequencies(docs).where(F.col("term").isin(words)).collect()  # at most a row a word
    return _round(search(docs, common_terms({r.term: r.df for r in counted}, "text", words, docs.count(), 0.3), keep=["doc_id"]))


@query(rf"WITH {_TOK} SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, count(*) AS tf FROM (SELECT doc_id, unnest(tok) AS term FROM t) GROUP BY 1")
def term_statistics(spark, sf):
    return postings.frequencies(table(spark, sf, "documents"))


@query(rf"WITH {_TOK} SELECT doc_id, round({_bm25('with')} + {_bm25('from')}, 6) AS score FROM t, s WHERE {_has('with')} AND {_has('from')}")
def kept_index_all_terms(spark, sf):
    index = postings.Index.build(table(spark, sf, "documents"), scratch(spark), parts=8)
    return _round(index.search(["with", "from"], all_=True))


@query(
    r"""WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+') || regexp_extract_all(lower(p_type), '[\p{L}\p{N}]+') AS tok FROM part)
    SELECT p_partkey FROM t WHERE list_contains(tok, 'ring') AND list_contains(tok, 'economy')"""
)
def multi_field_all_words(spark, sf):
    return search(table(spark, sf, "part"), Constant(multi_field(["p_name", "p_type"], ["ring", "economy"], all_=True)), fields={"p_name": standard, "p_type": standard}, keep=["p_partkey"]).select("p_partkey")



@query(rf"WITH {_TOK} SELECT doc_id, round({_bm25('with')} + {_bm25('from')} + {_bm25('not')}, 6) AS score FROM t, s WHERE {_has('with')} OR {_has('from')} OR {_has('not')}")
def text_words_any(spark, sf):
    return _round(search(table(spark, sf, "documents"), words_of("text", "With, from -- NOT with!"), keep=["doc_id"]))


@query(rf"WITH {_TOK} SELECT doc_id, round({_bm25('with')} + {_bm25('from')}, 6) AS score FROM t, s WHERE {_has('with')} AND {_has('from')}")
def text_words_all(spark, sf):
    return _round(search(table(spark, sf, "documents"), words_of("text", "from (With)", all_=True), keep=["doc_id"]))
