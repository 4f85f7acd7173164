"""Queries over documents: matching and relevance as columns of one plan.

A query is a small tree of objects. ``search`` turns it into one DataFrame plan:
texts are analysed once a scan; every leaf becomes an expression over the token
array of its row, so a boolean query with many clauses needs no join and no
shuffle; the corpus statistics that scores need (documents with the field, mean
length, documents with each term) are one aggregate of a scan of its own, a single
row that is joined back. Filters on plain columns come before the analysis and
reach the scan; filters on matches stay above it (``once``), else the optimizer
would repeat the analysis in each of them. Single terms are counted in the tokens
that some clause asks for, which are few.

For many queries over the same texts, ``vellum.plans.postings`` keeps an index.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import analysis

K1, B = 1.2, 0.75


@dataclass
class Similarity:
    """BM25, or classic TF-IDF; without norms every text counts as of average length."""

    kind: str = "bm25"
    k1: float = K1
    b: float = B
    norms: bool = True

    def score(self, freq: Column, idf: Column, dl: Column, avgdl: Column) -> Column:
        if self.kind == "tfidf":
            return F.sqrt(freq) * idf / (F.sqrt(dl) if self.norms else F.lit(1.0))
        length = 1 - self.b + self.b * dl / avgdl if self.norms else F.lit(1.0)
        return idf * freq / (freq + self.k1 * length)

    def idf(self, n: Column, df: Column) -> Column:
        if self.kind == "tfidf":
            return F.ln((n + 1) / (df + 1)) + 1
        return F.ln(1 + (n - df + 0.5) / (df + 0.5))


class Context:
    """Names the columns that a plan gives to tokens, frequencies and statistics."""

    def __init__(self, analyzers: dict, similarity: Similarity):
        self.analyzers, self.similarity = analyzers, similarity
        self.freqs: dict[str, tuple[str, Column, list[Column]]] = {}  # name -> field, frequency, terms whose idf adds up
        self.terms: dict[str, list[str]] = {}  # field -> single terms that clauses ask for

    def tokens(self, name: str) -> Column:
        return F.col(f"__tok_{name}")

    def asked(self, name: str, term: str) -> Column:
        """The tokens of a field that single terms ask for, this one among them."""
        if term not in self.terms.setdefault(name, []):
            self.terms[name].append(term)
        return F.col(f"__ask_{name}")

    def analysed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with tokens and, of fields with single terms, the tokens that are asked for."""
        for name, analyzer in self.analyzers.items():
            rows = rows.withColumn(f"__tok_{name}", once(analyzer(F.col(name))))
        for name, terms in self.terms.items():
            rows = rows.withColumn(f"__ask_{name}", once(F.filter(f"__tok_{name}", _one_of(terms))))
        return rows

    def scored(self, name: str, freq: Column, parts: list[Column]) -> tuple[Column, Column]:
        """Registers a scoring leaf; its frequency, and its score."""
        key = f"__f{len(self.freqs)}"
        self.freqs[key] = (name, freq, parts)
        idf = reduce(lambda a, b: a + b, [self.similarity.idf(F.col(f"__n_{name}"), F.col(f"{key}_df{i}")) for i in range(len(parts))])
        f = F.col(key).cast("double")
        return F.col(key), self.similarity.score(f, idf, F.col(f"__dl_{name}"), F.col(f"__avg_{name}"))


def once(value: Column) -> Column:
    """``value``, kept where it is computed: no filter or projection above repeats it."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _one_of(terms: list[str]):
    return lambda t: t.isin(terms)


def count_of(tokens: Column, term: str) -> Column:
    return F.coalesce(F.size(F.filter(tokens, lambda t: t == term)), F.lit(0))


def _shifted(tokens: Column, by: int) -> Column:
    """The array whose place i holds the token at i + by."""
    if by == 0:
        return tokens
    if by > 0:
        return F.slice(tokens, by + 1, F.greatest(F.size(tokens), F.lit(0)))
    return F.concat(F.array_repeat(F.lit(None).cast("string"), -by), tokens)


class Query:
    """A node: ``compile`` gives its match (boolean column) and its score (double)."""

    def compile(self, ctx: Context) -> tuple[Column, Column]:
        raise NotImplementedError


@dataclass
class Term(Query):
    field: str
    term: str

    def compile(self, ctx):
        asked = ctx.asked(self.field, self.term)
        freq, score = ctx.scored(self.field, count_of(asked, self.term), [F.coalesce(F.array_contains(asked, self.term), F.lit(False))])
        return freq > 0, score


@dataclass
class Phrase(Query):
    """Terms side by side. Each place takes one word or a list of alternatives; ``places`` may leave gaps.

    With slop, words may be moved by so many places altogether, each word in its
    own distance from where it would stand; frequency adds 1 / (1 + distance).
    """

    field: str
    terms: list
    slop: int = 0
    places: list[int] | None = None

    def compile(self, ctx):
        tok = ctx.tokens(self.field)
        slots = [list(t) if isinstance(t, (list, tuple)) else [t] for t in self.terms]
        places = [p - (self.places or [0])[0] for p in (self.places or range(len(slots)))]
        # shifted copies of the token array side by side: a row of the zip holds what surrounds one place
        shifts = sorted({p + d for p in places for d in range(-self.slop, self.slop + 1)})
        around = F.arrays_zip(*[_shifted(tok, k).alias(f"s{k}") for k in shifts])

        def at(x: Column, k: int, words: list[str]) -> Column:
            return F.coalesce(x[f"s{k}"].isin(words), F.lit(False))

        if self.slop == 0:
            hits = F.filter(around, lambda x: reduce(lambda a, b: a & b, [at(x, p, w) for p, w in zip(places, slots)]))
            freq = F.coalesce(F.size(hits), F.lit(0))
        else:
            # for each place of the first word, the least total shift of the others
            def shift(x: Column, p: int, words: list[str]) -> Column:
                best = F.lit(self.slop + 1)
                for d in range(self.slop, 0, -1):
                    best = F.when(at(x, p + d, words) | at(x, p - d, words), d).otherwise(best)
                return F.when(at(x, p, words), 0).otherwise(best)

            first = F.filter(around, lambda x: at(x, 0, slots[0]))
            costs = F.transform(first, lambda x: reduce(lambda a, b: a + b, [shift(x, p, w) for p, w in list(zip(places, slots))[1:]], F.lit(0)))
            freq = F.coalesce(F.aggregate(F.filter(costs, lambda c: c <= self.slop), F.lit(0.0), lambda a, c: a + 1 / (1 + c)), F.lit(0.0))
        parts = [reduce(lambda a, b: a | b, [F.array_contains(tok, x) for x in w]) for w in slots]
        freq, score = ctx.scored(self.field, freq, [F.coalesce(p, F.lit(False)) for p in parts])
        return freq > 0, score


@dataclass
class TermMatch(Query):
    """Texts with any token that a predicate accepts; the score is constant."""

    field: str
    accepts: object
    score: float = 1.0

    def compile(self, ctx):
        return F.coalesce(F.exists(ctx.tokens(self.field), self.accepts), F.lit(False)), F.lit(float(self.score))


def Prefix(field: str, term: str, **more) -> TermMatch:
    return TermMatch(field, lambda t: t.startswith(term), **more)


def Wildcard(field: str, term: str, **more) -> TermMatch:
    """``*`` any run, ``?`` one character, backslash escapes."""
    return Regexp(field, wildcard_pattern(term), **more)


def wildcard_pattern(term: str) -> str:
    out, i = "", 0
    while i < len(term):
        c = term[i]
        if c == "\\" and i + 1 < len(term):
            i += 1
            out += "\\Q" + term[i] + "\\E"
        else:
            out += ".*" if c == "*" else "." if c == "?" else "\\Q" + c + "\\E"
        i += 1
    return out


def Regexp(field: str, pattern: str, **more) -> TermMatch:
    """The pattern has to match a whole token."""
    return TermMatch(field, lambda t: t.rlike(f"(?s)^(?:{pattern})$"), **more)


def TermRange(field: str, low: str | None = None, high: str | None = None, include_low: bool = True, include_high: bool = True, **more) -> TermMatch:
    """Tokens between two, by the order of their UTF-8 bytes."""

    def between(t: Column) -> Column:
        ok = F.lit(True)
        if low is not None:
            ok = ok & ((t >= low) if include_low else (t > low))
        if high is not None:
            ok = ok & ((t <= high) if include_high else (t < high))
        return ok

    return TermMatch(field, between, **more)


def Fuzzy(field: str, term: str, edits: int = 2, prefix: int = 0, **more) -> TermMatch:
    """Tokens within so many insertions, deletions and changes, of which the first ``prefix`` characters agree."""

    def close(t: Column) -> Column:
        near = (F.abs(F.length(t) - len(term)) <= edits) & (F.levenshtein(t, F.lit(term)) <= edits)
        return near & t.startswith(term[:prefix]) if prefix else near

    return TermMatch(field, close, **more)


@dataclass
class Where(Query):
    """A condition on plain columns (ranges, flags, geography); the score is constant."""

    condition: Column
    score: float = 1.0

    def compile(self, ctx):
        return F.coalesce(self.condition, F.lit(False)), F.lit(float(self.score))


@dataclass
class Range(Query):
    """Values of a plain column; both ends included, a missing end is open."""

    column: str
    low: object = None
    high: object = None

    def compile(self, ctx):
        ok = F.col(self.column).isNotNull()
        if self.low is not None:
            ok = ok & (F.col(self.column) >= F.lit(self.low))
        if self.high is not None:
            ok = ok & (F.col(self.column) <= F.lit(self.high))
        return ok, F.lit(1.0)


@dataclass
class MatchAll(Query):
    def compile(self, ctx):
        return F.lit(True), F.lit(1.0)


@dataclass
class Boolean(Query):
    """``must`` and ``filter`` have to match, ``must_not`` must not, and of ``should`` at least ``minimum``
    (one, if nothing else is positive). Scores of ``must`` and matching ``should`` add up."""

    must: list = field(default_factory=list)
    should: list = field(default_factory=list)
    must_not: list = field(default_factory=list)
    filter: list = field(default_factory=list)
    minimum: int = 0

    def compile(self, ctx):
        must, should = [q.compile(ctx) for q in self.must], [q.compile(ctx) for q in self.should]
        other, never = [q.compile(ctx) for q in self.filter], [q.compile(ctx) for q in self.must_not]
        if not (must or should or other):
            return F.lit(False), F.lit(0.0)
        least = max(self.minimum, 0 if must or other else 1)
        match = reduce(lambda a, b: a & b, [m for m, _ in must + other] + [~m for m, _ in never], F.lit(True))
        if least:
            match = match & (reduce(lambda a, b: a + b, [m.cast("int") for m, _ in should], F.lit(0)) >= least)
        score = reduce(lambda a, b: a + b, [F.when(m, s).otherwise(0.0) for m, s in must + should], F.lit(0.0))
        return match, score


@dataclass
class DisMax(Query):
    """The best score, and a share of the others."""

    queries: list
    tie: float = 0.0

    def compile(self, ctx):
        parts = [q.compile(ctx) for q in self.queries]
        scores = [F.when(m, s).otherwise(0.0) for m, s in parts]
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        total = reduce(lambda a, b: a + b, scores)
        return reduce(lambda a, b: a | b, [m for m, _ in parts]), best + self.tie * (total - best)


@dataclass
class Constant(Query):
    query: Query
    score: float = 1.0

    def compile(self, ctx):
        return self.query.compile(ctx)[0], F.lit(float(self.score))


@dataclass
class Boost(Query):
    query: Query
    by: float

    def compile(self, ctx):
        match, score = self.query.compile(ctx)
        return match, score * self.by


def words_of(field: str, text: str, all_: bool = False) -> Boolean:
    """Texts with any or all of the words of plain ``text``, analysed like ``analysis.standard``; there is no query language."""
    each = [Term(field, w) for w in dict.fromkeys(re.findall(r"[^\W_]+", text.lower()))]
    return Boolean(must=each) if all_ else Boolean(should=each)


@dataclass
class AnyOf(Query):
    """Texts with any of a list of terms, as dictionary queries expand to; the score is constant."""

    field: str
    terms: list[str]
    score: float = 1.0

    def compile(self, ctx):
        found = F.arrays_overlap(ctx.tokens(self.field), F.array(*[F.lit(t) for t in self.terms])) if self.terms else F.lit(False)
        return F.coalesce(found, F.lit(False)), F.lit(float(self.score))


def multi_field(fields: list[str], words: list[str], all_: bool = False) -> Boolean:
    """Each word in any of the fields; all words, or any."""
    each = [Boolean(should=[Term(f, w) for f in fields]) for w in words]
    return Boolean(must=each) if all_ else Boolean(should=each)


def common_terms(df: dict[str, float], field: str, words: list[str], total: int, cut: float, low: str = "should", high: str = "should") -> Boolean:
    """Rare words decide, common ones only add to the score.

    ``df`` are document frequencies (see ``postings.frequencies``); a word is
    common if its frequency exceeds ``cut`` (below 1 a share of ``total``).
    """
    most = cut * total if cut < 1 else cut
    common = [w for w in words if df.get(w, 0) > most]
    rare = [w for w in words if df.get(w, 0) <= most]
    part = lambda ws, how: Boolean(**{how: [Term(field, w) for w in ws]})
    if not rare:
        return part(common, high)
    return Boolean(must=[part(rare, low)], should=[part(common, high)] if common else [])


def search(
    docs: DataFrame,
    query: Query,
    fields: dict | None = None,
    similarity: Similarity | None = None,
    keep: list[str] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Matching rows of ``docs`` with their ``score``.

    ``fields`` maps text columns to analyzers (default: ``text``, standard).
    ``where`` limits which rows may match, not the statistics. ``keep`` are the
    columns to return.
    """
    fields = {"text": analysis.standard} if fields is None else fields
    ctx = Context(fields, similarity or Similarity())
    match, score = query.compile(ctx)
    used = {name for name, _, _ in ctx.freqs.values()}
    rows = ctx.analysed(docs if where is None else docs.where(where))
    if ctx.freqs:
        aggregates = [x for name in sorted(used) for x in (F.count(f"__tok_{name}").cast("double").alias(f"__n_{name}"), F.avg(F.size(f"__tok_{name}")).alias(f"__avg_{name}"))]
        for key, (_, _, parts) in ctx.freqs.items():
            aggregates += [F.count_if(p).cast("double").alias(f"{key}_df{i}") for i, p in enumerate(parts)]
        stats = ctx.analysed(docs).agg(*aggregates)  # one row
        for name in used:
            rows = rows.withColumn(f"__dl_{name}", F.size(f"__tok_{name}").cast("double"))
        rows = rows.withColumns({key: once(freq) for key, (_, freq, _) in ctx.freqs.items()}).crossJoin(F.broadcast(stats))
    return rows.where(match).withColumn("score", score).select(*(keep or docs.columns), "score")


def top(hits: DataFrame, k: int = 10, id_col: str = "doc_id", offset: int = 0) -> DataFrame:
    """The best ``k`` hits after ``offset``; ties by id."""
    ordered = hits.orderBy(F.desc("score"), id_col)
    return (ordered.offset(offset) if offset else ordered).limit(k)
