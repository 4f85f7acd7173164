"""Personal data by weak supervision, in DataFrame functions only.

Base spans (e-mail, ip, card, phone) follow fixed rules and always stay. Other
spans are candidates: secrets, national phone numbers, identity numbers, account
numbers and titled names. Labelers (two regular expressions, a gazetteer, cues
and counter-cues in the context) vote on each candidate or abstain.
Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is; the posteriors then train the final span classifier, whose
weights for kinds and shapes of spans come from posterior-weighted counts. A
candidate is a span if the classifier says so and no base span overlaps it.

Matches are placed by the lengths of what lies before and in them: ``split`` and
``regexp_extract_all`` of the same pattern give both. Patterns are written so
that no long run of characters is tried again from within, and repeated groups
are possessive, so that very long texts neither take quadratic time nor nest.
Folds over many matches go block by block (``scan``), and pieces are cut from
chunks of the text (``cut``), so that no match costs as much as the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import fresh, materialize

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "local_phone", "id_number", "account", "name")
KINDS = BASE + EXTRA
LABELERS = ("strict", "shape", "gazetteer", "cue", "counter")
ROUNDS = 8
#: Code points before and after a candidate that cues are looked for in.
CONTEXT, AFTER = 48, 24
#: Code points of a chunk that pieces of a text are cut from.
CHUNK = 1_000

_LOCAL = r"[A-Za-z0-9._%+-]"
_DOMAIN = r"[A-Za-z0-9-]"
#: A match of ``email`` starts where a run of local characters starts, or where the last match ended.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # whole runs of digits, single separators between, that have 12 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # whole runs; those without a digit or without a letter are dropped
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
    "local_phone": r"(?<![0-9+(.-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])(?!-[0-9])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])(?!-[0-9])",
    "account": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?(?![a-z])",
}
STRICT = {
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{20,})$",
    "local_phone": r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]",
    "id_number": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "account": r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$",
    "name": r"^(?:Mrs?|Ms|Dr|Prof)\.? [A-Z][a-z]+ [A-Z][a-z]+$",
}
SHAPE = {
    "secret": r"(?:[0-9]+[A-Za-z]+){4}",
    "local_phone": r"^\([0-9]{3}\)|^[0-9]{3}([.-])[0-9]{3}\1",
    "id_number": r"^[0-8]",
    "account": r"[1-9](?:[ -]?[0-9]){3}$",
    "name": r" [A-Z][a-z]{2,}",
}
#: Frequent given names.
GIVEN_NAMES = """
    Alexander Alice Amanda Ana Andrea Andrew Anna Anne Anthony Antonio Barbara Benjamin Carlos Carmen Caroline Charles Christian
    Christine Christopher Claire Claudia Daniel David Elena Elizabeth Emily Emma Eva Francisco Frank George Hannah Hans Heather
    Helen Isabel Jack James Jane Javier Jean Jennifer Jessica Joan Johann John Jonathan Jorge Jose Joseph Juan Julia Karen Katherine
    Laura Linda Lisa Louis Lucas Luis Manuel Margaret Maria Marie Mark Martin Mary Matthew Michael Michelle Miguel Nancy Nicolas
    Nicole Oliver Pablo Patricia Patrick Paul Pedro Peter Philip Pierre Rachel Rebecca Richard Robert Ruth Samuel Sandra Sara Sarah
    Sophia Sophie Stephen Steven Susan Susanne Thomas Ursula Victor Victoria Walter William Wolfgang
""".split()
GAZETTEER = {
    "secret": r"^(?:sk|pk|ghp|gho|xox[abp]|AKIA|AIza|eyJ)",
    "local_phone": r"(?:^|[^0-9])555[^0-9]",
    "id_number": r"^(?:0[0-9]{2}|[1-7][0-9]{2})-",
    "account": r"^(?:4|5[1-5]|3[47]|6011|62)",
    "name": r" (?:" + "|".join(GIVEN_NAMES) + r")\b",
}
CUES = {
    "secret": r"(?i)(?:token|secret|api.?key|passw(?:or)?d|auth|bearer|credential)",
    "local_phone": r"(?i)(?:tel|phone|call|fax|mobile|cell)",
    "id_number": r"(?i)(?:ssn|social|security|identity|national id)",
    "account": r"(?i)(?:card|account|iban|visa|credit|acct|pay)",
    "name": r"(?i)(?:contact|dear|regards|sincerely|author|by )",
}
COUNTER = r"(?i)(?:isbn|issn|version|sha|commit|checksum|order|invoice|page|doi|hash|md5|build)"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def scan(xs: Column, state: Column, step, kind: str) -> Column:
    """What a fold over ``xs`` puts out, as ``array<kind>``.

    ``step(state, x)`` gives the next state and an array of what is put out. The
    fold goes through blocks of about the root of the size, so that what was put
    out is copied as often as there are blocks, not once for each element.
    """
    none = F.array().cast(f"array<{kind}>")

    def both(state: Column, out: Column) -> Column:
        return F.struct(state.alias("state"), out.alias("out"))

    def blocks(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda b: F.slice(v, b * width + 1, width))

    def one(acc: Column, x: Column) -> Column:
        after, more = step(acc["state"], x)
        return both(after, F.concat(acc["out"], more))

    def block(acc: Column, part: Column) -> Column:
        return let(F.aggregate(part, both(acc["state"], none), one), lambda v: both(v["state"], F.concat(acc["out"], v["out"])))

    def whole(v: Column) -> Column:
        return F.when(F.size(v) > 0, F.aggregate(blocks(v), both(state, none), block, lambda acc: acc["out"])).otherwise(none)

    return let(xs, whole)


def spans_of(text: Column, pattern: str) -> Column:
    """``array<struct<s, e, m>>`` of the leftmost non-overlapping matches, in code points."""
    before = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # one piece more than matches: what lies after the last
    steps = F.filter(F.zip_with(before, found, lambda n, m: F.struct(n.alias("n"), m.alias("m"))), lambda x: x["m"].isNotNull())

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + x["n"]
        e = s + F.length(x["m"])
        return e, F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))

    return scan(steps, F.lit(0), step, "struct<s:int,e:int,m:string>")


def chunks(text: Column) -> Column:
    """``text`` in pieces of ``CHUNK`` code points, to ``cut`` from."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(pieces: Column, s: Column, e: Column) -> Column:
    """Code points ``s`` to ``e`` of the text that ``chunks`` cut."""
    first, last = F.floor(s / CHUNK).cast("int"), F.floor(e / CHUNK).cast("int")
    return F.when(e > s, F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), s - first * CHUNK + 1, e - s)).otherwise("")


def luhn(m: Column) -> Column:
    d = F.reverse(F.regexp_replace(m, "[^0-9]", ""))

    def digit(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), digit) % 10 == 0


def _digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("double"), F.lit(1e9)) <= 255),
    "card": luhn,
    "phone": lambda m: _digits(m).between(9, 15),
    "secret": lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
}


def _guard(text: Column, kind: str) -> Column:
    """A cheap test without which no match of the kind is possible."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    if kind == "name":
        return text.rlike(r"(?:Mr|Ms|Dr|Prof)")
    if kind in ("card", "account"):
        return text.rlike("[0-9][ -]?[0-9][ -]?[0-9]")
    if kind == "secret":
        return text.rlike("[0-9]")
    return text.rlike("[0-9]{3}" if kind != "ip" else r"[0-9]\.[0-9]")


def _found(text: Column, kind: str) -> Column:
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    found = F.when(_guard(text, kind), spans_of(text, PATTERNS[kind])).otherwise(none)
    return F.filter(found, lambda x: _VALID[kind](x["m"])) if kind in _VALID else found


def _base_of(text: Column, k: int, kind: str) -> Column:
    return F.transform(_found(text, kind), lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def base_spans(text: Column) -> Column:
    """``array<struct<s, k, e>>`` of all base spans, by start, then kind; ``k`` is a place in ``KINDS``."""
    parts = []
    for k, kind in enumerate(BASE):
        parts.append(_base_of(text, k, kind))
    return F.array_sort(F.concat(*parts))


def _vote(m: Column, context: Column, kind: str) -> list[Column]:
    """Votes of the labelers: 1, 0, or -1 for abstaining."""
    return [
        F.when(m.rlike(STRICT[kind]), 1).otherwise(0),
        F.when(m.rlike(SHAPE[kind]), 1).otherwise(0),
        F.when(m.rlike(GAZETTEER[kind]), 1).otherwise(-1),
        F.when(context.rlike(CUES[kind]), 1).otherwise(-1),
        F.when(context.rlike(COUNTER), 0).otherwise(-1),
    ]


_CANDIDATE = "struct<s:int,k:int,e:int,m:string>"


def candidates(text: Column, base: Column) -> Column:
    """Spans beyond the base: ``array<struct<s, k, e, votes, shape>>``, none that a base span overlaps."""
    found = F.array_sort(F.concat(*[_candidates_of(text, kind) for kind in EXTRA]))

    def judged(free: Column) -> Column:
        some = let(chunks(text), lambda pieces: F.transform(free, lambda x: _judged(pieces, F.length(text), x)))
        return F.when(F.size(free) > 0, some).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,votes:array<int>,shape:string>>"))

    return let(found, lambda f: let(_free(f, base), judged))


def _candidates_of(text: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.transform(_found(text, kind), lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m")))


def _free(found: Column, base: Column) -> Column:
    """The candidates that no base span overlaps; both lists come by start."""
    marks = F.transform(base, lambda b: F.struct(b["s"].alias("s"), F.lit(-1).alias("k"), b["e"].alias("e"), F.lit(None).cast("string").alias("m")))
    none = F.array().cast(f"array<{_CANDIDATE}>")

    def after(end: Column, x: Column) -> tuple[Column, Column]:
        """Base spans pass; candidates that start before the last end of a base span go."""
        return F.when(x["k"] < 0, F.greatest(end, x["e"])).otherwise(end), F.when((x["k"] < 0) | (x["s"] >= end), F.array(x)).otherwise(none)

    def before(start: Column, x: Column) -> tuple[Column, Column]:
        """From the right: candidates that end after the next start of a base span go, and so do the marks."""
        return F.when(x["k"] < 0, x["s"]).otherwise(start), F.when((x["k"] >= 0) & (x["e"] <= start), F.array(x)).otherwise(none)

    merged = scan(F.array_sort(F.concat(marks, found)), F.lit(0), after, _CANDIDATE)
    apart = F.reverse(scan(F.reverse(merged), F.lit(2**31 - 1), before, _CANDIDATE))
    return F.when((F.size(found) > 0) & (F.size(base) > 0), apart).otherwise(found)


def _judged(pieces: Column, size: Column, x: Column) -> Column:
    near = F.struct(cut(pieces, F.greatest(F.lit(0), x["s"] - CONTEXT), x["s"]).alias("left"), cut(pieces, x["e"], F.least(size, x["e"] + AFTER)).alias("right"))

    def one(c: Column) -> Column:
        votes = F.array()
        context = F.concat_ws("\n", c["left"], c["right"])
        for kind in reversed(EXTRA):
            votes = F.when(x["k"] == KINDS.index(kind), F.array(*_vote(x["m"], context, kind))).otherwise(votes.cast("array<int>"))
        sign = F.substring(c["left"], -1, 1).rlike("[\"'=:]").cast("int").cast("string")
        shape = F.concat_ws(":", x["k"].cast("string"), F.least(F.floor(F.length(x["m"]) / 8), F.lit(9)).cast("string"), sign)
        return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), votes.alias("votes"), shape.alias("shape"))

    return let(near, one)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fit(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> dict:
    """Reliabilities of the labelers and weights of the classifier, from all texts.

    Only sums of fixed number reach the driver: the table of vote patterns (at
    most 3^5 for each kind and shape) stays a DataFrame.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(text.alias("t")).select(F.explode(candidates(F.col("t"), base_spans(F.col("t")))).alias("c"))
    patterns = materialize(found.groupBy(F.col("c.k").alias("k"), F.col("c.votes").alias("v"), F.col("c.shape").alias("shape")).agg(F.count("*").alias("n")))
    kinds = range(len(BASE), len(KINDS))
    prior = {k: 0.5 for k in kinds}
    # for each kind and labeler: chances that it says 1 of a true and of a false candidate, given that it votes
    says = {k: [(0.8, 0.2)] * len(LABELERS) for k in kinds}
    for _ in range(rounds):
        votes = patterns.withColumn("p", _posterior(F.col("k"), F.col("v"), prior, says)).select("k", "n", "p", F.posexplode("v").alias("j", "vote"))
        said, voted = F.col("vote") == 1, F.col("vote") >= 0
        true, false = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        sums = {"n": F.col("n"), "p": true, "yes": F.when(said, true), "yes_of": F.when(voted, true), "no": F.when(said, false), "no_of": F.when(voted, false)}
        for r in votes.groupBy("k", "j").agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("double").alias(name) for name, x in sums.items()]).collect():  # a row a kind and labeler
            prior[r.k] = (r.p + 2) / (r.n + 4)
            # a few imagined votes keep labelers better than chance and silent ones where they began
            says[r.k][r.j] = (r.yes + 8) / (r.yes_of + 10), (r.no + 2) / (r.no_of + 10)
    weighted = patterns.withColumn("p", _posterior(F.col("k"), F.col("v"), prior, says))
    features = F.array(F.concat(F.lit("shape "), "shape"), *[F.concat(F.lit(f"{name} "), F.col("k").cast("string"), F.lit(" "), F.col("v")[j].cast("string")) for j, name in enumerate(LABELERS)])
    counted = weighted.select(F.explode(features).alias("f"), "n", "p").groupBy("f").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
    totals = weighted.groupBy("k").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
    start = {r.k: math.log((r.yes + 1) / (r.no + 1)) for r in totals.collect()}  # a row a kind
    weights = {}
    for r in counted.collect():  # shapes and votes: a fixed number
        k = int(r.f.split()[1].split(":")[0])
        weights[r.f] = (math.log((r.yes + 1) / (r.no + 1)) - start[k]) / 2  # features overlap: half of the evidence each
    return {"prior": prior, "says": says, "start": start, "weights": weights}


def _posterior(k: Column, v: Column, prior: dict, says: dict) -> Column:
    odds = F.lit(0.0)
    for kind, p in prior.items():
        own = F.lit(math.log(p / (1 - p)))
        for j, (yes, no) in enumerate(says[kind]):
            own = own + F.when(v[j] == 1, F.lit(math.log(yes / no))).when(v[j] == 0, F.lit(math.log((1 - yes) / (1 - no)))).otherwise(F.lit(0.0))
        odds = F.when(k == kind, own).otherwise(odds)
    return _sigmoid(odds)


def _accepted(c: Column, model: dict) -> Column:
    if not model["weights"]:
        return F.lit(False)
    start = F.create_map(*[x for k, w in sorted(model["start"].items()) for x in (F.lit(k), F.lit(w))])
    weight = F.create_map(*[x for f, w in sorted(model["weights"].items()) for x in (F.lit(f), F.lit(w))])
    score = F.coalesce(start[c["k"]], F.lit(0.0)) + F.coalesce(weight[F.concat(F.lit("shape "), c["shape"])], F.lit(0.0))
    for j, name in enumerate(LABELERS):
        score = score + F.coalesce(weight[F.concat(F.lit(f"{name} "), c["k"].cast("string"), F.lit(" "), c["votes"][j].cast("string"))], F.lit(0.0))
    return score > 0


def added_spans(cands: Column, model: dict) -> Column:
    """Accepted candidates, leftmost first, none overlapping another."""
    good = F.filter(cands, lambda c: _accepted(c, model))
    kind = "struct<s:int,k:int,e:int>"

    def step(at: Column, c: Column) -> tuple[Column, Column]:
        one = F.array(F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))
        return F.when(c["s"] >= at, c["e"]).otherwise(at), F.when(c["s"] >= at, one).otherwise(F.array().cast(f"array<{kind}>"))

    return scan(good, F.lit(0), step, kind)


def with_spans(docs: DataFrame, model: dict, text_col: str) -> tuple[DataFrame, Column, Column, Column]:
    """``docs`` with three columns more, and these: the text (null is empty), base spans, and all spans (base and added, by start, then kind)."""
    names = [fresh(docs.columns, f"__{x}") for x in ("text", "base", "spans")]
    text, base, spans = (F.col(f"`{x}`") for x in names)
    out = docs.withColumn(names[0], F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    out = out.withColumn(names[1], base_spans(text))
    out = out.withColumn(names[2], F.array_sort(F.concat(base, added_spans(candidates(text, base), model))))
    return out, text, base, spans


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _count(spans: Column, k: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict | None = None) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans)`` for each row of ``docs``.

    A null text is empty and has no spans. Repeated rows and null ids stay as
    they are; other columns are ignored; an empty table gives none. Places are
    code points, ends exclusive.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out, _, base, spans = with_spans(rows, model or fit(rows), "text")
    count = [_count(base, k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    more = [(F.size(spans) - F.size(base)).cast("long").alias("n_added"), F.size(spans).cast("long").alias("n_spans")]
    return out.select("doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), *more)


def redact(docs: DataFrame, text_col: str = "text", model: dict | None = None) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; null texts stay null.

    Of spans that overlap, the first is shown, and all of them go. Columns of
    any name stay as they are.
    """
    columns = docs.columns
    out, text, _, spans = with_spans(docs, model or fit(docs, text_col), text_col)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    size = F.length(text)
    end = F.array(F.struct(size.alias("s"), F.lit(-1).alias("k"), size.alias("e")))

    def redacted(pieces: Column) -> Column:
        def step(at: Column, x: Column) -> tuple[Column, Column]:
            shown = F.array(cut(pieces, at, x["s"]), F.when(x["k"] >= 0, names[F.greatest(x["k"], F.lit(0))]).otherwise(""))
            return F.greatest(at, x["e"]), F.when(x["s"] >= at, shown).otherwise(F.array().cast("array<string>"))

        return F.array_join(scan(F.concat(spans, end), F.lit(0), step, "string"), "")

    new = F.when((F.size(spans) > 0) & F.col(text_col).isNotNull(), let(chunks(text), redacted)).otherwise(F.col(text_col))
    return out.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in columns])
