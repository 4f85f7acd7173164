"""Highlighting: matched words of a text as parts, whole or as the best passages.

Everything runs on the page of hits that is shown, so its cost does not depend
on the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import analysis

K1, B, PIVOT = 0.8, 0.75, 87.0
SENTENCE = r"[^.!?\n]+[.!?]*\n?|[.!?\n]+"
#: What a passage may be; any other pattern that matches the whole text piece by piece will do too.
BREAKS = {"sentence": SENTENCE, "line": r"[^\n]*\n|[^\n]+", "word": r"\S+\s*|\s+", "character": r"(?s).", "whole": r"(?s).+"}


def matches(text: Column, accepts) -> Column:
    """``array<struct<token, start, end>>`` of the words that ``accepts`` (a predicate on the lower-cased word)."""
    return F.filter(analysis.with_offsets(text), lambda x: accepts(F.lower(x["token"])))


def whole(text: Column, accepts) -> Column:
    """The text in parts ``array<struct<hit, text>>``; joined, they are the text again."""
    return parts_of(text, matches(text, accepts), F.lit(0), F.length(text))


def parts_of(text: Column, hits: Column, start: Column, end: Column) -> Column:
    none = F.array().cast("array<struct<hit:boolean,text:string>>")

    def piece(hit: bool, s: Column, e: Column) -> Column:
        return F.array(F.struct(F.lit(hit).alias("hit"), F.substring(text, s + 1, e - s).alias("text")))

    def add(acc: Column, x: Column) -> Column:
        gap = F.when(x["start"] > acc["at"], piece(False, acc["at"], x["start"])).otherwise(none)
        return F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, piece(True, x["start"], x["end"])).alias("out"))

    done = F.aggregate(hits, F.struct(start.cast("int").alias("at"), none.alias("out")), add)
    return F.when(done["at"] < end, F.concat(done["out"], piece(False, done["at"], end))).otherwise(done["out"])


def marked(text: Column, accepts, before: str = "<b>", after: str = "</b>") -> Column:
    """The whole text with marks around its matches."""
    return F.array_join(F.transform(whole(text, accepts), lambda p: F.when(p["hit"], F.concat(F.lit(before), p["text"], F.lit(after))).otherwise(p["text"])), "")


def whole_values(values: Column, accepts) -> Column:
    """One list of parts for each value of a multi-valued text."""
    return F.transform(values, lambda v: whole(v, accepts))


def _best(text: Column, hits: Column, most: int, breaks: str) -> Column:
    """The passages ``array<struct<rank, start, end, score>>`` with the most to show, the best first."""

    def scored(s: Column) -> Column:
        n = F.size(F.filter(hits, lambda h: (h["start"] >= s["start"]) & (h["end"] <= s["end"]))).cast("double")
        length = (s["end"] - s["start"]).cast("double")
        norm = 1 / F.ln(PIVOT + s["start"]) + 1
        score = norm * n * (K1 + 1) / (n + K1 * (1 - B + B * length / PIVOT))
        return F.struct((-score).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    passages = F.transform(analysis.with_offsets(text, BREAKS.get(breaks, breaks)), scored)
    return F.slice(F.array_sort(F.filter(passages, lambda x: x["score"] > 0)), 1, most)


def snippets(text: Column, accepts, most: int = 2, max_length: int = 100, breaks: str = "sentence") -> Column:
    """The best passages ``array<struct<start, end, score, text>>``, in order of place.

    Passages are what ``breaks`` names or matches. A passage scores by its
    matches, saturated and normalised by its length; ties go to the earlier one.
    Long passages are cut at ``max_length`` and end with an ellipsis.
    """
    best = _best(text, matches(text, accepts), most, breaks)

    def shown(x: Column) -> Column:
        body = F.substring(text, x["start"] + 1, x["end"] - x["start"])
        cut = F.when(F.length(body) > max_length, F.concat(F.regexp_replace(F.substring(body, F.lit(1), F.lit(max_length)), r"\s+\S*$", ""), F.lit(" ..."))).otherwise(body)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"), cut.alias("text"))

    return F.array_sort(F.transform(best, shown))


def snippet_parts(text: Column, accepts, most: int = 2, breaks: str = "sentence") -> Column:
    """The best passages, uncut, with their parts: ``array<struct<start, end, score, parts>>``, in order of place."""
    hits = matches(text, accepts)

    def shown(x: Column) -> Column:
        inside = F.filter(hits, lambda h: (h["start"] >= x["start"]) & (h["end"] <= x["end"]))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"), parts_of(text, inside, x["start"], x["end"]).alias("parts"))

    return F.array_sort(F.transform(_best(text, hits, most, breaks), shown))
