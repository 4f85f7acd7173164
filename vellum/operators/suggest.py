"""Auto-suggest: completions by prefix, infix and with spelling errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import analysis

SEPARATOR = "\u001f"


def from_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``weight SEP text SEP payload [SEP context ...]``; ``#`` starts a comment, blank lines are skipped.

    A malformed line (too few parts, or a weight that is no number) raises when the table is read.
    """
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    parts = F.split("value", SEPARATOR)
    weight = F.expr("try_cast(parts[0] AS bigint)")
    bad = F.raise_error(F.concat(F.lit("malformed suggestion: "), F.col("value")))
    rows = lines.withColumn("parts", parts).withColumn("weight", weight)
    return rows.select(
        F.when((F.size("parts") < 3) | F.col("weight").isNull(), bad.cast("bigint")).otherwise(F.col("weight")).alias("weight"),
        F.get("parts", F.lit(1)).alias("text"),
        F.get("parts", F.lit(2)).alias("payload"),
        F.when(F.size("parts") > 3, F.expr("slice(parts, 4, size(parts) - 3)")).otherwise(F.array().cast("array<string>")).alias("contexts"),
    )


def from_rows(rows: DataFrame, text: Column, weight: Column, payload: Column | None = None, contexts: Column | None = None) -> DataFrame:
    """A dictionary from a table: one entry for each text, with its greatest weight."""
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    entries = rows.select(text.alias("text"), weight.cast("bigint").alias("weight"), (payload if payload is not None else none).alias("payload"), (contexts if contexts is not None else empty).alias("contexts"))
    best = F.max(F.struct("weight", "payload", "contexts")).alias("x")
    return entries.where("text is not null").groupBy("text").agg(best).select("x.weight", "text", "x.payload", "x.contexts")


def update(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries with changed ones replaced and new ones added, by text."""
    kept = entries.join(changes.select("text"), "text", "left_anti").select("weight", "text", "payload", "contexts")
    return kept.unionByName(changes.select("weight", "text", "payload", "contexts"))


def save(entries: DataFrame, path: str) -> None:
    """Keeps a dictionary; a new one replaces the old, from which it must not be read."""
    entries.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _normal(text: Column) -> Column:
    return F.array_join(analysis.standard(text), " ")


def _ranked(found: DataFrame, typed: str, n: int, exact_first: bool) -> DataFrame:
    keys = [F.desc("weight"), F.col("text")]
    if exact_first:
        keys = [F.desc(F.lower("text") == typed.lower()), *keys]
    return found.orderBy(*keys).limit(n).select("text", "weight", "payload")


def by_prefix(entries: DataFrame, typed: str, n: int = 5, exact_first: bool = True, contexts: list[str] = ()) -> DataFrame:
    """Entries whose analysed text begins with what was typed; the heaviest first."""
    found = entries.where(_normal(F.col("text")).startswith(_normal(F.lit(typed))))
    return _ranked(_in_context(found, contexts), typed, n, exact_first)


def by_infix(entries: DataFrame, typed: str, n: int = 5, all_terms: bool = True, contexts: list[str] = ()) -> DataFrame:
    """Entries with a word that begins with the last typed word, and the other typed words (all, or any)."""
    words = typed.lower().split()
    tokens = analysis.standard(F.col("text"))
    conditions = [F.array_contains(tokens, w) for w in words[:-1]] + [F.exists(tokens, lambda t: t.startswith(words[-1]))] if words else [F.lit(False)]
    ok = conditions[0]
    for c in conditions[1:]:
        ok = (ok & c) if all_terms else (ok | c)
    return _ranked(_in_context(entries.where(ok), contexts), typed, n, False)


def fuzzy(entries: DataFrame, typed: str, n: int = 5, edits: int = 1, exact_prefix: int = 1, contexts: list[str] = ()) -> DataFrame:
    """Entries of which a beginning is within so many edits of what was typed; the heaviest first."""
    typed = typed.lower()
    normal = _normal(F.col("text"))
    sizes = range(max(1, len(typed) - edits), len(typed) + edits + 1)
    near = F.least(*[F.levenshtein(F.substring(normal, F.lit(1), F.lit(k)), F.lit(typed)) for k in sizes])
    found = entries.where(normal.startswith(typed[:exact_prefix]) & (near <= edits))
    return _ranked(_in_context(found, contexts), typed, n, True)


def highlighted(text: Column, typed: str) -> Column:
    """``array<struct<hit, text>>``: the beginnings of words that the typed words match."""
    pattern = "|".join(rf"\Q{w}\E" for w in sorted(set(typed.split()), key=lambda w: -len(w)))
    pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{pattern})"
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: F.struct(F.lit(True).alias("hit"), t.alias("text")))
    gaps = F.transform(F.split(text, pattern, -1), lambda t: F.struct(F.lit(False).alias("hit"), t.alias("text")))
    both = F.flatten(F.zip_with(gaps, found, lambda g, f: F.array(g, f)))
    return F.filter(both, lambda x: x.isNotNull() & (x["text"] != ""))


def _in_context(rows: DataFrame, contexts: list[str]) -> DataFrame:
    return rows.where(F.arrays_overlap("contexts", F.array(*[F.lit(c) for c in contexts]))) if contexts else rows


def completions(entries: DataFrame, lookups: DataFrame, n: int = 5) -> DataFrame:
    """Prefix suggestions for a table of lookups (``typed``), best n each.

    Entries and lookups meet on the length and value of the lookup's first three
    characters, or of all of a shorter one; an empty lookup finds nothing. Only
    the best n entries of a short lookup's beginning can be suggested, so all
    others leave before the join.
    """
    normal = _normal(F.col("text"))
    e = entries.withColumn("normal", normal).withColumn("head", F.explode(F.array_distinct(F.array(*[F.substring(normal, 1, k) for k in (1, 2, 3)]))))
    rank = F.row_number().over(Window.partitionBy("head").orderBy(F.desc("weight"), "text"))
    short = e.where(F.length("head") < 3).withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")
    e = e.where(F.length("head") == 3).unionByName(short)
    q = lookups.select("typed").distinct().withColumn("want", _normal(F.col("typed"))).where(F.length("want") >= 1).withColumn("head", F.substring("want", 1, 3))
    found = e.join(q, "head").where(F.col("normal").startswith(F.col("want")))
    place = F.row_number().over(Window.partitionBy("typed").orderBy(F.desc("weight"), "text"))
    return found.withColumn("place", place).where(F.col("place") <= n).select("typed", "place", "text", "weight")
