"""Language identification by Bayesian evidence fusion.

The posterior of a document's language multiplies
* the likelihood of its text under byte n-gram models, one for each language
  and an even one for text of no known language (``und``),
* the likelihood of the language that it declares (a column, or the markup's
  ``lang``) and of the hint in its address (a path segment or a country suffix),
  both from how often they go with what the texts themselves show,
* the prior of its host, smoothed towards that of its domain and of the whole
  corpus; a document's own share is taken out of all three.

Texts are scored once; what follows are grouped sums over the scores. Models of
text are fitted on a bounded sample of labelled rows (``TRAIN_ROWS``), shared out
evenly over the languages; every other number covers all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import lean, materialize, small_or_shuffled

#: About so many labelled rows train the models of text.
TRAIN_ROWS = 20_000
#: So many labelled rows of a language train at least, if it has them.
LEAST_ROWS = 50
#: Most languages that are modelled, the most frequent labels: far above what corpora label.
#: A document that declares a rarer one keeps it, unless a modelled language wins.
LANGUAGES = 512
#: Tasks that count the sample.
TEAMS = 8
SLOTS = 1 << 16
UND = "und"
#: Overlapping n-grams repeat their evidence: so many count as one.
OVERLAP = 4.0
#: Strength of the smoothing of host towards domain and of domain towards corpus, in documents.
STRENGTH = 20.0
#: Share of a language's model that its own n-grams have; the rest is even, so that
#: words which the sample never showed count little against a language.
FAMILIAR = 0.5
GROUP = 256

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
#: Country suffixes and the language that they hint at.
SUFFIXES = {"fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh"}


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all byte 4-grams of the folded texts, and how many each text has."""
    folded = [b" " + t.translate(_FOLD) + b" " if t else b"" for t in texts]
    n = np.array([max(0, len(t) - 3) if t.strip() else 0 for t in folded], np.int64)
    b = np.frombuffer(b"".join(t + b"   " for t in folded), np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.zeros(0, np.int64), n
    h = b[:-3] * _MUL[0] + b[1:-2] * _MUL[1] + b[2:-1] * _MUL[2] + b[3:] * _MUL[3]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    slot = (h >> np.uint32(16)).astype(np.int64)
    start = np.cumsum([0] + [len(t) + 3 for t in folded[:-1]])
    keep = np.zeros(len(slot) + 1, np.int64)
    np.add.at(keep, start[n > 0], 1)
    np.add.at(keep, start[n > 0] + n[n > 0], -1)
    return slot[np.cumsum(keep[:-1]) > 0], n


def train(docs: DataFrame, id_: Column, text: Column, label: Column, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the table of log probabilities ``(slots, languages + 1)``, ``und`` last.

    Each language has about as many rows in the sample, or all of its rows if it
    has fewer; the row with the least hash is always among them.
    """
    hashed = F.pmod(F.xxhash64(id_.cast("string"), text), F.lit(1 << 52))
    labelled = docs.where(label.isNotNull() & text.rlike(r"\S")).select(label.alias("l"), text.cast("binary").alias("t"), hashed.alias("h"))
    tally = labelled.groupBy("l").agg(F.count("*").alias("n"), F.min("h").alias("h")).orderBy(F.desc("n"), "l").limit(LANGUAGES).collect()
    names = sorted(r.l for r in tally)
    if not names:
        return [], np.zeros((SLOTS, 1), np.float32)
    each = max(LEAST_ROWS, rows / len(names))
    # hashes up to here are in the sample; at most LANGUAGES rows, and a table, since rows would start Python workers of their own
    upto = docs.sparkSession.createDataFrame(pa.table({"l": pa.array([r.l for r in tally], pa.string()), "upto": pa.array([max(r.h, int(min(1.0, each / r.n) * (1 << 52))) for r in tally], pa.int64())}))
    sample = labelled.join(F.broadcast(upto), "l").where("h <= upto").select("l", "t")
    # the sample is small; a task holds the counts of one language at a time
    sample = sample.repartition(TEAMS).sortWithinPartitions("l")

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total = None, np.zeros(SLOTS, np.int32)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([total.tobytes()], pa.binary())], names=["l", "counts"])
        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x, some in groupby(zip(labels, texts), key=lambda r: r[0]):
                if x != name:
                    if name is not None:
                        yield row()
                    name, total = x, np.zeros(SLOTS, np.int32)
                total += np.bincount(grams([t for _, t in some])[0], minlength=SLOTS).astype(np.int32)
        if name is not None:
            yield row()

    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        total = np.zeros(SLOTS, np.int64)
        for x in t.column("counts").to_pylist():
            total += np.frombuffer(x, np.int32)
        return pa.table({"l": pa.array([key[0].as_py()], pa.string()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = sample.mapInArrow(count, "l string, counts binary")
    got = {r.l: np.frombuffer(r.counts, np.int64) for r in parts.groupBy("l").applyInArrow(add, "l string, counts binary").collect()}  # a row a language
    names = [n for n in names if n in got]
    table = np.full((SLOTS, len(names) + 1), -np.log(SLOTS) if names else 0.0, np.float32)
    for k, n in enumerate(names):
        table[:, k] = np.log(FAMILIAR * got[n] / max(1, got[n].sum()) + (1 - FAMILIAR) / SLOTS)
    return names, table


def _score(sent):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            out = []
            for lo in range(0, batch.num_rows, GROUP):
                slot, n = grams(batch.column(0).slice(lo, GROUP).to_pylist())
                sums = np.zeros((len(n), table.shape[1]))
                has = np.flatnonzero(n)
                if len(has):
                    start = np.r_[0, np.cumsum(n[has])[:-1]]
                    for k in range(table.shape[1]):
                        sums[has, k] = np.add.reduceat(table[:, k][slot], start, dtype=np.float64)
                out.append((sums - sums.max(axis=1, keepdims=True)) / OVERLAP)
            flat = np.concatenate(out) if out else np.zeros((0, table.shape[1]))
            scores = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, table.shape[1]), pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], scores], names=["doc_id", "declared", "hint", "host", "domain", "empty", "ll"])

    return run


def hint_of(url: Column, names: list[str]) -> Column:
    """The language that an address hints at: a path segment that names one, else its country suffix."""
    segment = F.regexp_extract(url, r"^[a-z]+://[^/]+/([a-z]{2})(?:[/?#-]|$)", 1)
    suffix = F.regexp_extract(F.lower(url), r"^[a-z]+://[^/:?#]*\.([a-z]{2})(?:[/:?#]|$)", 1)
    known = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    return F.when(segment.isin(names), segment).otherwise(known[suffix])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]+(?:\.[^.]+)?)$", 1)


def markup_language(html: Column) -> Column:
    """The language that a page declares, or null."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1))
    return F.when(found != "", found)


def visible_text(html: Column) -> Column:
    """A page's text without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^>]*>", " ")


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(x: pa.Array, size: int) -> np.ndarray:
    """A column of arrays, all of one size."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), size)


def _own(batch: pa.RecordBatch, rates: dict[str, dict[str, list[float]]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods of all that a row itself tells, and the chances that they give; none of an empty text."""
    own = _matrix(batch.column("ll"), size)
    for given, logs in rates.items():
        known = {g: i + 1 for i, g in enumerate(logs)}
        rows = np.array([[0.0] * size, *logs.values()])
        own = own + rows[[known.get(x, 0) for x in batch.column(given).to_pylist()]]
    empty = np.array(batch.column("empty").to_pylist(), bool)
    return own, np.where(empty[:, None], 0.0, _softmax(own))


def _host_sums(rates: dict, size: int):
    """Scored rows to sums of the chances by host."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, p = _own(batch, rates, size)
            hosts = batch.column("host").dictionary_encode()
            code = hosts.indices.to_numpy()
            sums = np.zeros((len(hosts.dictionary), size))
            np.add.at(sums, code, p)
            first = np.full(len(sums), len(code))
            np.minimum.at(first, code, np.arange(len(code)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, size), pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([hosts.dictionary, batch.column("domain").take(pa.array(first)), lists], names=["host", "domain", "s"])

    return run


def _fused(rates: dict, names: list[str], whole: list[float]):
    """Scored rows with the sums of their host and domain to ``(doc_id, lang, confidence, kept)``."""
    size = len(names)

    def smooth(counts: np.ndarray, p: np.ndarray, prior) -> np.ndarray:
        """Shares without the row's own, pulled towards a prior."""
        less = np.maximum(counts - p, 0.0)
        return (less + STRENGTH * prior) / (less.sum(axis=1, keepdims=True) + STRENGTH)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, p = _own(batch, rates, size)
            prior = smooth(np.array(whole), p, 1.0 / size)
            for counts in ("of_domain", "of_host"):
                prior = smooth(_matrix(batch.column(counts), size), p, prior)
            post = _softmax(own + np.log(prior))
            best = post.argmax(axis=1)
            lang, sure = [], post.max(axis=1)
            for k, (b, declared, empty) in enumerate(zip(best.tolist(), batch.column("declared").to_pylist(), batch.column("empty").to_pylist())):
                if empty:
                    lang.append(UND)
                    sure[k] = 0.0
                elif names[b] == UND and declared is not None and declared not in names:
                    lang.append(declared)  # beyond the modelled languages: nothing else can tell of it
                else:
                    lang.append(names[b])
            kept = [x != UND for x in lang]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(sure), pa.array(kept, pa.bool_())], names=["doc_id", "lang", "confidence", "kept"])

    return run


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: Column | str = "text",
    declared: Column | str | None = "lang",
    url: Column | str | None = None,
    host: Column | str | None = None,
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """``(doc_id, lang, confidence, kept)`` for each row of ``docs``.

    ``declared`` also labels the training rows. ``host`` is any grouping that
    shares languages (taken from ``url`` by default). A row is kept if some
    language beats ``und``. Null, empty and letterless texts have no
    evidence of their own; they get ``und`` and are not kept. Null hints, hosts
    and addresses count as not known. If no row declares a language, nothing is
    modelled: ``lang`` is null and rows are kept. A declared language beyond the
    ``LANGUAGES`` most frequent is taken as declared where ``und`` would win. Repeated rows and null ids
    stay; an empty table gives none.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    none = F.lit(None).cast("string")
    text, declared = col(text).cast("string"), col(declared).cast("string") if declared is not None else none
    url = col(url) if url is not None else none
    names, table = train(docs, F.col(id_col), text, declared, train_rows)
    if not names:
        return docs.select(F.col(id_col).alias("doc_id"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("kept"))
    source = col(host).cast("string") if host is not None else host_of(url)
    empty = ~F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(
        text.cast("binary").alias("t"),
        F.col(id_col).alias("doc_id"),
        declared.alias("declared"),
        hint_of(url, names).alias("hint"),
        F.coalesce(source, F.lit("")).alias("host"),
        domain_of(F.coalesce(source, F.lit(""))).alias("domain"),
        empty.alias("empty"),
    )
    sent = docs.sparkSession.sparkContext.broadcast(table)
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = materialize(rows.mapInArrow(_score(sent), f"doc_id {kind}, declared string, hint string, host string, domain string, empty boolean, ll array<double>"))

    # how often declarations and hints go with what the texts show; at most languages times languages rows
    all_names = [*names, UND]
    shown = F.array_position("ll", F.array_max("ll")) - 1
    rates: dict[str, dict[str, list[float]]] = {}
    for given in ("declared", "hint"):
        seen = scored.where(~F.col("empty") & F.col(given).isin(all_names)).groupBy(F.col(given).alias("g"), shown.cast("int").alias("l")).agg(F.count("*").alias("n")).collect()
        count = np.zeros((len(all_names), len(all_names)))
        for r in seen:
            count[all_names.index(r.g), r.l] += r.n
        p = (count + 1) / (count.sum(axis=0, keepdims=True) + len(all_names))
        rates[given] = {g: np.log(p[i]).tolist() for i, g in enumerate(all_names)} if seen else {}
    size = len(all_names)
    sums = [F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(size)]
    parts = scored.select("declared", "hint", "host", "domain", "empty", "ll").mapInArrow(_host_sums(rates, size), "host string, domain string, s array<double>")
    hosts = materialize(parts.groupBy("host", "domain").agg(*sums))
    totals = [F.sum(f"s{k}").alias(f"s{k}") for k in range(size)]
    whole = [float(x or 0) for x in hosts.agg(*totals).first()]
    pack = F.array(*[f"s{k}" for k in range(size)])
    domains = hosts.groupBy("domain").agg(*totals).select("domain", pack.alias("of_domain"))
    hosts = hosts.select("host", "domain", pack.alias("of_host")).join(domains, "domain").select("host", "of_host", "of_domain")
    fused = scored.join(hosts, "host").select("doc_id", "declared", "hint", "empty", "ll", "of_host", "of_domain")
    return fused.mapInArrow(_fused(rates, all_names, whole), f"doc_id {kind}, lang string, confidence double, kept boolean")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """``docs`` without the ids of which every row is rejected; rows with a null id stay."""
    found = identify(docs, id_col, **more)
    gone = materialize(found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("__gone")))
    return docs.join(small_or_shuffled(gone, gone.count()), docs[id_col] == F.col("__gone"), "left_anti")
