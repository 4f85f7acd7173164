"""Text quality from weak labels.

Overlapping heuristics vote good, bad or abstain on each document.
Expectation-maximisation over the counts of vote patterns (at most 3 to the
number of labelers, whatever the corpus) estimates how accurate each is, on good
documents and on several kinds of bad ones; the posterior of a document's pattern
is its label. Posterior labels train a hashed
linear scorer on words and simple shares of characters, which also judges
documents on which the heuristics are silent.

Vote patterns are counted over all documents. The scorer is fitted on a bounded
sample (``TRAIN_ROWS``) by local gradient steps whose weights are averaged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shingles import hashes, mix

#: About so many texts train the scorer, in so many tasks.
TRAIN_ROWS = 20_000
TEAMS = 8
SLOTS = 1 << 16
#: Added to the hashed slots: shares of characters and words.
SHARES = 8
EPOCHS = 3
BATCH = 64
RATE = 4.0
ROUNDS = 25
LABELERS = ("symbols", "tables", "capitals", "repeats", "sentences", "word_length", "lines", "shouting")
GOOD, BAD, SILENT = 1, 0, -1

_SYMBOL = np.array([33 <= c <= 126 and not chr(c).isalnum() and chr(c) not in ".,;:'\"!?()-" for c in range(256)])
_LETTER = np.array([chr(c).isalpha() and c < 128 or c >= 128 for c in range(256)])
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])


def measure(text: bytes | None) -> tuple[list[int], list[float], list[bytes]]:
    """Votes, shares and words of one text."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [SILENT] * len(LABELERS), [0.0] * SHARES, words
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters, solid = max(1, int(c[_LETTER].sum())), max(1, int(c.sum() - c[32] - c[9:14].sum()))
    symbols, upper, digits = c[_SYMBOL].sum() / solid, c[_UPPER].sum() / letters, c[_DIGIT].sum() / solid
    pipes, ends, shouts = c[124] / n, (c[46] + c[33] + c[63]) / n, c[33] / n
    top = Counter(words).most_common(1)[0][1] / n
    length = solid / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / max(1, len(lines))

    def vote(applies: bool, bad: bool) -> int:
        return SILENT if not applies else BAD if bad else GOOD

    votes = [
        vote(n >= 5, symbols > 0.06),
        vote(n >= 5, pipes > 0.1),
        vote(letters >= 40, upper > 0.5),
        vote(n >= 12, top > 0.3),
        vote(n >= 30, ends < 1 / 200),
        vote(n >= 5, length < 2 or length > 15),
        vote(len(lines) >= 4, again > 0.3),
        vote(n >= 5, shouts > 0.2),
    ]
    return votes, [symbols, pipes, upper, digits, top, min(ends, 2.0), min(length, 20.0) / 20, again], words


def _features(texts: list[bytes | None]):
    """Votes, and for each text its slots with weights, flat with starts."""
    votes, slots, values, n = [], [], [], []
    for t in texts:
        v, shares, words = measure(t)
        votes.append(v)
        h = (mix(hashes([w.lower() for w in words])) % np.uint64(SLOTS)).astype(np.int64)
        slots.append(np.concatenate([h, SLOTS + np.arange(SHARES + 1)]))
        values.append(np.concatenate([np.full(len(h), 1 / max(1, len(h))), shares, [1.0]]))
        n.append(len(slots[-1]))
    return np.array(votes, np.int64).reshape(-1, len(LABELERS)), np.concatenate(slots), np.concatenate(values), np.r_[0, np.cumsum(n)]


def patterns(docs: DataFrame, text_col: str = "text") -> dict[tuple[int, ...], int]:
    """How many documents have each pattern of votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update(tuple(measure(t)[0]) for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], names=["votes", "n"])

    rows = docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    return {tuple(r.votes): r.n for r in rows.collect()}  # at most 3^8 rows


#: Chances of a good vote where the estimate starts: of any labeler on good documents,
#: of the labeler that knows a kind of bad document on that kind, and of the others on it.
START = (0.999, 0.1, 0.9)
#: Documents and votes that are imagined at the start, so that no chance becomes 0 or 1.
IMAGINED = 10


def kinds_of(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the kinds of documents, good ones first, and each labeler's chances of a good vote on each kind.

    Labelers look for different faults, so their votes on bad documents depend
    on one another. There are as many kinds of bad documents as labelers, each
    started with the labeler that knows it; within a kind, votes are taken as
    independent. Nothing but the start tells kinds apart: all chances are estimated.
    """
    n_kinds = len(LABELERS) + 1
    begin = np.full((len(LABELERS), n_kinds), START[2])
    begin[:, 0] = START[0]
    begin[np.arange(len(LABELERS)), 1 + np.arange(len(LABELERS))] = START[1]
    likely = np.r_[0.7, np.full(len(LABELERS), 0.3 / len(LABELERS))]
    shares, chances = likely, begin
    if not counts:
        return shares, chances
    keys = sorted(counts)
    v, n = np.array(keys), np.array([counts[k] for k in keys], float)
    good, voted = (v == GOOD).astype(float), (v != SILENT).astype(float)
    for _ in range(rounds):
        weight = n[:, None] * _kinds(v, shares, chances)
        shares = (weight.sum(axis=0) + likely * IMAGINED) / (n.sum() + IMAGINED)
        chances = (good.T @ weight + begin * IMAGINED) / (voted.T @ weight + IMAGINED)
    return shares, chances


def _kinds(v: np.ndarray, shares: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Chances of the kinds, given patterns of votes."""
    logs = np.log(shares) + (v == GOOD) @ np.log(chances) + (v == BAD) @ np.log(1 - chances)
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def posterior(v: np.ndarray, shares: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Chances of being good, given patterns of votes."""
    return _kinds(v, shares, chances)[:, 0]


def estimate(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Share of good documents, and for each labeler the chances of a good vote on good and on bad ones."""
    shares, chances = kinds_of(counts, rounds)
    return float(shares[0]), np.stack([chances[:, 0], chances[:, 1:] @ shares[1:] / shares[1:].sum()], axis=1)


def scores(w: np.ndarray, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    z = np.add.reduceat(w[slots] * values, starts[:-1])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, id_col: str, text_col: str, shares: np.ndarray, chances: np.ndarray, rows: int, total: int) -> np.ndarray:
    """Weights of the scorer, from about ``rows`` texts.

    The sample goes by a hash of id and text, so copies of a text enter like other
    rows, and is dealt to ``TEAMS`` tasks, whatever the number of input files.
    """
    text = F.col(text_col)
    h = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text), F.lit(1 << 52))
    sample = docs.where(text.isNotNull()).select(text.cast("binary").alias("t"), h.alias("h")).where(F.col("h") <= int(min(1.0, rows / max(1, total)) * (1 << 52)))
    sample = sample.withColumn("team", F.pmod(F.xxhash64("h"), F.lit(TEAMS))).repartition(TEAMS, "team").sortWithinPartitions("h").select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, seen = np.zeros(SLOTS + SHARES + 1), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for _ in range(EPOCHS):
                for lo in range(0, len(texts), BATCH):
                    votes, slots, values, starts = _features(texts[lo : lo + BATCH])
                    off = scores(w, slots, values, starts) - posterior(votes, shares, chances)
                    g = np.bincount(slots, weights=values * np.repeat(off, np.diff(starts)), minlength=len(w))
                    w -= RATE / len(off) * g
            seen += len(texts)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([w.astype(np.float32).tobytes()], pa.binary())], names=["seen", "w"])

    got = sample.mapInArrow(run, "seen long, w binary").collect()  # a row a team at most
    n = sum(r.seen for r in got)
    if not got and docs.where(text.rlike(r"\S")).limit(1).count():
        raise ValueError(f"no text of {total} in the sample of {rows}")
    return sum((r.seen / n * np.frombuffer(r.w, np.float32).astype(float) for r in got), np.zeros(SLOTS + SHARES + 1))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, votes, weak_label, score, kept)`` for each row of ``docs``.

    ``votes`` are those of ``LABELERS``; ``weak_label`` is the posterior of
    being good that they give, ``score`` that of the trained scorer; a row is
    kept if their mean is at least one half. Null and empty texts and those
    without words are not kept. Repeated rows and null ids stay; other columns
    are ignored; an empty table gives none. A sample without any text, of a table
    that has some, is an error.
    """
    counts = patterns(docs, text_col)
    shares, chances = kinds_of(counts)
    w = train(docs, id_col, text_col, shares, chances, train_rows, sum(counts.values()))
    sent = docs.sparkSession.sparkContext.broadcast((shares, chances, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, chances, w = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                texts = b.column(1).to_pylist()
                votes, slots, values, starts = _features(texts)
                weak, score = posterior(votes, shares, chances), scores(w, slots, values, starts)
                kept = ((weak + score) / 2 >= 0.5) & np.array([bool(t and t.strip()) for t in texts])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes.tolist(), pa.list_(pa.int32())), pa.array(weak), pa.array(score), pa.array(kept)], names=["doc_id", "votes", "weak_label", "score", "kept"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, votes array<int>, weak_label double, score double, kept boolean")
