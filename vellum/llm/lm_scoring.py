"""Language-model scores of documents by a hashed maximum-entropy model.

The model predicts a token in factors: the class of its type given the context,
the type in the class given the context, and the token in the type. The most
frequent words are types of their own; the others are hashed into tail types, in
which a word has its smoothed share of the counts. Class and type have softmax
distributions over hashed features of the context: the word before, the word
before that (a skip), and both. Tasks train on their part of the training
documents by gradient steps from common weights, and the weights are averaged by
blocks: each row of weights by how many tokens of a task it served, so that rows
which few tasks meet do not fall back to where they began. Every training token
is used in each round. The numbers of types and of
hashed weights follow the counted tokens (``sizes``).

Counts cover the whole corpus and are kept in hash buckets. Frequent words, of
which there can be at most ``HEAD`` (each has over 1/HEAD of all tokens), are
broadcast with their counts; for rarer ones documents ask the bucket of the word
and get back sums, so no vocabulary is ever whole in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import materialize, slices
from vellum.llm.shingles import hashes, mix, words

HEAD = 131_072
#: Classes and types in a class, of up to ``SMALL`` training tokens; one type in 16 is a tail type.
CLASSES, SIZE = 32, 32
#: Rows of the hashed weights of so many: of classes, and of types in a class.
CLASS_ROWS, TYPE_ROWS = 8_192, 16_384
SMALL = 1 << 24
#: Weights are added up without shifting their exponents; this keeps those finite.
LARGEST = 60.0
BATCH = 32_768
RATE = 1.0
ROUNDS = 1
#: Rows of a group of equal contexts up to which groups are added up side by side.
TURNS = 24
#: Documents that a task works on at once.
DOCS = 1_000
BUCKET_BYTES = 16_000_000
#: Rows of a block of weights when they are averaged, and tasks that are averaged at once.
BLOCK, TASKS = 1_024, 128
#: Most tasks that train at once: each sends all weights, which grow with the corpus as the tasks do.
TRAINERS = 512
END = np.uint64(0x2545F4914F6CDD1D)
_LOW = np.uint64(2**52 - 1)
_TF = 12


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text closed by the end token; and how many each text has."""
    parts, n = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = words(t)
        n[i] = len(w) + 1
        parts += w
        parts.append(b"")
    h = hashes(parts)
    h[np.cumsum(n) - 1] = END
    return h, n


# --- counts ----------------------------------------------------------------------


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, DOCS):
            h, _ = tokens(batch.column(0).to_pylist())
            h, c = np.unique(h, return_counts=True)
            b = (mix(h) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            h, c, b = h[order], c[order], b[order]
            cut = np.flatnonzero(np.diff(b)) + 1
            out = [(int(x[0]), y.tobytes(), z.astype(np.int64).tobytes()) for x, y, z in zip(np.split(b, cut), np.split(h, cut), np.split(c, cut)) if len(x)]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "words", "counts"])

    return run


def _sum_counts(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    h = np.frombuffer(b"".join(t.column("words").to_pylist()), np.uint64)
    c = np.frombuffer(b"".join(t.column("counts").to_pylist()), np.int64)
    u, inverse = np.unique(h, return_inverse=True)
    s = np.bincount(inverse, weights=c, minlength=len(u)).astype(np.int64)
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "types": [len(u)], "total": [int(s.sum())], "words": pa.array([u.tobytes()], pa.binary()), "counts": pa.array([s.tobytes()], pa.binary())})


def vocabulary(train: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, types, total, words, counts)`` of the tokens of all training texts."""
    parts = train.select(F.col("text").cast("binary")).mapInArrow(_count(buckets), "bucket int, words binary, counts binary")
    return materialize(parts.groupBy("bucket").applyInArrow(_sum_counts, "bucket int, types long, total long, words binary, counts binary"))


def sizes(total: int) -> tuple[int, int, int, int]:
    """Classes, types in a class, class rows and type rows for so many training tokens.

    Types double with every eightfold of the tokens, rows with every fourfold:
    a token's work grows with the sixth root of the corpus, the weights with the
    power 2/3.
    """
    doublings = max(1, total // SMALL).bit_length() - 1
    types, rows = doublings // 3, doublings // 2
    return CLASSES << types // 2, SIZE << (types + 1) // 2, CLASS_ROWS << rows, TYPE_ROWS << rows


class Model:
    """The head of the vocabulary, the types and the weights."""

    def __init__(self, words_: np.ndarray, counts: np.ndarray, total: int, types: int):
        order = np.argsort(words_)
        self.words, self.counts, self.total, self.types = words_[order], counts[order], total, types
        self.classes, self.size, class_rows, type_rows = sizes(total)
        self.tail = self.classes * self.size // 16
        self.own = self.size - self.tail // self.classes  # types of a class that are words
        best = np.lexsort((self.words, -self.counts))[: self.classes * self.own]
        self.type = np.full(len(self.words), -1, np.int64)
        # frequent words are dealt over the classes in turn, tail types over the ends of the classes
        self.type[best] = np.arange(len(best)) % self.classes * self.size + np.arange(len(best)) // self.classes
        self.top = np.sort(self.words[best])
        self.share = np.zeros(self.classes * self.size)  # log10 of what a tail type divides by
        self.class_w = np.zeros((class_rows, self.classes), np.float32)
        self.type_w = np.zeros((type_rows, self.size), np.float32)

    def place(self, h: np.ndarray) -> np.ndarray:
        """Places of tokens in the head, -1 for rarer ones."""
        if not len(self.words):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, -1)

    def type_of(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        tail = (mix(h ^ np.uint64(77)) % np.uint64(self.tail)).astype(np.int64)
        tail = tail % self.classes * self.size + self.own + tail // self.classes
        found = np.where(at >= 0, self.type[at] if len(self.type) else -1, -1)
        return np.where(found >= 0, found, tail)

    def rows(self, f: list[np.ndarray], cls: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return _rows(f, cls, self.classes, len(self.class_w), len(self.type_w))


def _features(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Hashes of the context features of each token; contexts do not cross texts."""
    before = np.r_[np.uint64(1), h[:-1]]
    before[first] = 1
    skip = np.r_[np.uint64(1), before[:-1]]
    skip[first] = 2
    return [mix(before ^ np.uint64(11)), mix(skip ^ np.uint64(22)), mix(before * np.uint64(31) + skip)]


def _rows(f: list[np.ndarray], cls: np.ndarray, classes: int = CLASSES, class_rows: int = CLASS_ROWS, type_rows: int = TYPE_ROWS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of the class weights and of the type weights; the first rows of each are the ones without context."""
    kind = np.uint16 if max(class_rows, type_rows) <= 1 << 16 else np.uint32
    c = [np.zeros(len(cls), kind), *((1 + x % np.uint64(class_rows - 1)).astype(kind) for x in f)]
    shift = cls.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    t = [cls.astype(kind), *((classes + ((x + shift) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) % np.uint64(type_rows - classes)).astype(kind) for x in f)]
    return c, t


def _order(r: np.ndarray) -> np.ndarray:
    """The stable order of rows, by radix sorts of 16 bits."""
    order = np.argsort(r.astype(np.uint16), kind="stable")
    return order if r.dtype == np.uint16 else order[np.argsort((r[order] >> 16).astype(np.uint16), kind="stable")]


def _softmax(w: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    z = w.take(rows[0], axis=0)
    for r in rows[1:]:
        z += w.take(r, axis=0)
    np.minimum(z, LARGEST, out=z)
    np.exp(z, out=z)
    z /= np.einsum("ij->i", z)[:, None]
    return z


def _sums(g: np.ndarray, order: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``g`` that are ``order[start : start + n]``, groups from large to small.

    Large groups are reduced one by one; of the others, the first rows of all are
    added up, then the second ones, and so on.
    """
    large = int(np.searchsorted(-n, -TURNS))
    out = np.empty((len(n), g.shape[1]), g.dtype)
    for k in range(large):
        out[k] = np.einsum("ij->j", g.take(order[start[k] : start[k] + n[k]], axis=0))
    out[large:] = g.take(order[start[large:]], axis=0)
    for turn in range(1, int(n[large]) if large < len(n) else 0):
        some = int(np.searchsorted(-n, -turn))  # those with more than so many rows
        out[large:some] += g.take(order[start[large:some] + turn], axis=0)
    return out


def _log_chance(w: np.ndarray, rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Natural logarithms of the chances of the targets."""
    z = w.take(rows[0], axis=0)
    for r in rows[1:]:
        z += w.take(r, axis=0)
    np.minimum(z, LARGEST, out=z)
    own = z[np.arange(len(target)), target].astype(np.float64)
    e = np.exp(z)
    total = np.einsum("ij->i", e).astype(np.float64)
    if not total.all():  # all of a row out of the range of exp
        low = total == 0
        top = z[low].max(axis=1).astype(np.float64)
        total[low] = np.exp(z[low] - top[:, None]).sum(axis=1)
        own[low] -= top
    return own - np.log(total)


def _step(w: np.ndarray, rows: list[np.ndarray], target: np.ndarray, served: np.ndarray | None = None) -> None:
    """One gradient step on a batch; each row of weights moves by its mean gradient. ``served`` counts the tokens of each row."""
    g = _softmax(w, rows)
    g[np.arange(len(target)), target] -= 1
    for r in rows:
        if not r.any():  # the row without context, alone
            w[0] -= (RATE * g.sum(axis=0) / (len(r) + 4)).astype(np.float32)
            if served is not None:
                served[0] += len(r)
            continue
        order = _order(r)
        s = r[order]
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        n = np.diff(np.r_[start, len(s)])
        by = np.argsort(-n, kind="stable")
        start, n = start[by], n[by]
        total = _sums(g, order, start, n)
        total *= (RATE / (n + 4)).astype(np.float32)[:, None]
        w[s[start]] -= total
        if served is not None:
            served[s[start]] += n


def _train(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        cw, tw, seen = model.class_w.copy(), model.type_w.copy(), 0
        cn, tn = np.zeros(len(cw), np.float32), np.zeros(len(tw), np.float32)
        for batch in slices(batches, DOCS):
            h, n = tokens(batch.column(0).to_pylist())
            first = np.r_[0, np.cumsum(n)[:-1]]
            f = _features(h, first)
            kind = model.type_of(h, model.place(h))
            for lo in range(0, len(h), BATCH):
                part = slice(lo, lo + BATCH)
                cls, inner = kind[part] // model.size, kind[part] % model.size
                c, t = model.rows([x[part] for x in f], cls)
                _step(cw, c, cls, cn)
                _step(tw, t, inner, tn)
            seen += len(h)
        if seen:
            task = TaskContext.get().partitionId()
            blocks = [(w[lo : lo + BLOCK], n[lo : lo + BLOCK]) for w, n in ((cw, cn), (tw, tn)) for lo in range(0, len(w), BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(blocks)), pa.int32()), pa.array([task // TASKS] * len(blocks), pa.int32()), pa.array([n.tobytes() for _, n in blocks], pa.binary()), pa.array([w.astype(np.float16).tobytes() for w, _ in blocks], pa.binary())],
                names=["block", "team", "served", "weights"],
            )

    return run


def _average(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Mean weights of a block, each row weighted by the tokens that it served; a row that served none is where it began."""
    total = mean = 0.0
    for n, w in zip(t.column("served").to_pylist(), t.column("weights").to_pylist()):
        n = np.frombuffer(n, np.float32).astype(np.float64)
        first = np.frombuffer(w, np.float16).reshape(len(n), -1)
        total, mean = total + n, mean + first * n[:, None]
    mean = np.where(total[:, None] > 0, mean / np.maximum(total, 1)[:, None], first)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "team": pa.array([0], pa.int32()), "served": pa.array([total.astype(np.float32).tobytes()], pa.binary()), "weights": pa.array([mean.astype(np.float16).tobytes()], pa.binary())})


def train_model(train: DataFrame, vocab: DataFrame, rounds: int = ROUNDS) -> Model:
    """A model from all training texts; what comes to the driver is bounded: head, tail sums, weights."""
    spark = train.sparkSession
    types, total = (int(x or 0) for x in vocab.agg(F.sum("types"), F.sum("total")).first())
    least = total / HEAD

    def head(batches):
        for batch in batches:
            out = []
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w, c = np.frombuffer(w, np.uint64), np.frombuffer(c, np.int64)
                out.append((w[c > least].tobytes(), c[c > least].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["words", "counts"])

    found = vocab.select("words", "counts").mapInArrow(head, "words binary, counts binary").collect()  # fewer than HEAD words
    model = Model(np.frombuffer(b"".join(r.words for r in found), np.uint64), np.frombuffer(b"".join(r.counts for r in found), np.int64), total, types)
    sent = spark.sparkContext.broadcast(model)

    def tails(batches):
        model = sent.value
        for batch in batches:
            n, v = np.zeros(len(model.share)), np.zeros(len(model.share))
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w, c = np.frombuffer(w, np.uint64), np.frombuffer(c, np.int64)
                kind = model.type_of(w, model.place(w))
                n += np.bincount(kind, weights=c, minlength=len(n))
                v += np.bincount(kind, minlength=len(v))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n.astype(np.int64)), pa.array(v.astype(np.int64))], names=["type", "n", "v"])

    sums = vocab.select("words", "counts").mapInArrow(tails, "type int, n long, v long").groupBy("type").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    freq, kinds = np.zeros(len(model.share)), np.zeros(len(model.share))
    for r in sums.collect():  # a row a type
        freq[r.type], kinds[r.type] = r.n, r.v
    tail = np.arange(len(freq)) % model.size >= model.own
    model.share = np.where(tail, np.log10(freq + kinds + 1), 0.0)
    by_class = (freq + 1).reshape(model.classes, model.size)
    model.class_w[0] = np.log(by_class.sum(axis=1) / by_class.sum())
    model.type_w[: model.classes] = np.log(by_class / by_class.sum(axis=1, keepdims=True))
    for _ in range(rounds if total else 0):
        sent = spark.sparkContext.broadcast(model)
        schema = "block int, team int, served binary, weights binary"
        parts = train.select(F.col("text").cast("binary")).coalesce(TRAINERS).mapInArrow(_train(sent), schema)
        parts = parts.groupBy("block", "team").applyInArrow(_average, schema).groupBy("block").applyInArrow(_average, schema)
        got = {r.block: np.frombuffer(r.weights, np.float16) for r in parts.collect()}  # the weights, whose size is known from the tokens
        flat = [got[k] for k in sorted(got)]
        cut = len(model.class_w) // BLOCK
        model.class_w = np.concatenate(flat[:cut]).reshape(model.class_w.shape).astype(np.float32)
        model.type_w = np.concatenate(flat[cut:]).reshape(model.type_w.shape).astype(np.float32)
    return model


# --- scores ----------------------------------------------------------------------

_ROW = "bucket int, chunk long, row array<long>, doc_id array<long>, lens array<int>, data binary, counts binary, n array<long>, known array<long>, base array<double>, score array<double>"
_KINDS = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()))


def _ask(sent, buckets: int):
    """Documents to what the head and the model tell of them, and to questions for the buckets of rarer words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, DOCS):
            docs = batch.column(0).to_pylist()
            h, n = tokens(batch.column(1).to_pylist())
            first = np.r_[0, np.cumsum(n)[:-1]]
            doc = np.repeat(np.arange(len(docs)), n)
            place = model.place(h)
            f = _features(h, first)
            kind = model.type_of(h, place)
            score = np.zeros(len(h))
            for lo in range(0, len(h), BATCH):
                part = slice(lo, lo + BATCH)
                cls, inner = kind[part] // model.size, kind[part] % model.size
                c, t = model.rows([x[part] for x in f], cls)
                score[part] = (_log_chance(model.class_w, c, cls) + _log_chance(model.type_w, t, inner)) / np.log(10) - model.share[kind[part]]
            head = place >= 0
            logs = np.where(head, np.log10(model.counts[place] + 1.0) if len(model.counts) else 0.0, 0.0)
            in_tail = head & (kind % model.size >= model.own)
            score += np.where(in_tail, logs, 0.0)
            rows, chunk = row + np.arange(len(docs)), row
            row += len(docs)
            own = -1 - int(mix(np.array([chunk], np.uint64))[0] % np.uint64(2**30))
            out = [(own, chunk, rows.tolist(), docs, [], b"", b"", n.tolist(), np.bincount(doc[head], minlength=len(docs)).tolist(), np.bincount(doc, weights=logs, minlength=len(docs)).tolist(), np.bincount(doc, weights=score, minlength=len(docs)).tolist())]
            hh, dd = h[~head], doc[~head]
            if len(hh):
                m = mix(hh)
                b = (m % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((hh, dd, b))
                hh, dd, b = hh[order], dd[order], b[order]
                new = np.flatnonzero(np.r_[True, (hh[1:] != hh[:-1]) | (dd[1:] != dd[:-1])])
                tf = np.diff(np.r_[new, len(hh)])
                hh, dd, b = hh[new], dd[new], b[new]
                cut = np.flatnonzero(np.diff(b)) + 1
                for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(b)]):
                    r, c = np.unique(dd[lo:hi], return_counts=True)
                    few = tf[lo:hi].max() < 256
                    out.append((int(b[lo]), chunk, rows[r].tolist(), [], c.tolist(), (hh[lo:hi] & np.uint64(2**56 - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes(), tf[lo:hi].astype(np.uint8 if few else np.uint32).tobytes(), [], [], [], []))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), _KINDS)], names=[x.split()[0] for x in _ROW.split(", ")])

    return run


def _words7(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return np.concatenate([raw, np.zeros((len(raw), 1), np.uint8)], axis=1).view("<u8").ravel()


_ANSWER = "chunk long, row array<long>, doc_id array<long>, n array<long>, known array<long>, base array<double>, tail array<double>"


def _answer(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """A bucket's questions and its vocabulary to answers for the chunks that asked, one row each."""
    if key[0].as_py() < 0:
        return t.select(["chunk", "row", "doc_id", "n", "known", "base", "score"]).rename_columns(["chunk", "row", "doc_id", "n", "known", "base", "tail"])
    vocab_w = vocab_c = np.zeros(0, np.int64)
    chunks, rows, lens, hs, tfs = [], [], [], [], []
    for chunk, r, ln, data, counts in zip(*(t.column(c).to_pylist() for c in ("chunk", "row", "lens", "data", "counts"))):
        if r is None:  # the vocabulary
            vocab_w, vocab_c = np.frombuffer(data, np.uint64) & np.uint64(2**56 - 1), np.frombuffer(counts, np.int64)
            order = np.argsort(vocab_w)
            vocab_w, vocab_c = vocab_w[order], vocab_c[order]
        else:
            chunks.append(chunk)
            rows.append(r)
            lens += ln
            hs.append(_words7(data))
            k = len(hs[-1])
            tfs.append(np.frombuffer(counts, np.uint8 if len(counts) == k else np.uint32).astype(np.int64))
    h, tf = np.concatenate([np.zeros(0, np.uint64), *hs]), np.concatenate([np.zeros(0, np.int64), *tfs])
    c = np.zeros(len(h), np.int64)
    if len(vocab_w):
        at = np.minimum(np.searchsorted(vocab_w, h), len(vocab_w) - 1)
        c = np.where(vocab_w[at] == h, vocab_c[at], 0)
    entry = np.repeat(np.arange(len(lens)), np.array(lens, np.int64))
    logs = np.bincount(entry, weights=tf * np.log10(c + 1.0), minlength=len(lens)).astype(float)  # of nothing, bincount gives integers
    known = np.bincount(entry, weights=tf * (c > 0), minlength=len(lens)).astype(np.int64)
    offsets = pa.array(np.cumsum([0] + [len(r) for r in rows]), pa.int32())
    of = lambda values: pa.ListArray.from_arrays(offsets, values)
    zero = np.zeros(len(lens), np.int64)
    cols = [pa.array(np.array([x for r in rows for x in r], np.int64)), pa.nulls(len(lens), pa.int64()), pa.array(zero), pa.array(known), pa.array(logs), pa.array(logs)]
    return pa.table([pa.array(chunks, pa.int64()), *map(of, cols)], names=["chunk", "row", "doc_id", "n", "known", "base", "tail"])


def _sum_chunk(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """The answers to a chunk, added up by row."""
    flat = {c: t.column(c).combine_chunks().flatten() for c in ("row", "doc_id", "n", "known", "base", "tail")}
    rows, code = np.unique(flat["row"].to_numpy(), return_inverse=True)
    add = lambda c: np.bincount(code, weights=flat[c].to_numpy(), minlength=len(rows))
    # ids come from the one answer that tells the size of the text
    told = np.flatnonzero(flat["n"].to_numpy() > 0)
    place = np.empty(len(rows), np.int64)
    place[code[told]] = told
    return pa.table({"doc_id": flat["doc_id"].take(pa.array(place)), "n_tokens": add("n").astype(np.int64), "n_known": add("known").astype(np.int64), "logs": add("base"), "score": add("tail")})


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``.

    Learns from the documents whose ``crc32(doc_id as text) mod 7`` is not 2
    (a null id trains). A null or empty text is the end token alone. Repeated
    rows count and are scored each. An empty table gives no rows. Without any
    training token, ``base_score`` is the log of 1 for each token and ``score``
    comes from even weights. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    train = docs.where(~held_out(F.col("doc_id")))
    vocab = vocabulary(train, buckets)
    model = train_model(train, vocab, rounds)
    sent = spark.sparkContext.broadcast(model)
    asked = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(_ask(sent, buckets), _ROW)
    kept = vocab.select("bucket", F.col("words").alias("data"), "counts")
    asked = asked.unionByName(kept, allowMissingColumns=True)
    answers = asked.groupBy("bucket").applyInArrow(_answer, _ANSWER)
    each = answers.groupBy("chunk").applyInArrow(_sum_chunk, "doc_id long, n_tokens long, n_known long, logs double, score double")
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(model.total + model.types + 1)))
    return each.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
