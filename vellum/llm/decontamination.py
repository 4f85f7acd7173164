"""Benchmark decontamination: token windows against a broadcast set of test n-grams.

The windows of the benchmark are collected up to a bound of bytes and sent to
every task as sorted hashes; each document is cut into words once and its windows
are looked up, vectorised over a group of documents. A hit of the hash is
verified on the words themselves. A benchmark beyond the bound is scanned in
blocks of items that keep to it: each row passes one block after another in the
same stage and carries along what was found, so nothing is left out at any size
and no row meets another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import lean, slices

WINDOW = 10
#: Most bytes of benchmark text in one broadcast set, unless a single item has more.
BLOCK_BYTES = 16_000_000
#: Documents that are looked up together.
GROUP = 512

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MUL = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 for i in range(1, WINDOW + 1)], np.uint64)


def words(text: bytes | None) -> list[bytes]:
    """ASCII-lower-cased words: runs of digits, letters a to z and non-ASCII characters."""
    return text.translate(_FOLD).split() if text else []


class Windows:
    """The windows of benchmark items: 10 consecutive words, or all of a shorter item.

    A window takes 20 bytes (its hash, where it starts in the stream of word
    numbers, whose it is); besides there are the distinct words.
    """

    def __init__(self, items: list[tuple[str | None, bytes | None]], size: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        stream, starts, at = [], {}, 0
        for item, (_, text) in enumerate(items):
            w = np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)], np.uint32)
            if k := min(size, len(w)):
                first = np.arange(at, at + len(w) - k + 1, dtype=np.int32 if at + len(w) < 2**31 else np.int64)
                starts.setdefault(k, []).append((first, np.full(len(first), item, np.int32)))
                stream.append(w)
                at += len(w)
        self.stream = np.concatenate([np.zeros(0, np.uint32), *stream])
        self.windows = {}
        for k, parts in sorted(starts.items()):
            first, item = (np.concatenate(x) for x in zip(*parts))
            h = np.zeros(len(first), np.uint64)
            for i in range(k):
                h += self.stream[first + i] * _MUL[i]
            order = np.argsort(h, kind="stable")
            self.windows[k] = h[order], first[order], item[order]

    def holders(self, k: int, h: np.uint64, ids: np.ndarray) -> set:
        """The items that hold this window of k words."""
        hashes, first, item = self.windows[k]
        lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
        same = (self.stream[first[lo:hi, None] + np.arange(k)] == ids).all(axis=1)
        return {self.names[x] for x in np.unique(item[lo:hi][same]).tolist()}

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, np.ndarray, set]]:
        """For each text: its number of words, the mask of hit words, the items found."""
        tokens = [words(t) for t in texts]
        n = np.array([len(t) for t in tokens], np.int64)
        start = np.r_[0, np.cumsum(n + 1)]  # a stop after each text
        ids = np.zeros(start[-1] + WINDOW, np.uint64)
        get = self.ids.get
        for t, at in zip(tokens, start):
            ids[at : at + len(t)] = np.fromiter((get(x, 0) for x in t), np.uint64, len(t))
        gap = np.r_[0, np.cumsum(ids == 0)]
        mark = np.zeros(len(ids) + 1, np.int64)
        found: list[set] = [set() for _ in texts]
        seen: dict[bytes, set] = {}
        for k, (hashes, _, _) in self.windows.items():
            at = np.flatnonzero(gap[k:] == gap[:-k])
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for i in range(k):
                h += ids[at + i] * _MUL[i]
            hit = np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h)
            for p, x in zip(at[hit].tolist(), h[hit]):
                window = ids[p : p + k]
                key = window.tobytes()
                if key not in seen:
                    seen[key] = self.holders(k, x, window)
                if seen[key]:
                    mark[p] += 1
                    mark[p + k] -= 1
                    found[np.searchsorted(start, p, side="right") - 1].update(seen[key])
        hit = np.cumsum(mark) > 0
        return [(int(m), hit[a : a + m], f) for m, a, f in zip(n, start, found)]


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(i for i in items if i is not None)).encode()).hexdigest()


def cut_words(text: bytes, hit: np.ndarray) -> bytes:
    """``text`` without its hit words and the separators between neighbouring hits."""
    folded = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
    edge = np.diff(np.r_[0, folded.astype(np.int8), 0])
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at, i = [], 0, 0
    while i < len(hit):
        if hit[i]:
            j = i
            while j + 1 < len(hit) and hit[j + 1]:
                j += 1
            out.append(text[at : first[i]])
            at, i = int(last[j]), j
        i += 1
    return b"".join(out) + text[at:]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[Windows]:
    """Windows of the items, in blocks that keep to about ``limit`` bytes of text (an item is never cut)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // limit))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield Windows([(r.item, bytes(r.text)) for r in part.collect()])


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    spans: bool = False,
) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for each row of ``docs``.

    With ``spans``, also ``clean_text``: the text without the words that
    benchmark windows cover. A null text has no words and is clean; a null or
    wordless item has no window; an item without an id has windows, which hit,
    but is not counted among the items. Item ids of any type are sorted as
    strings; rows of one item id are one item. Repeated rows and ids are scanned
    each; other columns are ignored; an empty table on either side gives no rows
    or no hits.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    none = F.lit(None)
    carried = rows.select("doc_id", "text", none.cast("binary").alias("hits"), none.cast("array<string>").alias("items"), none.cast("long").alias("n"))
    for windows in _blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(windows)

        @lean
        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, GROUP):
                hits, items, count = [], [], []
                for (n, hit, new), old, before in zip(sent.value.scan(b.column(1).to_pylist()), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    bits = np.packbits(hit)
                    if old is not None:
                        bits |= np.frombuffer(old, np.uint8)
                    hits.append(bits.tobytes() if bits.any() else None)
                    items.append(sorted({*(before or []), *(i for i in new if i is not None)}))
                    count.append(n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(count, pa.int64())],
                    names=["doc_id", "text", "hits", "items", "n"],
                )

        carried = carried.mapInArrow(scan, carried.schema)

    @lean
    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [None if x is None else np.unpackbits(np.frombuffer(x, np.uint8)) for x in b.column("hits").to_pylist()]
            items = b.column("items").to_pylist()
            cols = [
                b.column("doc_id"),
                b.column("n"),
                pa.array([0 if h is None else int(h.sum()) for h in hits], pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([_digest(x) for x in items], pa.string()),
                pa.array([h is not None for h in hits], pa.bool_()),
            ]
            if spans:
                texts = b.column("text").to_pylist()
                cols.append(pa.array([None if h is None else cut_words(t, h[:n].astype(bool)).decode() for t, h, n in zip(texts, hits, b.column("n").to_pylist())], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kinds = f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    kinds += ", clean_text string" if spans else ""
    names = [x.split()[0] for x in kinds.split(", ")]
    if spans:
        return carried.mapInArrow(shown, kinds)
    return carried.drop("text").mapInArrow(shown, kinds)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; columns stay as they are.

    Rows are scanned where they are, so there is no join; a benchmark of several
    blocks is scanned block after block.
    """
    at = docs.columns.index(text_col)
    for windows in _blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(windows)

        @lean
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, GROUP):
                texts = [t.encode() if t is not None else None for t in b.column(at).to_pylist()]
                yield b.filter(pa.array([not hit.any() for _, hit, _ in sent.value.scan(texts)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
