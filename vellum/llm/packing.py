"""Best-fit packing of documents into sequences by a linear grouping scheme.

Only the histogram of piece lengths is planned centrally: at most one number for
each length up to the capacity, whatever the size of the corpus.

* Large lengths (over an eighth of the capacity) are sorted into groups of equal
  cardinality and rounded up to the largest length of their group.
* Configurations over those few sizes are optimised: a linear program asks for the
  fewest sequences, and its columns are made as they are wanted, each by a
  knapsack over the sizes at their shadow prices. Whole multiples of what it uses
  are opened; what is left over goes by best fit decreasing, a configuration
  opened once for many sequences.
* Few groups make few sizes but waste what they round up, unless small documents
  fill it. So the scheme is also run with a group for each length, which rounds
  nothing and has too many sizes for the program; the plan of fewer sequences is taken.
* Actual lengths take the places of the rounded ones, which leaves slack.
* Small lengths go, largest first, to the fullest sequences that still hold them.

The plan is a list of runs: so many sequences, each with these lengths in these
places. Documents of a length are numbered without bringing them together: they
are dealt into salts, the counts of salts give each its first number, and each
document finds its place by its number in the runs of its length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import lean, materialize

CAPACITY = 2_048
#: Groups of large lengths, and most columns that the linear program adds.
GROUPS = 64
COLUMNS = 300
#: Words whose tokens a worker remembers.
REMEMBERED = 500_000
#: Documents that are encoded together.
BATCH = 256


class Encoder:
    """Token ids of texts by a ``tokenizers`` file, as little-endian 32-bit bytes.

    The file's pre-tokenizer makes words that never cross white space and are
    encoded on their own, and words repeat: their tokens are remembered. Texts
    in Latin letters are cut into the pre-tokenizer's words here, and new words
    are encoded together by the library, spaces between them; the mark that
    ends the last token of a word tells them apart. Other texts are cut at white
    space only, and what lies between is encoded by the library.
    """

    #: The pre-tokenizer's pattern, with the letters and numerals below U+0100 written out.
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Zªµº\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[0-9²³¹¼½¾]|[^\t-\r \u0085\u00a0a-zA-Zªµº\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff0-9²³¹¼½¾]+")
    MARK = "</w>"

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith(self.MARK)]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.remembered = remembered

    def encode(self, texts: list[str]) -> list[bytes]:
        # chunks are longer than words, and fewer texts have them
        for known, most in ((self.known, self.remembered), (self.chunks, self.remembered // 4)):
            if len(known) > most:
                known.clear()
        out: list[bytes] = [b""] * len(texts)
        plain, other = {}, {}
        for i, t in enumerate(texts):
            if self.is_plain(t):
                plain[i] = self.WORDS.findall(t.lower())
            else:
                other[i] = self.between_spaces(t)
        for split, known, add in ((plain, self.known, self.add_words), (other, self.chunks, self.add_chunks)):
            new = {w for words in split.values() for w in words if w not in known}
            add(list(new))
            for i, words in split.items():
                out[i] = b"".join([known[w] for w in words])
        return out

    def is_plain(self, text: str) -> bool:
        """Whether lower case and normal form are the same everywhere for these characters, and no special token is in them."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(s in text for s in self.special)

    def add_words(self, new: list[str]) -> None:
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):  # a vocabulary without such marks
                return self.known.update({w: np.array(e.ids, "<u4").tobytes() for w, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False))})
            data, at = ids.tobytes(), 0
            for w, e in zip(part, (ends * 4).tolist()):
                self.known[w] = data[at:e]
                at = e
        return None

    def add_chunks(self, new: list[str]) -> None:
        for w, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False)):
            self.chunks[w] = np.array(e.ids, "<u4").tobytes()

    @staticmethod
    def between_spaces(text: str) -> list[str]:
        # str.split also cuts at \x1c to \x1f, which may be part of a token
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [w.decode() for w in text.encode().split()]
        return text.split()


@lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = 0, ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: the tokens of each row and ``end``, cut at ``capacity``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        stop = np.array([end], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                b = batch.slice(lo, BATCH)
                rows: list[tuple] = []
                for doc, data in zip(b.column(0).to_pylist(), encoder.encode([t or "" for t in b.column(1).to_pylist()])):
                    data += stop
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if ids else None))
                cols = list(zip(*rows))
                types = [b.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if ids else out.drop("ids")


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size is taken, for the dearest configuration."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        worth = best[c - sizes[fits]] + prices[fits]
        k = int(worth.argmax())
        best[c], last[c] = (worth[k], fits[k]) if worth[k] > best[c - 1] else (best[c - 1], -1)
    taken, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            taken[last[c]] += 1
            c -= sizes[last[c]]
    return taken


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """``(sequences, how often each size)``: whole multiples of an optimal fractional packing, never more than ``counts``."""
    if not 0 < len(sizes) <= GROUPS:
        return []
    size, need = np.array(sizes), np.array(counts, float)
    basis = np.diag(capacity // size).astype(float)  # a column for each size alone
    for _ in range(COLUMNS):
        taken = _knapsack(size, np.maximum(0, np.linalg.solve(basis.T, np.ones(len(size)))), capacity)
        prices = np.linalg.solve(basis.T, np.ones(len(size)))
        if taken @ prices <= 1 + 1e-9:
            break
        step, now = np.linalg.solve(basis, taken), np.linalg.solve(basis, need)
        out = np.where(step > 1e-9, now / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(out.argmin())] = taken
    often = np.floor(np.maximum(0, np.linalg.solve(basis, need)) + 1e-9).astype(np.int64)
    left, found = np.array(counts), []
    for k in np.argsort(-often, kind="stable"):
        column = np.rint(basis[:, k]).astype(np.int64)
        most = min([int(often[k]), *(left[column > 0] // column[column > 0]).tolist()])
        if most > 0:
            found.append((most, column.tolist()))
            left -= most * column
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int | None = None) -> list[tuple[int, list[int]]]:
    """Runs ``(sequences, lengths)`` that hold just the pieces of ``histogram``.

    By default the better of the plans with ``GROUPS`` groups and with one for
    each length. Deterministic; its work depends on the capacity, not on the counts.
    """
    if groups is None:
        return min((plan(histogram, capacity, g) for g in (GROUPS, max(histogram.values(), default=1) * capacity)), key=lambda runs: sum(bins for bins, _ in runs))
    whole = histogram.get(capacity, 0)
    runs: list[tuple[int, list[int]]] = [(whole, [capacity])] if whole else []
    left = {n: c for n, c in histogram.items() if c and n < capacity}
    large = sorted((n for n in left if 8 * n > capacity), reverse=True)
    total = sum(left[n] for n in large)
    # groups of equal cardinality: a length lies in the group of its first piece, and counts may be cut between groups
    share = max(1, -(-total // groups))
    sizes: list[tuple[int, int, list[list[int]]]] = []  # rounded size, pieces, [length, count] from long to short
    held: list[list[int]] = []
    room = share

    def close() -> None:
        """Ends a group; groups of the same rounded size are one."""
        nonlocal held
        if held and sizes and sizes[-1][0] == held[0][0]:
            size, count, stock = sizes[-1]
            sizes[-1] = (size, count + sum(c for _, c in held), stock + held)
        elif held:
            sizes.append((held[0][0], sum(c for _, c in held), held))
        held = []

    for n in large:
        count = left[n]
        while count:
            take = min(count, room)
            held.append([n, take])
            count, room = count - take, room - take
            if not room:
                close()
                room = share
    close()
    # configurations of few sizes, opened for many sequences at once: [free, count, groups]
    open_: list[tuple[int, int, int, tuple[int, ...]]] = []  # sorted by free room
    serial = 0
    left_over = [count for _, count, _ in sizes]
    for bins, column in configurations([size for size, _, _ in sizes], left_over, capacity):
        config = tuple(g for g, k in enumerate(column) for _ in range(k))
        bisect.insort(open_, (capacity - sum(sizes[g][0] for g in config), serial, bins, config))
        serial += 1
        left_over = [c - bins * k for c, k in zip(left_over, column)]
    for g, (size, _, _) in enumerate(sizes):
        count = left_over[g]
        while count:
            at = bisect.bisect_left(open_, (size,))
            if at == len(open_):  # new sequences, each with as many of this size as it holds
                fit = capacity // size
                for bins, k in ((count // fit, fit), (1 if count % fit else 0, count % fit)):
                    if bins:
                        bisect.insort(open_, (capacity - k * size, serial, bins, (g,) * k))
                        serial += 1
                break
            free, s, bins, config = open_.pop(at)
            take = min(bins, count)
            if take < bins:
                bisect.insort(open_, (free, s, bins - take, config))
            bisect.insort(open_, (free - size, serial, take, (*config, g)))
            serial += 1
            count -= take
    # actual lengths for rounded ones
    filled: list[tuple[int, int, int, tuple[int, ...]]] = []
    for _, _, bins, config in open_:
        while bins:
            take = bins
            need: dict[int, int] = {}
            for g in config:
                need[g] = need.get(g, 0) + 1
            for g, k in need.items():  # so many sequences can have the same actual lengths
                n, c = sizes[g][2][0]
                take = min(take, c // k if c >= k else 1)
            lengths = []
            for g in config:
                stock = sizes[g][2]
                lengths.append(stock[0][0])
                stock[0][1] -= take
                if stock[0][1] == 0:
                    stock.pop(0)
            bins -= take
            bisect.insort(filled, (capacity - sum(lengths), serial, take, tuple(lengths)))
            serial += 1
    # small ones by best fit, longest first
    for n in sorted((n for n in left if 8 * n <= capacity), reverse=True):
        count = left[n]
        while count:
            at = bisect.bisect_left(filled, (n,))
            if at == len(filled):
                fit = capacity // n
                bins, rest = divmod(count, fit)
                for b, k in ((bins, fit), (1 if rest else 0, rest)):
                    if b:
                        bisect.insort(filled, (capacity - k * n, serial, b, (n,) * k))
                        serial += 1
                break
            free, s, bins, lengths = filled.pop(at)
            fit = min(free // n, max(1, count // bins))
            take = min(bins, count // fit)
            if take < bins:
                bisect.insort(filled, (free, s, bins - take, lengths))
            bisect.insort(filled, (free - fit * n, serial, take, lengths + (n,) * fit))
            serial += 1
            count -= take * fit
    return runs + [(bins, list(lengths)) for _, _, bins, lengths in filled]


def _places(runs: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first number, first sequence, offset, sequences)`` of each place of each run."""
    out, given, sequence = [], {}, 0
    for bins, lengths in runs:
        at = 0
        for n in lengths:
            first = given.get(n, 0)
            out.append((n, first, sequence, at, bins))
            given[n] = first + bins
            at += n
        sequence += bins
    return out


def assign(cut: DataFrame, capacity: int = CAPACITY, groups: int | None = None) -> DataFrame:
    """``cut`` (materialised pieces) with the ``sequence_id`` and ``offset`` of each piece."""
    spark = cut.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("c")))
    histogram = {r.length: r.c for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # one row a length at most
    places = sorted(_places(plan(histogram, capacity, groups)))
    names = cut.columns
    sent = spark.sparkContext.broadcast([np.array(x, np.int64) for x in zip(*places)])
    first = F.coalesce(F.sum("c").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("length", "salt", first.alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = salted.withColumn("number", number.cast("long")).join(before.hint("merge"), ["length", "salt"])
    numbered = numbered.select(*cut.columns, (F.col("number") + F.col("before")).alias("number"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, low, sequence, offset, _ = sent.value
            n, k = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(length * 2**40 + low, n * 2**40 + k, side="right") - 1
            cols = [*batch.columns[:-1], pa.array(sequence[at] + k - low[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return numbered.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset)`` for each piece of each document.

    ``tokenizer`` is the path of a ``tokenizers`` file on every executor. A null
    text is empty and has the end token alone. Only documents over ``capacity``
    tokens are cut. Repeated rows and null ids are packed like any row; other
    columns are ignored; an empty table gives no pieces. ``sequence_id`` is
    dense from 0; offsets in a sequence have no gaps.
    """
    return assign(materialize(pieces(docs, tokenizer, id_col, text_col, capacity, ids=ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, length, ids)`` of what ``pack(ids=True)`` returns: the token ids, ready to train on."""
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))  # at most capacity tokens
    return rows.select("sequence_id", "length", F.aggregate("x", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
