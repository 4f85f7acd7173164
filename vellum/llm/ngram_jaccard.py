"""Set-similarity join on word shingles with a count-vector R-tree.

Two documents link when the Jaccard similarity of their shingle sets is at
least 0.8. The join is exact; every step works on all documents:

1. A shingle that only one document holds cannot be shared. Documents of which
   fewer than 80 % of the shingles are shared by anyone have no partner and
   leave. This counts truncated hashes in hash buckets: a collision can only
   keep a document, never lose one.
2. Equal sets become one node, named by the least id that has the set, so copies
   never meet in pairs. An id with several sets may name several of them: they
   are tied anyway.
3. Sets that link share one of their ``n - ceil(0.8 n) + 1`` rarest shingles,
   in any order of shingles that all sets agree on. Those shingles are the
   blocks in which partners are searched. A set has ranks for its blocks, the
   rarest first.
4. In a block each set is a point: shingles are hashed into groups, and the
   coordinates count the shingles of each group. An R-tree packs the points,
   level upon level; the sum of coordinate minima bounds the overlap, of boxes
   (by their upper corners) as well as of points. Pairs that pass are verified
   on the sets themselves.
5. Only components are wanted, so the search goes in rounds. Each looks only at
   blocks in which several components meet, and a block names the best pairs
   that would join its components, one less than there are components. The
   first round takes the rarest blocks of a set and what is near in the tree;
   the second all blocks and the whole tree. Blocks of which a named pair
   proved false name more: a few partners for each point, and at last every
   pair of points of different components. No pair that could connect is skipped.

Large blocks are cut in parts. Points of the component that most points of the
block belong to stay in one part each; the others visit all parts. Nothing but
counts of rows comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import connected_components, lean, lean_group, materialize, slices, small_or_shuffled
from vellum.llm.shingles import mix, shingle_set

GROUPS = 256
#: Children of a node of the tree.
LEAF = 16
#: Bytes of text for a bucket of the shared-shingle count.
BUCKET_BYTES = 8_000_000
#: Documents that a task works on at once, and shingles of the sets that it works on at once.
DOCS = 1_000
SHINGLES = 1_000_000
#: Points of one part of a block.
PART = 1_000
#: Blocks of a set that the first round takes.
FIRST = 2
#: Partners of a point that the third round names; the last round has no such limit.
NEAREST = 8
#: Pairs of points or boxes that are compared at once.
COMPARED = 8_192
_LOW = np.uint64(0xFFFFFFFF)


def need(n: np.ndarray | int):
    """Shared shingles that a set of n needs at least: ceil(0.8 n)."""
    return (4 * n + 4) // 5


def counts(s: np.ndarray) -> np.ndarray:
    """The point of a set: how many of its shingles fall in each group."""
    return np.bincount((mix(s) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)


def _set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values())], names=list(kinds))


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if len(x):
        cut = np.flatnonzero(np.diff(x)) + 1
        yield from zip(np.r_[0, cut].tolist(), np.r_[cut, len(x)].tolist())


# --- 1. shared shingles -------------------------------------------------------

_ENTRY = "bucket int, chunk long, docs array<long>, sids array<binary>, rows binary, lens binary, data binary"
_ENTRY_KINDS = {"bucket": pa.int32(), "chunk": pa.int64(), "docs": pa.list_(pa.int64()), "sids": pa.list_(pa.binary()), "rows": pa.binary(), "lens": pa.binary(), "data": pa.binary()}
_NOBODY = 0xFFFF


def _entries(buckets: int):
    """Batches of (doc_id, text) to entries of buckets; a chunk is what a task worked on at once.

    An entry has the rows of the chunk that hold shingles of the bucket, how many
    each, and the shingles' lower halves. A shingle that several rows of the chunk
    hold goes on once, for nobody. One entry with a negative bucket of its own
    tells ids, sets, sizes and what was found shared within the chunk.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, batch in enumerate(slices(batches, DOCS)):
            ids = batch.column(0).to_pylist()
            sets = [shingle_set(x) for x in batch.column(1).to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            chunk = (TaskContext.get().partitionId() << 32) + at
            h = np.concatenate([np.zeros(0, np.uint64), *sets])
            row = np.repeat(np.arange(len(sets)), n)
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            dup = np.zeros(len(h), bool)
            dup[order[1:][same]] = True
            first = dup.copy()
            dup[order[:-1][same]] = True
            local = np.bincount(row[dup], minlength=len(ids))
            own = -1 - int(mix(np.array([chunk], np.uint64))[0] % np.uint64(2**30))
            out: list[tuple] = [(own, chunk, ids, [_set_id(s) for s in sets], n.astype("<u4").tobytes(), local.astype("<u4").tobytes(), b"")]
            held = ~first  # one of each
            h, row = h[held], np.where(dup[held], _NOBODY, row[held])
            bucket = (h >> np.uint64(32)).astype(np.int64) % buckets
            order = np.lexsort((row, bucket))
            bucket, row, data = bucket[order], row[order], (h[order] & _LOW).astype("<u4")
            for lo, hi in _runs(bucket):
                r, c = np.unique(row[lo:hi], return_counts=True)
                out.append((int(bucket[lo]), chunk, None, None, r.astype("<u2").tobytes(), c.astype("<u4").tobytes(), data[lo:hi].tobytes()))
            yield _batch(out, _ENTRY_KINDS)

    return run


_ANSWER = "chunk long, docs array<long>, sids array<binary>, rows binary, shared binary"


@lean_group
def _shared_of(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """A bucket's entries to answers for the chunks that they came from, one row each."""
    if key[0].as_py() < 0:  # what chunks tell of themselves
        return t.select(["chunk", "docs", "sids", "rows", "lens"]).rename_columns(["chunk", "docs", "sids", "rows", "shared"])
    rows = [np.frombuffer(x, "<u2") for x in t.column("rows").to_pylist()]
    size = np.frombuffer(b"".join(t.column("lens").to_pylist()), "<u4").astype(np.int64)
    h = np.frombuffer(b"".join(t.column("data").to_pylist()), "<u4")
    _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
    found = np.bincount(np.repeat(np.arange(len(size)), size)[times[inverse] > 1], minlength=len(size))
    out, at = [], 0
    for chunk, r in zip(t.column("chunk").to_pylist(), rows):
        f = found[at : at + len(r)]
        at += len(r)
        has = (f > 0) & (r != _NOBODY)
        out.append((chunk, None, None, r[has].tobytes(), f[has].astype("<u4").tobytes()))
    return pa.Table.from_batches([_batch(out, {"chunk": pa.int64(), "docs": pa.list_(pa.int64()), "sids": pa.list_(pa.binary()), "rows": pa.binary(), "shared": pa.binary()})])


def _sum_chunk(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """The answers to a chunk, added up by row."""
    told, shared = None, np.zeros(_NOBODY, np.int64)
    for docs, sids, rows, found in zip(*(t.column(c).to_pylist() for c in ("docs", "sids", "rows", "shared"))):
        if docs is not None:
            told = docs, sids, np.frombuffer(rows, "<u4").astype(np.int64)
            shared[: len(docs)] += np.frombuffer(found, "<u4")
        else:
            np.add.at(shared, np.frombuffer(rows, "<u2"), np.frombuffer(found, "<u4"))
    docs, sids, n = told
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "sid": pa.array(sids, pa.binary()), "n": n, "shared": shared[: len(docs)]})


def shared_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, sid, n, shared)`` of each row: its set, the size, and how many of its shingles others hold too."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    entries = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(_entries(max(8, -(-size // BUCKET_BYTES))), _ENTRY)
    answers = entries.groupBy("bucket").applyInArrow(_shared_of, _ANSWER)
    return answers.groupBy("chunk").applyInArrow(_sum_chunk, "doc_id long, sid binary, n long, shared long")


# --- 2. sets ------------------------------------------------------------------

_SET = {"chunk": pa.int64(), "node": pa.int64(), "sid": pa.binary(), "n": pa.int32(), "shingles": pa.binary()}


@lean
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to their sets, dealt into chunks that a task can work on at once."""
    chunk, held = TaskContext.get().partitionId() << 32, 0
    for batch in slices(batches, DOCS):
        out, chunk, held = [], chunk + 1, 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = shingle_set(text)
            if held + len(s) > SHINGLES:
                yield _batch(out, _SET)
                out, chunk, held = [], chunk + 1, 0
            held += len(s)
            out.append((chunk, doc, _set_id(s), len(s), s.tobytes()))
        yield _batch(out, _SET)


# --- 3. blocks ----------------------------------------------------------------


def _block_key(h: np.ndarray, buckets: int) -> np.ndarray:
    """The block of a shingle: its bucket and lower half. Shingles that agree in both are one block."""
    return ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | h & _LOW).view(np.int64)


def _questions(buckets: int):
    """Sets to questions (bucket, chunk, data, times): shingles of a chunk and how many of its sets hold each."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            for a, b in _runs(chunk):
                keys = np.concatenate([np.zeros(0, np.int64), *(_block_key(np.frombuffer(x, np.uint64), buckets) for x in batch.column(1).slice(a, b - a).to_pylist())])
                keys, times = np.unique(keys, return_counts=True)
                out = [(int(keys[lo] >> 32), int(chunk[a]), (keys[lo:hi] & 0xFFFFFFFF).astype("<u4").tobytes(), times[lo:hi].astype("<u4").tobytes()) for lo, hi in _runs(keys >> 32)]
                yield _batch(out, {"bucket": pa.int32(), "chunk": pa.int64(), "data": pa.binary(), "times": pa.binary()})

    return run


@lean_group
def _frequencies(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """A bucket's questions to answers: of shingles that several sets hold, steps of an eighth of a doubling."""
    data = [np.frombuffer(x, "<u4") for x in t.column("data").to_pylist()]
    times = np.frombuffer(b"".join(t.column("times").to_pylist()), "<u4")
    _, inverse = np.unique(np.concatenate(data), return_inverse=True)
    total = np.bincount(inverse, weights=times)[inverse]
    step = np.minimum(255, 8 * np.log2(total)).astype(np.uint8)
    out, at = [], 0
    for chunk, h in zip(t.column("chunk").to_pylist(), data):
        s = step[at : at + len(h)]
        at += len(h)
        out.append((chunk, key[0].as_py(), h[s > 0].tobytes(), s[s > 0].tobytes()))
    return pa.Table.from_batches([_batch(out, {"chunk": pa.int64(), "bucket": pa.int32(), "data": pa.binary(), "steps": pa.binary()})])


def _prefixes(buckets: int):
    """A chunk's sets and the answers to it, to the blocks of each set, the rarest shingles first."""

    def run(key: tuple[pa.Scalar, ...], sets: pa.Table, answers: pa.Table) -> pa.Table:
        keys, steps = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        if answers.num_rows:
            data = [np.frombuffer(x, "<u4").astype(np.int64) for x in answers.column("data").to_pylist()]
            keys = np.concatenate([x | b << 32 for x, b in zip(data, answers.column("bucket").to_pylist())])
            steps = np.frombuffer(b"".join(answers.column("steps").to_pylist()), np.uint8)
            order = np.argsort(keys)
            keys, steps = keys[order], steps[order]
        out: list[list] = [[], [], [], []]
        for node, n, shingles in zip(*(sets.column(c).to_pylist() for c in ("node", "n", "shingles"))):
            if not len(keys):
                break
            k = np.unique(_block_key(np.frombuffer(shingles, np.uint64), buckets))
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            held = keys[at] == k
            k, s = k[held], steps[at[held]]
            take = n - need(n) + 1 - (n - len(k))  # those that no other set holds come first
            if take > 0:
                pick = k[np.lexsort((k, s))[:take]]
                for col, x in zip(out, (pick.tolist(), range(len(pick)), [node] * len(pick), [n] * len(pick))):
                    col.extend(x)
        return pa.table([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32()))], names=["shingle", "rank", "node", "n"])

    return run


def _packed(c: np.ndarray) -> bytes:
    """A point in half a byte for each coordinate, or one, or four, as its counts need."""
    if c.max(initial=0) < 16:
        return (c[::2] | c[1::2] << 4).astype(np.uint8).tobytes()
    return c.astype(np.uint8 if c.max() < 256 else np.uint32).tobytes()


def _unpacked(points: list[bytes]) -> np.ndarray:
    out = np.empty((len(points), GROUPS), np.int32)
    for row, p in zip(out, points):
        if len(p) == GROUPS // 2:
            half = np.frombuffer(p, np.uint8)
            row[::2], row[1::2] = half & 15, half >> 4
        else:
            row[:] = np.frombuffer(p, np.uint8 if len(p) == GROUPS else np.uint32)
    return out.astype(np.int16) if out.max(initial=0) < 2**15 else out


@lean
def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([(s, _packed(counts(np.frombuffer(x, np.uint64)))) for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], {"of": pa.int64(), "point": pa.binary()})


# --- 4. the R-tree in a block ---------------------------------------------------


def _passes(overlap, n, m):
    """Whether so much overlap allows a similarity of 0.8 for sets of n and m."""
    return 9 * overlap >= 4 * (n + m)


def pack(n: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Order in which points fill the leaves: by size, then tiled by the coordinates that vary most."""
    if len(n) <= LEAF:
        return np.arange(len(n))
    vary = np.argsort(-v.var(axis=0))[:2]
    tile = np.empty(len(n), np.int64)
    by = np.lexsort((v[:, vary[0]], n // max(1, int(n.min() // 16 + 1))))
    width = LEAF * max(1, int(np.sqrt(len(n) / LEAF)))
    tile[by] = np.arange(len(n)) // width
    return np.lexsort((v[:, vary[1]], tile))


class Tree:
    """An R-tree over packed points, from the points upward: ``LEAF`` children for each node.

    A node has the upper corner of its box, the least and largest set in it, and
    the group of its points if they have one in common (else -1).
    """

    def __init__(self, n: np.ndarray, v: np.ndarray, group: np.ndarray):
        self.levels = [(v, n, n, group)]
        while len(self.levels[-1][1]) > LEAF:
            upper, small, large, one = self.levels[-1]
            cut = np.arange(0, len(small), LEAF)
            same = np.minimum.reduceat(one, cut) == np.maximum.reduceat(one, cut)
            self.levels.append((np.maximum.reduceat(upper, cut), np.minimum.reduceat(small, cut), np.maximum.reduceat(large, cut), np.where(same, one[cut], -1)))

    def fit(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of nodes of a level, which may hold a pair of points that links, and the bounds of their overlap."""
        upper, small, large, one = self.levels[level]
        ok = (5 * large[j] >= 4 * small[i]) & (5 * large[i] >= 4 * small[j]) & ((one[i] != one[j]) | (one[i] < 0))
        at = np.flatnonzero(ok)
        bound = np.zeros(len(at), np.int64)
        for lo in range(0, len(at), COMPARED):
            a, b = i[at[lo : lo + COMPARED]], j[at[lo : lo + COMPARED]]
            bound[lo : lo + COMPARED] = np.minimum(upper[a], upper[b]).sum(axis=1, dtype=np.int64)
        good = _passes(bound, small[i[at]], small[j[at]])
        return at[good], bound[good]

    def pairs(self, below: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (i, j), i < j, of points whose bound passes, with the bounds; with ``below``, only of points that share a node of that level."""
        top = len(self.levels) - 1
        size = len(self.levels[top][1])
        if below is not None and top >= below:
            top, size = below, len(self.levels[below][1])
            i = j = np.arange(size)
        else:
            i, j = np.triu_indices(size, 0 if top else 1)
        for level in range(top, -1, -1):
            at, bound = self.fit(level, i, j)
            i, j = i[at], j[at]
            if level:  # to the children of both
                child = np.arange(LEAF)
                a, b = (x.ravel() for x in np.broadcast_arrays((LEAF * i)[:, None, None] + child[:, None], (LEAF * j)[:, None, None] + child))
                last = len(self.levels[level - 1][1])
                keep = (a < last) & (b < last) & (a < b if level == 1 else a <= b)
                i, j = a[keep], b[keep]
        return i, j, bound


def _forest(groups: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of edges between groups, the best first, those of the best spanning forest."""
    label, left, keep = np.arange(groups), np.arange(len(a)), []
    while True:
        x, y = label[a[left]], label[b[left]]
        left, x, y = (z[x != y] for z in (left, x, y))
        if not len(left):
            return np.sort(np.concatenate([np.zeros(0, np.int64), *keep]))
        best = np.full(groups, len(left))
        np.minimum.at(best, x, np.arange(len(left)))
        np.minimum.at(best, y, np.arange(len(left)))
        chosen = np.unique(best[best < len(left)])
        keep.append(left[chosen])
        x, y = x[chosen], y[chosen]
        while (label[x] != label[y]).any():
            low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]


#: Which of the pairs that pass a block names: those that join its groups in the lower tree, in all of it, besides a few for each point, all.
NEAR, JOINING, FEW, ALL = "near", "joining", "few", None


def block_pairs(n: np.ndarray, v: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, named: str | None = ALL):
    """Pairs of places (i, j) in one block whose overlap bound passes and whose groups differ.

    A pair is compared if one of it is in ``left`` and the other in ``right``.
    """
    order = pack(n, v)
    i, j, bound = Tree(n[order], v[order], group[order]).pairs(2 if named == NEAR else None)
    i, j = order[i], order[j]
    ok = (left[i] & right[j]) | (right[i] & left[j])
    i, j, bound = i[ok], j[ok], bound[ok]
    if named is ALL or len(i) < 2:
        return i, j
    by = np.argsort(-bound / (n[i] + n[j]), kind="stable")
    i, j = i[by], j[by]
    pick = np.zeros(len(i), bool)
    pick[_forest(int(group.max()) + 1, group[i], group[j])] = True
    if named == FEW:
        for x in (i, j):
            order = np.argsort(x, kind="stable")
            start = np.flatnonzero(np.r_[True, np.diff(x[order]) > 0])
            pick[order] |= np.arange(len(x)) - np.repeat(start, np.diff(np.r_[start, len(x)])) < NEAREST
    return i[pick], j[pick]


def _search(named: str | None):
    """Sorted rows (shingle, part, node, n, root, inside, point) to the pairs that blocks name, one block after another."""

    def pairs(rows: list[tuple]) -> list[tuple]:
        shingle, _, node, n, root, inside, point = zip(*rows)
        roots = {r: i for i, r in enumerate(dict.fromkeys(root))}
        if len(roots) < 2:
            return []
        every = np.ones(len(rows), bool)
        i, j = block_pairs(np.array(n, np.int64), _unpacked(point), np.array([roots[r] for r in root]), np.array(inside), every, named)
        return [(min(node[x], node[y]), max(node[x], node[y]), shingle[0]) for x, y in zip(i.tolist(), j.tolist())]

    kinds = dict.fromkeys(("a", "b", "shingle"), pa.int64())

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of one part of one block
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:2] != held[-1][:2]:
                    found += pairs(held)
                    held = []
                held.append(row)
            yield _batch(found, kinds)
        if held:
            yield _batch(pairs(held), kinds)

    return run


@lean
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sets to pairs and whether they link."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.intersect1d(x, y, assume_unique=True).size
            ok.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])


# --- 5. the join ----------------------------------------------------------------


def _meeting(blocks: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``(shingle, node, n, root, points, major)``: the rows of blocks in which several components meet."""
    rows = blocks.select("shingle", "node", "n")
    if roots is None:
        rows = rows.withColumn("root", F.col("node"))
    else:
        rows = rows.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("shingle", "node", "n", F.coalesce("root", "node").alias("root"))
    each = rows.groupBy("shingle", "root").agg(F.count("*").alias("c"))
    sizes = each.groupBy("shingle").agg(F.sum("c").alias("points"), F.max_by("root", "c").alias("major"), F.count("*").alias("roots"))
    return rows.join(sizes.where("roots > 1").drop("roots"), "shingle")


def _named(meeting: DataFrame, points: DataFrame, named: str | None) -> DataFrame:
    """``(a, b, shingle)``: the pairs that the blocks name."""
    parts = F.ceil(F.col("points") / PART).cast("int")
    rows = meeting.withColumns({"parts": parts, "own": F.pmod(F.xxhash64("node", "n"), parts).cast("int")})
    # the first round looks at each part alone
    stays = F.lit(True) if named == NEAR else F.col("root") == F.col("major")
    rows = rows.withColumn("part", F.explode(F.when(stays, F.array("own")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    rows = rows.select("shingle", "part", "node", "n", "root", (F.col("part") == F.col("own")).alias("inside"))
    rows = rows.join(points, F.col("node") == F.col("of")).select("shingle", "part", "node", "n", "root", "inside", "point")
    return rows.repartition("shingle", "part").sortWithinPartitions("shingle", "part", "node").mapInArrow(_search(named), "a long, b long, shingle long")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, linked)`` of distinct pairs; of a node with several sets, any may link."""
    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return materialize(both.mapInArrow(_verify, "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked")))


def _joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, root)`` after more edges."""
    x, y = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    lifted = edges.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    up = connected_components(lifted)
    up = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return materialize(old.union(up.join(roots, "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))))


def _components(blocks: DataFrame, points: DataFrame, sets: DataFrame, tied: DataFrame) -> DataFrame:
    """``(node, root)`` of all nodes that link with another one or are tied to it; the root is the least node."""
    pairs = _named(_meeting(blocks.where(F.col("rank") < FIRST), None), points, NEAR).select("a", "b").distinct()
    known = _linked(pairs, sets)
    roots = materialize(connected_components(known.where("linked").select("a", "b").union(tied)))
    for named in (JOINING, FEW, ALL):
        blocks = materialize(_meeting(blocks, roots))
        if not blocks.limit(1).count():
            break
        found = materialize(_named(blocks, points, named))
        fresh = found.select("a", "b").distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
        more = _linked(fresh, sets)
        if more.where("linked").limit(1).count():
            roots = _joined(roots, more.where("linked").select("a", "b"))
        known = known.union(more)
        # a block is done when what it named came true
        wrong = found.join(known.where("not linked"), ["a", "b"], "left_semi").select("shingle").distinct()
        blocks = blocks.select("shingle", "node", "n").join(wrong, "shingle", "left_semi")
    return roots


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each id of ``docs``.

    ``component_id`` is the smallest id that links reach, the id itself
    included. Texts that are null or hold no word have no shingles and link
    with nothing, not even each other. Rows with the same id count as one
    document (the largest set gives ``n_shingles``; links of any of them
    count); a null id keeps its row, with a null component. Other columns are
    ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stats = materialize(shared_counts(docs))
    copies = stats.where("doc_id is not null and n > 0 and 5 * shared >= 4 * n").select("doc_id", "sid")
    first = materialize(copies.groupBy("sid").agg(F.min("doc_id").alias("node")))
    firsts, count = first.select(F.col("node").alias("doc_id")).distinct(), first.count()
    texts = docs.join(small_or_shuffled(firsts, count), "doc_id", "left_semi").select("doc_id", F.col("text").cast("binary"))
    sets = texts.mapInArrow(_sets, "chunk long, node long, sid binary, n int, shingles binary")
    sets = materialize(sets.join(small_or_shuffled(first, count), ["sid", "node"], "left_semi"))
    # rows that repeat an id with its text repeat a set
    repeated = materialize(sets.groupBy("sid").agg(F.count("*").alias("c")).where("c > 1").select("sid"))
    if repeated.limit(1).count():
        once = sets.join(repeated, "sid", "left_semi").dropDuplicates(["sid"])
        sets = materialize(sets.join(repeated, "sid", "left_anti").unionByName(once))
    sets = sets.drop("sid")
    buckets = max(8, int(sets.agg(F.sum("n")).first()[0] or 0) * 6 // BUCKET_BYTES)
    answers = sets.select("chunk", "shingles").mapInArrow(_questions(buckets), "bucket int, chunk long, data binary, times binary")
    answers = answers.groupBy("bucket").applyInArrow(_frequencies, "chunk long, bucket int, data binary, steps binary")
    blocks = sets.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_prefixes(buckets), "shingle long, rank int, node long, n int")
    points = materialize(sets.select("node", "shingles").mapInArrow(_points, "of long, point binary"))
    # an id with several texts ties their nodes
    of_doc = materialize(copies.join(small_or_shuffled(first, count), "sid").select("doc_id", "node"))
    tied = of_doc.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b")
    tied = of_doc.join(tied, "doc_id").select(F.col("node").alias("a"), "b")
    roots = _components(materialize(blocks), points, sets, tied)
    of_doc = of_doc.join(roots, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "node")).alias("component_id"))
    sizes = stats.groupBy("doc_id").agg(F.max("n").alias("n_shingles"))
    return sizes.join(of_doc, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
