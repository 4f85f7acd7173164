"""Near-duplicate embeddings by rotated binary codes with correction factors.

* Equal vectors become one point with a weight.
* Points meet in the buckets of several tables. A table takes some sign bits of
  the vector under random rotations; two vectors at the threshold agree in a bit
  with probability ``1 - angle / pi``, and there are as many tables as it takes
  to bring them together with probability 0.997. The number of bits grows with
  the logarithm of the number of points, so buckets keep their size.
* In a bucket, the sign code of one point and the rotated vector of the other
  give an unbiased estimate of their inner product, divided by the stored
  factor <code, vector>. Its confidence bound leaves only the pairs that may
  reach the threshold; they alone are computed anew, exactly, in double precision.
* A pair that meets in several tables is counted in the first. Tasks send counts
  of links and the edges of a spanning forest, not pairs, so what they send
  grows with the points, even where a third of all points are alike.

Large buckets are cut in parts; pairs of parts are searched in different tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import connected_components, materialize, small_or_shuffled

THRESHOLD = 0.95
#: Probability that a pair at the threshold meets in no table.
MISS = 0.003
#: Points that a bucket is meant to hold.
BUCKET = 32
PART = 1_024
#: Standard deviations of the estimate that the bound allows for.
SIGMAS = 4.5


def shape(points: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits of a table and number of tables for so many points."""
    bits = max(6, math.ceil(math.log2(max(2, points) / BUCKET)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree))


@lru_cache(maxsize=8)
def rotations(d: int, bits: int) -> np.ndarray:
    """``(d, bits)``: columns of random orthogonal matrices, the same everywhere."""
    rng = np.random.default_rng(20240 + d)
    out = [np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-bits // d))]
    return np.concatenate(out, axis=1)[:, :bits]


@lru_cache(maxsize=8)
def code_rotation(d: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(7 + d).standard_normal((d, d)))[0]


def encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes (bool) of unit vectors and their factors <code, vector>."""
    r = v @ code_rotation(v.shape[1])
    return r > 0, np.abs(r).sum(axis=1) / math.sqrt(v.shape[1])


def estimate(query: np.ndarray, code: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Unbiased estimates of <query, vector> from rotated queries and the codes of vectors."""
    d = query.shape[1]
    return (query @ (2.0 * code - 1).T) / (math.sqrt(d) * factor)


def error(factor: np.ndarray, d: int) -> np.ndarray:
    """Standard deviation of the estimates for vectors with these factors."""
    return np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, d - 1))


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square leaves its range."""
    v = np.stack([np.frombuffer(x, kind) for x in raw]).astype(np.float64)
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _keys(v: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each unit vector in each table."""
    sign = (v @ rotations(v.shape[1], bits * tables) > 0).reshape(len(v), tables, bits)
    return (sign * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def _tables(bits: int, tables: int, kind: str, whole: bool):
    """Points (id, weight, vector) to their bucket rows, one for each table; ``whole`` rows have the point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            out: list[pa.RecordBatch] = []
            for size in sorted({len(x) for x in raw}):
                rows = [i for i, x in enumerate(raw) if len(x) == size]
                keys = _keys(_units([raw[i] for i in rows], kind), bits, tables)
                at = pa.array(np.repeat(rows, tables))
                cols = [pa.array(np.full(len(at), size, np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))), pa.array(keys.ravel())]
                out.append(pa.RecordBatch.from_arrays(cols + [c.take(at) for c in batch.columns] * whole, names=["d", "t", "key", *["id", "weight", "vector"] * whole]))
            yield from out

    return run


def block_links(v: np.ndarray, code: np.ndarray, factor: np.ndarray, every: np.ndarray, table: int, left: np.ndarray, right: np.ndarray, threshold: float):
    """Places (i, j), i < j, of linked pairs of one bucket that meet in no earlier table; and how many were computed exactly."""
    n, d = v.shape
    query = v @ code_rotation(d)
    slack = SIGMAS * error(factor, d)
    found, computed = [], 0
    for lo in range(0, n, 256):
        upper = estimate(query[lo : lo + 256], code, factor) + slack
        ok = (upper >= threshold) & (np.arange(n)[None, :] > np.arange(lo, min(n, lo + 256))[:, None])
        ok &= (left[lo : lo + 256, None] & right[None, :]) | (right[lo : lo + 256, None] & left[None, :])
        i, j = np.nonzero(ok)
        i = i + lo
        # the same bound with the roles exchanged
        for at in range(0, len(i), 200_000):
            a, b = i[at : at + 200_000], j[at : at + 200_000]
            if table:
                first = ~(every[a, :table] == every[b, :table]).any(axis=1)
                a, b = a[first], b[first]
            other = np.einsum("ij,ij->i", query[b], 2.0 * code[a] - 1) / (math.sqrt(d) * factor[a]) + slack[a]
            a, b = a[other >= threshold], b[other >= threshold]
            computed += len(a)
            exact = np.einsum("ij,ij->i", v[a], v[b]) >= threshold
            found.append((a[exact], b[exact]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), computed
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), computed


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among n places."""
    root = np.arange(n)
    while True:  # hook each root to the lowest neighbour, then flatten
        a, b = root[i], root[j]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return [(int(r), k) for k, r in enumerate(root) if r != k]


def _search(threshold: float, bits: int, tables: int, kind: str):
    """Sorted rows of buckets to (id, links, root): links found for a point, or an edge to a root."""

    def block(rows: list[tuple], out: list[tuple]) -> None:
        if len(rows) < 2:
            return
        _, table, _, p, q, part, ids, weight, vector = zip(*rows)
        part = np.array(part)
        v = _units(list(vector), kind)
        code, factor = encode(v)
        i, j, _ = block_links(v, code, factor, _keys(v, bits, tables), table[0], part == p[0], part == q[0], threshold)
        if len(i):
            w = np.array(weight, np.float64)
            links = np.bincount(i, weights=w[j], minlength=len(ids)) + np.bincount(j, weights=w[i], minlength=len(ids))
            out += [(ids[k], int(links[k]), None) for k in np.flatnonzero(links)]
            out += [(ids[b], 0, ids[a]) for a, b in _forest(len(ids), i, j)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(out):
            cols = list(zip(*out)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "links", "root"])

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:5] != held[-1][:5]:
                    block(held, out)
                    held = []
                held.append(row)
            yield flush(out)
        out = []
        block(held, out)
        yield flush(out)

    return run


def embedding_near_dups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each id of ``vectors``.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing; vectors of different length never link. Rows that repeat
    an id become one (of different vectors, the least); a null id keeps a row,
    without component, and is kept. An empty table gives none. Labels and other
    columns are ignored.
    """
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"  # the shorter one holds the same values
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce(finite & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    rows = materialize(rows.withColumn("v", F.when(good, F.col("v"))))
    points = materialize(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    bits, tables = shape(points.count(), threshold)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.asarray(x, kind).tobytes() for x in b.column(2).to_pylist()], pa.binary())], names=["id", "weight", "vector"])

    raw = points.select("id", "weight", "v").mapInArrow(packed, "id long, weight long, vector binary")
    key = ["d", "t", "key"]
    # only keys are counted; buckets over PART points are cut
    sizes = raw.mapInArrow(_tables(bits, tables, kind, False), "d int, t int, key long").groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > PART)
    sizes = materialize(sizes.select(*key, F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    rows_of = raw.mapInArrow(_tables(bits, tables, kind, True), "d int, t int, key long, id long, weight long, vector binary")
    cut = rows_of.join(small_or_shuffled(sizes, sizes.count()), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"p": F.least("part", "o"), "q": F.greatest("part", "o")})
    cut = cut.select(*key, "p", "q", "part", "id", "weight", "vector").repartition(*key, "p", "q").sortWithinPartitions(*key, "p", "q", "id")
    found = materialize(cut.mapInArrow(_search(threshold, bits, tables, kind), "id long, links long, root long"))
    roots = connected_components(found.where("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_point = points.join(links, "id", "left").join(roots, points.id == roots.node, "left")
    of_point = of_point.select("v", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    linked = rows.where("v is not null").join(of_point, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
