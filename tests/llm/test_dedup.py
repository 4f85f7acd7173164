"""Near-duplicates of texts and of vectors against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import common, embedding_dedup, ngram_jaccard


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets[i] = s
    ids = sorted(sets)
    edges = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(ids, edges)
    return {i: (len(sets[i]), root[i]) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_join_on_documents(docs):
    assert result(ngram_jaccard.ngram_jaccard_join(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("seed", [1, 2])
def test_join_on_clusters_near_the_threshold(spark, seed, monkeypatch):
    """Mutated copies around 0.8, chains, a passage that all share, blocks cut in parts."""
    monkeypatch.setattr(ngram_jaccard, "PART", 16)
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for c in range(6):
        base = [f"w{r.randrange(4000)}" for _ in range(r.choice([6, 40, 150, 400]))] + passage
        for _ in range(25):
            t = list(base)
            for _ in range(r.randrange(0, max(2, len(t) // 40))):
                t[r.randrange(len(t))] = f"m{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    assert result(ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_join_edge_cases(odd, none):
    got = result(ngram_jaccard.ngram_jaccard_join(odd))
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[4] == (1, 4) and got[5] == (1, 4) and got[6][1] == got[7][1] == 6
    assert got[8] == (1, 8) and got[9] == (1, 9) and got[None] == (1, None)
    assert len(got) == 11
    assert result(ngram_jaccard.ngram_jaccard_join(none)) == {}


def test_same_id_with_several_texts(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "doc_id long, text string")
    assert {i: c for i, (_, c) in result(ngram_jaccard.ngram_jaccard_join(df)).items()} == {1: 1, 2: 1, 3: 1}


def test_each_row_of_an_id_is_judged_by_itself(spark):
    """An id with a long text that nobody shares, and with a short one that is shared."""
    long, short = " ".join(f"u{i}" for i in range(120)), " ".join(f"s{i}" for i in range(14))
    rows = [(1, long), (1, short), (2, short), (3, short + " more"), (3, long), (4, "s0 " + short)]
    got = result(ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == {1: (116, 1), 2: (10, 1), 3: (116, 1), 4: (11, 1)}


def test_nodes_are_tied_through_shared_ids(spark):
    texts = [" ".join(f"{c}{i}" for i in range(9)) for c in "abcd"]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[2]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (7, texts[3]), (8, texts[1]), (9, texts[1])]
    got = result(ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: c for i, (_, c) in got.items()} == {1: 1, 2: 1, 5: 1, 7: 1, 8: 8, 9: 8}


def test_near_copies_in_one_large_block(spark, monkeypatch):
    """Pairs around the threshold, so that bounds pass which sets don't; several parts and rounds."""
    monkeypatch.setattr(ngram_jaccard, "PART", 24)
    monkeypatch.setattr(ngram_jaccard, "FIRST", 1)
    monkeypatch.setattr(ngram_jaccard, "NEAREST", 1)
    r = random.Random(9)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(150):
        t = list(base)
        for _ in range(2 + i % 2):
            t[r.randrange(len(t))] = f"m{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    assert result(ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@given(st.lists(st.lists(st.integers(0, 6), min_size=8, max_size=8), min_size=2, max_size=40), st.integers(0, 1))
@settings(max_examples=60, deadline=None)
def test_tree_finds_every_pair_that_the_bound_allows(points, kind):
    v = np.array(points)
    v[:, 0] += 1
    n = v.sum(axis=1)
    group, one = np.arange(len(v)), np.ones(len(v), bool)
    i, j = ngram_jaccard.block_pairs(n, v, group, one, one, None)
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    want = set()
    for a in range(len(v)):
        for b in range(a + 1, len(v)):
            o = np.minimum(v[a], v[b]).sum()
            if 9 * o >= 4 * (n[a] + n[b]) and 5 * n[a] >= 4 * n[b] and 5 * n[b] >= 4 * n[a]:
                want.add((a, b))
    assert got == want


@pytest.mark.parametrize("top", [3, 15, 255, 300, 70_000])
def test_points_survive_packing(top):
    c = np.random.default_rng(top).integers(0, top + 1, ngram_jaccard.GROUPS)
    c[0] = top
    assert (ngram_jaccard._unpacked([ngram_jaccard._packed(c)])[0] == c).all()


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 530)]
    df = spark.createDataFrame([*edges, (None, 1), (7, 7)], "a long, b long")
    edges = [e for e in edges if e[0] != e[1]]
    want = roots({x for e in edges for x in e}, edges)
    assert {x.node: x.root for x in common.connected_components(df).collect()} == want
    assert common.connected_components(df.where("false")).count() == 0


# --- vectors ----------------------------------------------------------------------


def vectors(seed, n=400, d=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((20, d))
    v = rng.standard_normal((n, d))
    for i in range(0, n, 2):
        v[i] = base[rng.integers(20)] + rng.standard_normal(d) * rng.choice([0.05, 0.2, 0.24])
    v[7] = v[9] = v[11]
    return v.astype(np.float32)


def brute_vectors(rows):
    ok = {i: np.asarray(v, np.float64) for i, v in rows if v is not None and None not in list(v) and np.isfinite(np.asarray(v, np.float64)).all() and np.any(v)}
    ids = sorted(ok)
    edges = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= 0.95]
    root = roots([i for i, _ in rows], edges)
    return {i: (sum(i in e for e in edges), root[i], root[i] == i) for i, _ in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_vectors_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PART", 32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(seed))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_near_dups(df).collect()}
    want = brute_vectors([(i, np.array(v, np.float32)) for i, v in rows])
    assert sum(w[0] for w in want.values()) > 100
    links = sum(min(got[i][0], want[i][0]) for i in want) / sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and links >= 0.99
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_vector_edge_cases(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 0.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, id string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_near_dups(df).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), 6: (2, 6, True), 7: (2, 6, False), 8: (2, 6, False), 9: (0, 9, True), None: (0, None, True)}
    assert embedding_dedup.embedding_near_dups(df.where("false")).count() == 0


def test_estimates_are_unbiased_within_their_bounds():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((2, 2000, 64))
    y = 0.9 * x + 0.4 * y
    x, y = (a / np.linalg.norm(a, axis=1, keepdims=True) for a in (x, y))
    code, factor = embedding_dedup.encode(y)
    q = x @ embedding_dedup.code_rotation(64)
    est = (q * (2.0 * code - 1)).sum(axis=1) / (8 * factor)
    off = est - (x * y).sum(axis=1)
    assert abs(off.mean()) < 0.01
    assert (np.abs(off) < embedding_dedup.SIGMAS * embedding_dedup.error(factor, 64)).mean() > 0.999
