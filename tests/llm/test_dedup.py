"""Operators 3 and 4 against brute force, and their odd inputs."""

import random
import re

import numpy as np
import pytest

from tests.conftest import DATA
from tidemark.llm import embedding_dedup, sketch_dedup
from tidemark.llm import text as T
from tidemark.llm.components import connected_components

LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute(texts, percent):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * (n := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - n)]
    return {i: len(s) for i, s in sets.items()}, components(sets, links)


def test_word_hashes_name_words():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "Bb", "ccc", "é", "", "\n", "x\u00a0y"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    texts += [None, "", " \t\n", "y" * 300_000 + " Z", "A a"]
    seen = {}
    for text, hashes in zip(texts, T.words(texts), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        assert len(words) == len(hashes)
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes, strict=True))
        assert len(T.shingles(hashes)) == len(shingle_set(text))
    assert len(set(seen.values())) == len(seen)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 900).astype(np.uint64) for _ in range(2))
    both = np.concatenate((a, b))
    assert (sketch_dedup.merge(sketch_dedup.registers(a), sketch_dedup.registers(b)) == sketch_dedup.registers(both)).all()
    near = np.concatenate((a[:860], b[:40]))
    for other, expected in ((near, True), (b, False), (a[:400], False)):
        x, y = sketch_dedup.registers(a), sketch_dedup.registers(other)
        got = sketch_dedup.may_link(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([len(a)]), np.array([len(other)]), 0.85)
        assert got[0] == expected


@pytest.mark.parametrize("sf, percent", [("sf0.001", 85), ("sf0.001", 80)])
def test_near_duplicates_equal_brute_force(spark, sf, percent):
    docs = spark.read.parquet(f"{DATA}/{sf}/documents.parquet")
    n, component = brute({r.doc_id: r.text for r in docs.collect()}, percent)
    got = {r.doc_id: r for r in sketch_dedup.near_duplicates(docs, percent / 100).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == n
    assert {i: r.component_id for i, r in got.items()} == component
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_a_family_of_close_and_not_so_close_copies(spark):
    """Most pairs of a family do not link, chains and shared passages do, and blocks are smaller than the family."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = {}
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts[i] = " ".join(words)
    texts |= {200 + i: " ".join(base[:60] + [rng.choice(vocabulary) for _ in range(80)]) for i in range(20)}
    block, sketch_dedup.BLOCK = sketch_dedup.BLOCK, 32
    try:
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in sketch_dedup.near_duplicates(docs, 0.85).collect()}
    finally:
        sketch_dedup.BLOCK = block
    assert got == brute(texts, 85)[1]


def test_odd_documents(spark):
    same = "one two three four five six"
    rows = [(7, None, "x"), (8, "", "x"), (9, " \n\t", "x"), (5, same, "x"), (3, same.upper(), "x"), (4, "one two", "x"), (6, "ONE two", None), (6, "ONE two", None), (None, same, "x"), (10, "z " * 200_000, "x")]
    docs = spark.createDataFrame([(*r, r[0], 1, 2) for r in rows], "doc_id long, text string, source string, component_id long, n long, kept int")
    got = sorted(tuple(r) for r in sketch_dedup.near_duplicates(docs).collect())
    assert got == [(3, 2, 3, True), (4, 1, 4, True), (5, 2, 3, False), (6, 1, 4, False), (6, 1, 4, False), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 1, 10, True)]
    empty = sketch_dedup.near_duplicates(docs.limit(0))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0


@pytest.mark.parametrize("at_once", [1, 7, 1 << 22])
def test_shared_hashes_are_counted_from_postings(monkeypatch, at_once):
    monkeypatch.setattr(sketch_dedup, "POSTINGS", at_once)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 30), dtype=np.uint64) * np.uint64(2**58)) for _ in range(40)]
    postings = sketch_dedup._Postings(sets)
    for k, one in enumerate(sets):
        assert postings.shared(k).tolist() == [len(np.intersect1d(one, other)) for other in sets]


def test_joined_rows_are_one(spark):
    """A row that links with one of those that hang together has nothing left to find among them; copies on both sides
    are one; an id of -1 or 0 is as any other."""
    base = [f"w{k}" for k in range(40)]
    text = lambda k: " ".join(base[: 40 - k] + [f"x{k}y{j}" for j in range(k)])
    rows = [(5, "", i, text(0), 1, True) for i in (-1, 0, 1)] + [(5, "", i, text(1), side, False) for i in (7, 8) for side in (0, 1)] + [(5, "", 9, "some thing else all together here", side, False) for side in (0, 1)]
    met = spark.createDataFrame(rows, "task long, part string, rep long, text string, side int, joined boolean")
    edges = [tuple(r) for r in sketch_dedup._checked(met, 0.8).collect()]
    assert len(edges) == 2 and {i for e in edges for i in e} >= {7, 8} and 9 not in {i for e in edges for i in e}
    assert len([e for e in edges if {*e} & {-1, 0, 1}]) == 1


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(100, 164)]
    star = [(5, k) for k in range(200, 260)] + [(5, 5), (None, 4)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(path + star, "src long, dst long")).collect()}
    assert got == {k: 100 for k in range(100, 165)} | {k: 5 for k in [5, *range(200, 260)]}
    ends = [(9, 1), (9, 2), (3, 2), (30, 20), (20, 10), (50, 40)]  # two ends up, a chain, a star already
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(ends, "src long, dst long")).collect()}
    assert got == {9: 1, 2: 1, 3: 1, 1: 1, 30: 10, 20: 10, 10: 10, 50: 40, 40: 40}
    assert connected_components(spark.createDataFrame(ends, "src long, dst long").limit(0)).count() == 0


def _vectors(rng, groups):
    rows = []
    for size in groups:
        centre = rng.standard_normal(32)
        rows += [centre * rng.uniform(0.5, 3) + rng.standard_normal(32) * 0.12 * np.linalg.norm(centre) / np.sqrt(32) for _ in range(size)]
    return rows


@pytest.mark.parametrize("target", [1.0, embedding_dedup.TARGET_RECALL])
def test_embeddings_against_brute_force(spark, target):
    rng = np.random.default_rng(4)
    vectors = _vectors(rng, [1] * 300 + [2] * 60 + [40, 90])
    vectors += [vectors[0], vectors[400], vectors[400]]
    blocks = embedding_dedup.INDEX_BLOCK, embedding_dedup.QUERY_BLOCK, embedding_dedup.CELL
    embedding_dedup.INDEX_BLOCK, embedding_dedup.QUERY_BLOCK, embedding_dedup.CELL = 16, 32, 8
    try:
        df = spark.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, id long")
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, 0.95, target).collect()}
    finally:
        embedding_dedup.INDEX_BLOCK, embedding_dedup.QUERY_BLOCK, embedding_dedup.CELL = blocks
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = np.triu(x @ x.T >= 0.95, 1)
    n = (links | links.T).sum(1)
    if target == 1:
        assert [got[i].n_links for i in range(len(x))] == n.tolist()
        assert {i: r.component_id for i, r in got.items()} == components(range(len(x)), zip(*np.nonzero(links), strict=True))
    found = sum(r.n_links for r in got.values())
    assert 0.99 * n.sum() <= found <= n.sum()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 3.0]), (11, [1.0, 2.0]), (None, [1.0, 2.0]), (12, [-1.0, -2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    alone = {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 12)}
    assert got == alone | {7: (2, 7, True), 8: (2, 7, False), 11: (2, 7, False)}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_every_length_are_compared(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TOGETHER", 40)
    rng = np.random.Generator(np.random.PCG64(4))
    rows = []
    for d, n in ((2, 3), (3, 30), (64, 120), (8, 60)):
        base = rng.standard_normal((n, d)).astype(np.float32)
        for v in base:
            rows += [v.tolist(), (v + 0.02 * rng.standard_normal(d).astype(np.float32)).tolist()]
    rows += [[1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [0.0, 0.0], [float("nan"), 1.0], None, [None, 1.0], []]
    table = spark.createDataFrame([(k, v, "x") for k, v in enumerate(rows)], "vec_id long, embedding array<float>, n_links string")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, 0.95).collect()}
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok[k] else None for k, v in enumerate(rows)]
    near = {k: {j for j in range(len(rows)) if j != k and ok[k] and ok[j] and len(rows[j]) == len(rows[k]) and unit[k] @ unit[j] >= 0.95} for k in range(len(rows))}
    up = list(range(len(rows)))
    for _ in rows:
        up = [min([up[k], *(up[j] for j in near[k])]) for k in range(len(rows))]
    assert all(got[k].n_links == len(near[k]) and got[k].component_id == up[k] and got[k].kept == (up[k] == k) for k in range(len(rows)))


@pytest.mark.parametrize("together", [0, 1 << 20])
def test_recall_of_planted_links_over_many_cells(spark, monkeypatch, together):
    """Dealt out by cells, and in one task: links that only a visit to another cell can find, and a family of hundreds."""
    for name, value in (("TOGETHER", together), ("CELL", 32), ("CELL_ROOT", 0.1), ("INDEX_BLOCK", 64), ("QUERY_BLOCK", 128)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(12)
    spread = rng.standard_normal((24, 64))  # cells follow loose clusters
    vectors = [spread[k % 24] + 1.3 * rng.standard_normal(64) for k in range(2000)]
    for size, scale in ((300, 0.035), *[(4, 0.035)] * 300, *[(2, 0.028)] * 200):
        centre = spread[rng.integers(24)] + 1.3 * rng.standard_normal(64)
        vectors += [centre + scale * np.linalg.norm(centre) * rng.standard_normal(64) for _ in range(size)]
    x = np.array(vectors, np.float32).astype(float)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = np.concatenate([(x[at : at + 1000] @ x.T >= 0.95).sum(axis=1) - 1 for at in range(0, len(x), 1000)])
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table, 0.95).collect()}
    found = np.array([found[k] for k in range(len(x))])
    grid = embedding_dedup.fit(x, len(x), 0.95)
    cell, (a, b) = grid.places(x)
    met = np.array([sum(1 for _ in grid.visits(p, q)) for p, q in zip(a, b, strict=True)])
    assert len(grid.codes[0]) >= 8 and len(grid.codes[1]) >= 8 and len(np.unique(cell)) >= 64 and (met > 1).sum() > 100
    assert links.sum() > 2000 and (found <= links).all() and found.sum() >= 0.99 * links.sum()
    assert len(np.unique(cell)) > met.mean()  # not all cells are visited


@pytest.mark.parametrize("threshold", [0.95, 0.5])
def test_recall_on_the_embeddings_table(spark, threshold):
    table = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, threshold).collect()}
    rows = [(r.vec_id, r.embedding) for r in table.collect() if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding) and any(r.embedding)]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = np.concatenate([(x[at : at + 1000] @ x.T >= threshold).sum(axis=1) - 1 for at in range(0, len(x), 1000)])
    found = np.array([got[i].n_links for i, _ in rows])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
