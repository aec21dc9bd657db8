"""Operators 11 to 13: the library's own counts, SQL, brute force, odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tests.conftest import DATA
from tidemark.llm import lexical_search, resampling, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (-1, None), (-2, ""), (-3, " "), (-4, "\n"), (-5, "\n\n a\n  b \n"), (-6, "a  b   c"), (-7, "▁ a▁▁b ▁"), (-8, "x" * 5000), (-9, "漢字" * 3000 + " 語"), (-10, "\x00a\x00 \x00"), (-11, "<s>x</s> <unk>"),
    (-12, "é ☃ 🎉🎉"), (-13, "a\tb\r\nc"), (-14, "abc" * 400 + "\n" + "def" * 300), (-15, "=-" * 300 + "  "), (-16, "the same words " * 20_000), (-16, "the same words " * 20_000), (-16, "other words"), (None, "nameless"), (None, None),
]


def table(spark, rows, key="doc_id"):
    """Rows with more columns, whose names clash with those of results."""
    return spark.createDataFrame([(*r, "x", 7, 0.5, "y") for r in rows], f"{key} long, text string, rank string, n int, score double, n_tokens string")


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("share", [token_counts.SHARE, 64, 1])
def test_token_counts_are_the_librarys(spark, monkeypatch, share):
    """With few or no pre-tokens broadcast, the join gives the same."""
    monkeypatch.setattr(token_counts, "SHARE", share)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [*map(tuple, texts), *ODD]
    got = token_counts.count(table(spark, rows).repartition(5), MODEL, 1000).collect()
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 1000) for i, t in rows]
    assert ordered(map(tuple, got)) == ordered(want)
    assert token_counts.count(table(spark, []), MODEL, 1000).count() == 0


def test_token_counts_when_a_task_hands_on_often(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "HELD", 50)
    monkeypatch.setattr(token_counts, "HELD_LONG", 1000)
    monkeypatch.setattr(token_counts, "BATCH", 3)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_counts.count(table(spark, ODD), MODEL, 4096)
    assert ordered((r.doc_id, r.n_tokens) for r in got.collect()) == ordered((i, len(model.encode(t or ""))) for i, t in ODD)


def test_pre_tokens_that_share_a_hash_are_joined(spark, monkeypatch):
    """Of two frequent keys with one hash, or a frequent and a rare one, neither may be told by it."""
    frequent = token_counts.Frequent(np.array([5, 9, 5, 2]), np.array([1, 300, 3, 4]))
    assert frequent.of(np.array([2, 5, 9, 7])).tolist() == [4, 0, 300, 0]
    frequent.strike(np.array([9]))
    assert frequent.of(np.array([2, 9])).tolist() == [4, 0]
    monkeypatch.setattr(token_counts, "SHARE", 4)
    words = spark.createDataFrame([("a", 1, 2, 50), ("b", 2, 3, 40), ("c", 1, 5, 10), ("d", 3, 7, 1)], "key string, hash long, n_pieces long, n long")
    spread, rare = token_counts.frequent(words)
    assert spread.value.of(np.array([1, 2, 3])).tolist() == [0, 3, 0]
    assert {tuple(r) for r in rare.collect()} == {("a", 2), ("c", 5), ("d", 7)}


def test_each_distinct_pre_token_is_counted_once(spark):
    words = token_counts.vocabulary(table(spark, [(k, f"the word {'x' * (k % 3)} \nend") for k in range(300)]).repartition(6), MODEL).collect()
    assert {r.key: r.n for r in words} == {"the": 300, "word": 300, "": 100 + 300, "x": 100, "xx": 100, "\nend": 300}.items() or len(words) == len({r.key for r in words})
    assert len(words) == len({r.key for r in words}) and sum(r.n for r in words if r.key == "the") == 300


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.mark.parametrize("order", [1, 3])
def test_resampling_against_a_plain_loop(spark, order):
    rng = random.Random(5)
    vocabulary = ["The", "of", "straße", "x1", "Ωmega", "naïve", "42", "\x00a", "b_c"]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for k in range(400)]
    rows += [(k, rows[7][1]) for k in range(500, 520)] + [*ODD, (3, rows[3][1])]
    target = [" ".join(rng.choices(vocabulary[:3], k=30)), None, ""]

    def features(text):
        w = _words(text)
        return Counter(zlib.crc32(" ".join(w[k : k + n]).encode()) % 512 for n in range(1, order + 1) for k in range(len(w) - n + 1))

    s, t = sum((features(x) for _, x in rows), Counter()), sum((features(x) for x in target), Counter())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 512) / ((s[b] + 1) * (t.total() + 512)))) for b in range(512)]
    want = []
    for i, x in rows:
        h = int(hashlib.sha256(f"9:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in features(x).items())
        want.append([i, features(x).total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(_words(x))])
    able = sorted((r for r in want if r[4] >= 12), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: len(able) * 25 // 100])}
    got = resampling.resample(table(spark, rows).repartition(4), table(spark, list(enumerate(target)), "item_id"), 512, order, 9, 12, 25)
    assert ordered(map(tuple, got.collect())) == ordered((*r[:4], ranks.get(id(r))) for r in want)


def test_resampling_of_empty_tables(spark):
    docs, none = table(spark, [(1, "a b c"), (2, None)]), table(spark, [])
    assert resampling.resample(none, docs).count() == 0
    assert {r.doc_id: (r.n_features, r.rank) for r in resampling.resample(docs, none, least_words=1, share=100).collect()} == {1: (3, 1), 2: (0, None)}


def _brute(docs, items, k, scale):
    own = [(i, Counter(_words(t))) for i, t in docs]
    n, length = sum(bool(c) for _, c in own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in own:
            m = 100 - scale + scale * c.total() * n // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(_words(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("sizes", [(4096, 16, 4), (16, 3, 2)])
def test_search_against_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "FAN", "ITEM_FAN"), sizes, strict=True):
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(vocabulary[min(299, int(rng.expovariate(0.03)))] for _ in range(n))
    docs = [(k, text(rng.randint(0, 80))) for k in range(700)]
    docs += [(k, docs[5][1]) for k in range(1000, 1040)] + [*ODD, (5, docs[5][1]), (None, docs[6][1])]  # ties, repeated ids
    items = [(k, text(rng.randint(1, 30))) for k in range(60)] + [(100, None), (101, ""), (102, "unheard-of"), (103, docs[5][1]), (103, docs[5][1]), (None, docs[6][1])]
    got = lexical_search.rank(table(spark, docs).repartition(5), table(spark, items, "item_id"), 10, 90)
    assert ordered(map(tuple, got.collect())) == ordered(_brute(docs, items, 10, 90))


def test_search_in_blocks_of_items_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 200)
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet").limit(12)
    got = lexical_search.rank(docs, items)
    assert ordered(map(tuple, got.collect())) == ordered(_brute(docs.collect(), items.select("item_id", "text").collect(), 10, 90))
    assert lexical_search.rank(docs, items.limit(0)).count() == 0 and lexical_search.rank(docs.limit(0), items).count() == 0


def test_search_prunes(spark):
    """Documents about other things than any item go in whole batches."""
    rng = random.Random(3)
    known = lexical_search.Vocabulary.of((k, " ".join(f"t{k}x{j} common" for j in range(8)).encode()) for k in range(64))
    search = lexical_search.Search(lexical_search.Items(known, np.where(np.arange(len(known.number)) == known.number[b"common"], 1, 5000)), 10)
    rows = []
    for _ in range(4096):
        k = rng.randrange(64)
        own = sorted({known.number[b"common"], *(known.number[f"t{k}x{rng.randrange(8)}".encode()] for _ in range(4))})
        rows.append((np.array(own), np.array([500] * len(own))))
    search.see(np.arange(4096), rows)
    assert all(len(best) == 10 for best in search.best) and search.scored < 0.1 * 4096 * 64


@pytest.mark.parametrize("name", ["op12_resampling", "op13_lexical_search"])
def test_queries_equal_their_sql(spark, name):
    from tidemark.llm import queries

    with duckdb.connect() as db:
        for t in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.01/{t}.parquet'")
        found = db.execute(queries.ORACLE_SQL[name])
        columns, rows = [d[0] for d in found.description], found.fetchall()
    assert ordered(map(tuple, queries.QUERIES[name](spark, f"{DATA}/sf0.01").select(columns).collect())) == ordered(rows)
