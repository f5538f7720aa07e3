"""Ranked lexical search against a search that scores every document."""

import collections
import math
import random
import re

import numpy as np
import pytest

from fieldloom.llm import lexical_search as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def brute(docs, queries, k):
    held = [(i, words(t)) for i, t in docs]
    held = [(i, collections.Counter(w), len(w)) for i, w in held if w]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = collections.Counter(w for _, c, _ in held for w in c)
    asked = collections.defaultdict(set)
    for i, t in queries:
        asked[i].update(words(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, counts, n in held:
            m = 100 - 90 + (90 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in terms if t in counts)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def some_docs(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["THE", "the", "Émile", "日本語", "x1"]
    out = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(n)]
    return out + [(None, out[3][1]), (None, None), (n, None), (n + 1, ""), (n + 2, " .,; \t"), (5, out[5][1]), (5, out[5][1]), (n + 3, "w1 " * 30_000)] + [(n + 10 + i, out[7][1]) for i in range(30)]


QUERIES = [(0, "The w1 w2, w3! émile"), (1, "nowhere"), (2, None), (3, ""), (4, "w7-w8_w9 w10 w11 w12 日本語"), (4, "w13 w14"), (None, "x1 w2 w2"), (6, "w1"), (-7, " ".join(f"w{i}" for i in range(300)))]


def frames(spark, docs, queries):
    # extra columns under names that the operator uses inside
    d = spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id long, text string, id string, query string").repartition(3)
    return d, spark.createDataFrame([(*q, "z") for q in queries], "item_id long, text string, term string")


@pytest.mark.parametrize(("seed", "n", "k", "block"), [(1, 200, 10, ls.BLOCK_TERMS), (2, 40, 3, 150), (3, 9, 100, 400)])
def test_search_equals_scoring_everything(spark, seed, n, k, block, monkeypatch):
    docs = some_docs(seed, n)
    d, q = frames(spark, docs, QUERIES)
    assert got(ls.wand_search(d, q, k, block_terms=block)) == brute(docs, QUERIES, k)


def test_wand_over_many_small_shards():
    rng = random.Random(5)
    for _ in range(60):
        n, n_terms, k = rng.randint(1, 80), rng.randint(1, 9), rng.randint(1, 6)
        triples = sorted((t, d, rng.randint(0, 6)) for t in range(n_terms) for d in range(n) if rng.random() < 0.3)
        if not triples:
            continue
        terms, docs, scores = map(np.array, zip(*triples, strict=True))
        kinds, counts = np.unique(terms, return_counts=True)
        for beaten in (0, 3, 12):
            total = collections.Counter()
            for t, d, s in triples:
                total[d] += s
            want = sorted(((s, d) for d, s in total.items() if s > beaten), key=lambda x: (-x[0], x[1]))[:k]
            assert ls.wand(list(range(n_terms + 2)), ls.Postings(kinds, counts, docs, scores), k, beaten) == want


def test_wand_skips_documents():
    # a rare strong term and a common weak one: once the heap is full, only documents of the strong one are scored
    docs = np.concatenate([np.arange(0, 10_000, 500), np.arange(10_000)])
    scores = np.concatenate([np.full(20, 1000), np.full(10_000, 1)])

    class Counting(list):
        asked = 0

        def __getitem__(self, i):
            Counting.asked += 1
            return super().__getitem__(i)

    postings = ls.Postings(np.array([0, 1]), np.array([20, 10_000]), docs, scores)
    common_list = postings.of(1)
    postings.lists[1] = (common_list[0], Counting(common_list[1]), common_list[2])
    assert ls.wand([0, 1], postings, 3) == [(1001, 0), (1001, 500), (1001, 1000)]
    assert Counting.asked < 30


def test_terms_are_those_of_the_pattern():
    for text in ("A-b_c'D9é", "\x00\x7f\x80ß İSTANBUL", "a" * 100_000 + " B", "😀x 日本 語", "tab\tnl\n"):
        assert [t.decode() for t in ls.terms_in(text)] == words(text)


def test_shards_and_empty_tables(spark, monkeypatch):
    d, q = frames(spark, some_docs(1, 20), QUERIES)
    assert ls.wand_search(d.limit(0), q, 5).count() == 0
    assert ls.wand_search(d, q.limit(0), 5).count() == 0
    with pytest.raises(TypeError):
        ls.wand_search(d.withColumn("doc_id", d["doc_id"].cast("string")), q, 5)


def test_blocks_are_bounded(spark):
    asked = spark.createDataFrame([(i, b"t%d" % j) for i in range(20) for j in range(5)] + [(99, b"t%d" % j) for j in range(50)], "item long, term binary")
    dealt, n = ls._blocks(asked, 8)
    for r in dealt.groupBy("block").agg({"*": "count", "item": "min"}).collect():
        assert r["count(1)"] <= 16 or dealt.where(dealt["block"] == r["block"]).select("item").distinct().count() == 1
    assert n >= 13
