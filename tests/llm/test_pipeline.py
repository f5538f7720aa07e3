"""The pipeline's stages, one by one, against brute force."""

import collections
import hashlib
import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from fieldloom.llm import piece_model, registry

LANG = {"en": "the house is very large and they have water over there with some bread on a table near the door", "de": "das haus ist sehr gross und wir haben wasser dort mit etwas brot auf dem tisch bei der tür"}


def table():
    rnd = random.Random(11)
    out = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        text = " ".join(rnd.choices(LANG[lang].split(), k=80))
        out.append((len(out), text, lang, f"s{i % 4}"))
        if i % 5 == 0:
            out.append((len(out), text, lang, f"s{i % 4}"))
        if i % 6 == 0:
            words = text.split()
            words[10] = "changed"
            out.append((len(out), " ".join(words), lang, f"s{(i + 1) % 4}"))
    return [*out, (900, None, None, "s0"), (901, "123 456 --", "en", "s1"), (902, "", "de", None)]


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_stages_equal_brute_force(spark, tmp_path):
    rows = table()
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    docs = spark.read.parquet(path)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == columns or name == "bpe"
        seen[name] = docs.collect()
    text = {r[0]: r[1] for r in rows}

    known = {i for i, t in text.items() if t and any(c.isalpha() for c in t)}
    assert {r.doc_id for r in seen["language_id"]} == known

    last = {}
    for i in sorted(known):
        last[text[i]] = i
    assert {r.doc_id for r in seen["exact_dedup"]} == set(last.values())

    left = sorted(last.values())
    parent = {i: i for i in left}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingles(text[i]) for i in left}
    for a in left:
        for b in left:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    kept = {root(i) for i in left}
    assert {r.doc_id for r in seen["near_dedup"]} == kept

    copies = collections.Counter(r.doc_id for r in seen["mix"])
    assert set(copies) <= kept and max(copies.values()) <= 2
    total = sum(len(text[i].split()) for i in kept)
    taken = sum(len(text[i].split()) * n for i, n in copies.items())
    assert abs(taken - 1.5 * total) <= 4 * 81

    ranks = {t: i for i, t in enumerate(piece_model.read_ranks(P.path(registry.RANKS)))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for i, n in copies.items():
        ids = enc.encode_ordinary(text[i])
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[i].encode()).hexdigest()] += n
    assert collections.Counter(map(tuple, seen["bpe"])) == want


def test_run(spark, tmp_path):
    rows = table()[:20]
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
