"""The language model's EM pass against all segmentations, and its predictions on held-out documents."""

import collections

import numpy as np
import public_tokenizers as P
import pytest

from fieldloom.llm import language_id, registry

SF = "/root/testdata/sf0.01"


def segmentations(pieces, word):
    """All ways to cut a word into pieces, as lists of piece ids."""
    if not word:
        yield []
    for stop in range(1, min(len(word), pieces.longest) + 1):
        found = pieces.ids.get(word[:stop])
        if found is not None:
            for rest in segmentations(pieces, word[stop:]):
                yield [found, *rest]


def test_expected_counts_are_those_of_all_segmentations(spark):
    path = P.path(registry.PIECES)
    pieces = language_id.Pieces(path)
    rng = np.random.default_rng(1)
    log_probs = np.log(rng.dirichlet(np.full(pieces.size, 0.5), 2).T + 1e-12)
    rows = [("a", b"cat", 3), ("a", b"the", 1), ("b", b"cat", 2), ("b", "né".encode(), 5), ("b", b"xq", 1)]
    words = spark.createDataFrame([(lang, bytearray(w), n) for lang, w, n in rows], "lang string, word binary, n long").repartition(3)
    got = language_id._expected_counts(words, path, ["a", "b"], log_probs)
    want = np.zeros_like(got)
    for lang, word, n in rows:
        column = ["a", "b"].index(lang)
        ways = list(segmentations(pieces, b" " + word))
        weights = np.array([np.exp(sum(log_probs[p, column] for p in way)) for way in ways])
        for way, share in zip(ways, weights / weights.sum(), strict=True):
            for p, times in collections.Counter(way).items():
                want[p, column] += n * share * times
    assert np.allclose(got, want, rtol=1e-6, atol=1e-9) and len(ways) > 1


def test_em_raises_the_likelihood(spark):
    path = P.path(registry.PIECES)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    even = language_id.fit_language_model(docs, path, rounds=0)
    told = []
    for rounds in (1, 3):
        model = language_id.fit_language_model(docs, path, rounds=rounds)
        assert np.allclose(np.exp(model["log_probs"]).sum(axis=0), 1.0)
        scorers = [language_id.Scorer(language_id.Pieces(path), m["log_probs"]) for m in (even, model)]
        texts = [(r["text"], model["langs"].index(r["lang"])) for r in docs.where("lang IS NOT NULL AND text IS NOT NULL").limit(20).collect()]
        told.append([sum(s.score([t])[0][0][k] for t, k in texts if language_id.has_letter(t)) for s in scorers])
    assert told[0][1] > told[0][0] and told[1][1] > told[0][1]


def test_held_out_languages(spark):
    got = registry.op8_language_id(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(got) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95


def test_equal_ids_share_a_turn(spark):
    # rows of one id are all learned from or none; an unlabelled table teaches nothing
    docs = spark.createDataFrame([(1, f"wort nummer {i}", "de") for i in range(30)] + [(2, "a word", "en")], "doc_id long, text string, lang string")
    model = language_id.fit_language_model(docs, P.path(registry.PIECES), rounds=1)
    assert model["langs"] == ["de", "en"] and model["log_prior"] == pytest.approx(np.log([30 / 31, 1 / 31]))
