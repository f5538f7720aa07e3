"""The quality classifier: its formula by brute force, its fit by held-out labels, odd inputs."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import common, quality, registry

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    """Share of pairs of a good and a bad document in the right order, ties as half."""
    good, bad = scores[labels == 1], scores[labels == 0]
    return ((good[:, None] > bad).sum() + 0.5 * (good[:, None] == bad).sum()) / (len(good) * len(bad))


def test_margins_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    machine = quality.Machine(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, 4)))
    rows = [(np.sort(rng.choice(quality.FEATURES, n, replace=False)), rng.normal(size=n)) for n in (1, 2, 7, 30)]
    sizes = np.array([len(p) for p, _ in rows])
    got = machine.margins(np.concatenate([p for p, _ in rows]), np.concatenate([x for _, x in rows]), np.cumsum(sizes) - sizes)
    for margin, (p, x) in zip(got, rows, strict=True):
        want = 0.3 + sum(machine.w[i] * v for i, v in zip(p, x, strict=True))
        want += sum(machine.v[p[i]] @ machine.v[p[j]] * x[i] * x[j] for i in range(len(p)) for j in range(i))
        assert math.isclose(margin, want, rel_tol=1e-9, abs_tol=1e-9)


def test_pairs_are_learned_that_no_weight_can_tell():
    # two words that are good together or both absent, bad alone
    texts = {"alpha beta": 1.0, "gamma delta": 1.0, "alpha delta": 0.0, "gamma beta": 0.0}
    rows = [quality.features_of(t, None) for t in texts] * 60
    labels = np.array([*texts.values()] * 60)
    machine = quality.Machine.fit(rows, labels, epochs=40)
    for (p, x), label in zip(rows[:4], labels[:4], strict=True):
        assert (machine.margins(p, x, np.array([0]))[0] > 0) == (label == 1)


def test_features_see_whole_texts_and_no_more_than_the_bins():
    for text in (None, "", " \n\t", "a", "Ünï $$$ !!", "x" * 200_000, "w " * 50_000 + "end", "😀" * 1000, "\x00\x7f"):
        for size in (None, 0, -5, 10**12, len(text or "")):
            places, values = quality.features_of(text, size)
            assert (np.diff(places) > 0).all() and places[-1] < quality.FEATURES and np.isfinite(values).all()
            assert len(places) == len(values) >= len(quality.MEASURES)
            own = places[places >= quality.WORD_BUCKETS] - quality.WORD_BUCKETS
            assert (own // quality.BINS == np.arange(len(quality.MEASURES))).all()
    long = "word " * 100_000
    a, b = quality.features_of(long + "good", None), quality.features_of(long + "evil", None)
    assert not np.array_equal(a[0], b[0])


def test_held_out_labels(spark):
    got = registry.op11_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    assert len(rows) > 80 and 0 < rows.quality.mean() < 1
    assert auc(rows.score.to_numpy(), rows.quality.to_numpy()) > 0.99
    assert (rows.predicted == rows.quality).mean() > 0.97
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    bad = got.where((F.col("score") < 0) | (F.col("score") > 1) | (F.col("predicted") != (F.col("score") >= 0.5).cast("int")) | F.col("score").isNull())
    assert bad.isEmpty()
    held = {r[0]: r[1] for r in got.select("doc_id", "held_out").collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"good plain words number {i % 7}." if i % 2 else f"BUY!!! $$$ {i % 5} ###", "s", 30, "c") for i in range(60)]
    rows += [(None, "no id", "s", 5, "c"), (100, None, None, None, None), (101, "", "s", 0, "c"), (3, "another text of id 3", "s", 1, "c"), (3, "another text of id 3", "s", 1, "c"), (102, "long " * 50_000, "s", 3, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_chars long, label string").repartition(3)


def test_odd_rows(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(60)] + [(3, 0, "x"), (None, 1, "x"), (7, None, "x"), (999, 1, "x")], "doc_id long, quality int, turn string")
    model = quality.fit_quality(docs, labels)
    again = quality.fit_quality(docs.repartition(5), labels.repartition(2))
    assert model.bias == again.bias and np.array_equal(model.w, again.w) and np.array_equal(model.v, again.v)
    got = quality.score_quality(docs, model, keep=["label"]).collect()
    assert len(got) == docs.count() and got[0].asDict().keys() == {"doc_id", "label", "score", "predicted"}
    assert all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[41] > 0.5 > by[40]
    # the score of a row by a fresh computation
    text = docs.where("doc_id = 102").first()
    places, values = quality.features_of(text["text"], text["n_chars"])
    assert math.isclose(by[102], quality._sigmoid(model.margins(places, values, np.array([0])))[0], rel_tol=1e-9)


def test_bounded_sample_and_nothing_to_learn(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    few = quality.fit_quality(docs, labels, fit_rows=10)
    assert not np.array_equal(few.w, quality.fit_quality(docs, labels).w)
    for none in (labels.limit(0), labels.where("false"), labels.withColumn("quality", F.lit(None).cast("int"))):
        assert quality.fit_quality(docs, none) is None
    assert quality.fit_quality(docs.limit(0), labels) is None
    assert {r["score"] for r in quality.score_quality(docs, None).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), few).count() == 0
    assert quality.score_quality(docs, few, size_col=None).count() == docs.count()


def test_memo_changes_nothing():
    memo = common.Memo(20)
    for text in ("a b c d e f g h i j k l m n o p", "a $$ b", "q r s t u v w x y z", "a b c"):
        one, two = quality.features_of(text, 3, memo), quality.features_of(text, 3)
        assert np.array_equal(one[0], two[0]) and np.array_equal(one[1], two[1])
