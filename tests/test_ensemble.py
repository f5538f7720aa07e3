"""The ensemble of forest and boosted trees."""

import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import feedback


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    told = {"Primary": "collected observed net", "Secondary": "cited literature reported", "Uncertain": "perhaps maybe unclear"}
    out = []
    for i in range(150):
        label = rng.choice(list(told))
        # half of the rows tell by their words, half by their vector
        words = rng.choices(told[label].split(), k=5) if i % 2 else []
        vector = [float(list(told).index(label)), rng.random()] if i % 2 == 0 else rng.choice([None, [9.0], [0.5, 0.5]])
        out.append((i, " ".join(words + rng.choices("the of and in".split(), k=4)) if i % 10 else None if i % 20 else "", label, vector, "x"))
    return spark.createDataFrame(out, "i int, text string, label string, v array<double>, confidence string").repartition(3)


def test_words_and_vectors_both_tell(spark, rows):
    model = feedback.fit_ensemble(rows, "v", rounds=4, trees=15)
    assert model.labels == ["Primary", "Secondary", "Uncertain"] and len(model.boosted) == 3
    got = feedback.predict_ensemble(model, rows.select("i", "text", "v", "confidence", F.col("label").alias("truth")), "text", "v").collect()
    assert len(got) == 150 and all(abs(sum(r["probabilities"]) - 1) < 1e-9 and min(r["probabilities"]) >= 0 for r in got)
    assert all(r["confidence"] == max(r["probabilities"]) and r["predicted"] == model.labels[r["probabilities"].index(r["confidence"])] for r in got)
    assert all(r["needs_review"] == (r["confidence"] < feedback.REVIEW_BELOW) for r in got)
    assert sum(r["predicted"] == r["truth"] for r in got if r["i"] % 10) / 135 > 0.85
    # without a vector, from words alone
    assert feedback.predict_ensemble(model, rows.select("i", "text"), "text").count() == 150


def test_nothing_to_learn(spark, rows):
    assert feedback.fit_ensemble(rows.limit(10)) is None
    assert feedback.fit_ensemble(rows.withColumn("label", F.lit("one"))) is None
    with pytest.raises(ValueError, match="more than 20"):
        feedback.fit_ensemble(rows.withColumn("label", F.col("i").cast("string")))
