"""Language models scored from their stored filter, and tasks that run twice."""

import json
import os
import subprocess
import sys
import textwrap
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import lm_score, vector_topk
from fieldloom.session import Workspace
from tests.llm.test_llm import brute_lm

ROOT = Path(__file__).resolve().parents[2]
SEEN = [(i, f"the cat number {i % 5} sat on mat {i % 7} and slept") for i in range(60)] + [(60, None), (61, "")]
ASKED = [(100, "the cat number 3 sat on mat 2 and slept"), (101, "words that were never seen at all"), (102, None), (103, "the cat sat and and slept " * 300)]


def test_scoring_in_a_new_process_from_the_stored_filter(spark, tmp_path):
    path = str(tmp_path / "model")
    docs = spark.createDataFrame(SEEN, "doc_id long, text string").repartition(3)
    model = lm_score.fit_lm(docs, path, block_bytes=300, range_entries=100, bits_per_entry=64.0)
    assert model.n_ranges > 3 and 0 < model.error_rate() < 0.001
    run = textwrap.dedent(f"""
        import json, sys
        sys.path.insert(0, {str(ROOT)!r})
        from pyspark.sql import SparkSession, functions as F
        from fieldloom.llm import lm_score
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        docs = spark.createDataFrame({ASKED!r}, "doc_id long, text string")
        got = lm_score.score_lm(docs, lm_score.LmModel.load(spark, {path!r}), F.lit(True), range_entries=40).collect()
        print("GOT", json.dumps([[r.doc_id, r.score, r.base_score, r.train_tokens, r.n_known] for r in got]))
    """)
    out = subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, timeout=200, cwd=tmp_path, env=os.environ, check=False)
    lines = [x for x in out.stdout.splitlines() if x.startswith("GOT ")]
    assert lines, out.stderr[-2000:]
    got = {i: (s, b) for i, s, b, _, _ in json.loads(lines[0][4:])}
    # every word, pair and triple of the asked texts goes through the filter, never-seen ones too
    want = brute_lm([*SEEN, *ASKED], lambda i: i >= 100)[len(SEEN) :]
    assert [got[i] for i, _ in ASKED] == [pytest.approx(w, rel=1e-6) for w in want]


def test_a_model_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = lm_score.fit_lm(none, str(tmp_path / "none"))
    assert (model.n_tokens, model.n_words, model.error_rate()) == (0, 0, 0.0)
    rows = lm_score.score_lm(spark.createDataFrame(ASKED, "doc_id long, text string"), model, F.lit(True)).collect()
    assert len(rows) == len(ASKED) and all(r.n_known == 0 and r.score == pytest.approx(r.base_score) for r in rows)




def test_block_files_of_a_lost_attempt_are_not_read(spark, monkeypatch):
    rows = [(i, [i % 13 - 6, i % 7, -(i % 5)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, values array<long>")
    want = vector_topk.exact_topk(df, df.where("vec_id % 20 = 0"), 5, block=32).orderBy("query_id", "rank").collect()
    packs = []
    save = Workspace.save

    def twice(self, table, name, path=None):
        if name == "manifest":
            # a first attempt over the rows in another order writes its files and is lost before it commits
            lost = table.limit(3).collect()
            packs.append(lost)
        return save(self, table, name, path)

    monkeypatch.setattr(Workspace, "save", twice)
    again = vector_topk.exact_topk(df.orderBy(F.desc("vec_id")), df.where("vec_id % 20 = 0"), 5, block=32).orderBy("query_id", "rank").collect()
    assert packs and packs[0] and again == want


def test_sums_of_keys():
    rng = np.random.default_rng(2)
    for shift, most in ((17, 100), (17, 1 << 40), (0, 100)):
        keys = rng.integers(0, 50, 400).astype(np.uint64) << np.uint64(shift)
        counts = rng.integers(1, most, 400)
        want = {}
        for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
            want[k] = want.get(k, 0) + c
        found, n = lm_score.summed(keys, counts)
        assert dict(zip(found.tolist(), n.tolist(), strict=True)) == want and found.tolist() == sorted(want)


def test_counts_are_those_of_the_places():
    block = lm_score.Block.of(["a b a b c", "", "a b", "x"], [True] * 4)
    keys, pair, triple = block.grams()
    found, n = block.gram_counts()
    assert (found == keys).all()
    assert (n == np.bincount(pair, minlength=len(keys)) + np.bincount(triple[triple >= 0], minlength=len(keys))).all()
