"""Streams with keyed state against the same rows in one piece."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fieldloom.session import Workspace
from fieldloom.streaming import stateful


def run(spark, tmp_path, parts, schema, make):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        stateful.drain(make(stream), f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    return spark.read.parquet(f"{tmp_path}/out")


def test_stages_survive_restarts(spark, tmp_path):
    rng = random.Random(1)
    Workspace(spark, "t")
    at = datetime(2024, 1, 1)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["seen", "kept", "saved", "odd", None]), rng.choice(["x", "y", None]), at + timedelta(minutes=rng.randint(0, 500))) for _ in range(120)]
    parts = [rows[:50], rows[50:51], rows[51:]]
    run(spark, tmp_path, parts, "key string, stage string, place string, at timestamp", lambda s: stateful.track_stages(s, ["seen", "kept", "saved"]))
    got = {r["key"]: tuple(r)[1:] for r in stateful.state_table(spark, f"{tmp_path}/checkpoint", "stage").select("key", "stage", "n", "first", "last").collect()}
    for key in ("a", "b", None):
        own = [r for r in rows if r[0] == key]
        told = [s for s in ("seen", "kept", "saved") if any(r[1] == s for r in own)]
        assert got[key][:2] == (told[-1] if told else None, len(own))
        assert got[key][2:] == (min(r[3] for r in own), max(r[3] for r in own))
    assert spark.conf.get(stateful.PROVIDER_KEY) != stateful.PROVIDER


def whole(rows, most_texts, most_chars, idle):
    """Flushes of all rows in order, and what is held."""
    out = []
    for key in {r[0] for r in rows}:
        held, flush, last = [], 0, None
        for _, at, _, text in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if held and at - last > idle:
                out.append((key, flush, [t for t in held]))
                held, flush = [], flush + 1
            held.append(text or "")
            last = at
            if len(held) >= most_texts or sum(map(len, held)) >= most_chars:
                out.append((key, flush, held))
                held, flush = [], flush + 1
        if held:
            out.append((key, flush, held))
    return sorted(out)


def test_buffers_flush_when_full_or_silent(spark, tmp_path):
    rng = random.Random(2)
    Workspace(spark, "t")
    start = datetime(2024, 1, 1)
    rows = sorted(((rng.choice("ab"), start + timedelta(minutes=rng.randint(0, 3000)), i, rng.choice([None, "", "some text", "x" * 40])) for i in range(150)), key=lambda r: (r[1], r[2]))
    # a key that falls silent early: only a timer can give it out
    rows = [("c", start, -1, "alone"), *rows]
    schema = "key string, at timestamp, seq int, text string"
    found = run(spark, tmp_path, [rows[:60], rows[60:110], rows[110:]], schema, lambda s: stateful.flush_buffers(s, 5, 100, "40 minutes"))
    out = [(r["key"], r["flush"], list(r["texts"])) for r in found.collect()]
    held = stateful.pending_buffers(spark, f"{tmp_path}/checkpoint").collect()
    want = whole(rows, 5, 100, timedelta(minutes=40))
    assert len(out) + len(held) == len(want)
    pending = {(r["key"], r["flush"]): r["n"] for r in held}
    assert sorted(out) == [w for w in want if (w[0], w[1]) not in pending]
    assert all(len(w[2]) == pending[w[0], w[1]] for w in want if (w[0], w[1]) in pending)
    assert ("c", 0, ["alone"]) in out and found.where((F.col("key") == "c") & (F.col("why") == "idle")).count() == 1


def test_slices_hold_every_row_once(spark):
    rows = [(i, None if i % 7 == 0 else datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(100)]
    df = spark.createDataFrame(rows, "i int, at timestamp")
    parts = stateful.in_slices(df, "at", 4)
    assert sorted(r["i"] for p in parts for r in p.collect()) == list(range(100))


def test_furthest_stages_survive_restarts(spark, tmp_path):
    rng = random.Random(3)
    Workspace(spark, "t")
    at = datetime(2024, 1, 1)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["seen", "kept", "saved", "odd", None]), rng.choice([None, at + timedelta(minutes=rng.randint(0, 500))])) for _ in range(90)] + [("c", "odd", None)]
    stages = ["seen", "kept", "saved"]
    run(spark, tmp_path, [rows[:40], rows[40:41], rows[41:]], "key string, stage string, at timestamp", lambda s: stateful.furthest_stages(s, stages))
    got = {r["key"]: tuple(r)[1:] for r in stateful.furthest_table(spark, f"{tmp_path}/checkpoint", stages).collect()}
    assert set(got) == {r[0] for r in rows}
    for key in got:
        own = [r for r in rows if r[0] == key]
        told, times = [s for s in stages if any(r[1] == s for r in own)], [r[2] for r in own if r[2]]
        assert got[key] == (told[-1] if told else None, len(own), min(times, default=None), max(times, default=None))


def test_stage_query_enters_no_python(spark, monkeypatch):
    from fieldloom.plans import structures

    monkeypatch.setattr(stateful, "StageMachine", None)
    assert structures.stage_machine(spark, "/root/testdata/sf0.001").count() > 0
