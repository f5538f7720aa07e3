"""Readers, writers, streams and whole flows."""

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import dedup
from fieldloom.plans import flows
from fieldloom.sinks import writers
from fieldloom.sources import readers
from fieldloom.streaming import incremental

TEXT = """# Materials and Methods

Sampling was done at Narara in March 2014. Smith et al. helped.

# Results

Cassiopea andromeda was collected at Narara in March 2014. C. andromeda was observed near Okha. Medusa stages were seen.
Elysia obtusa reported by Rao (1999) from Pirotan.
"""


def test_postal_table(spark, tmp_path):
    (tmp_path / "p.txt").write_text("﻿PinCode\tOfficeName\tStateName\tDistrict\tLatitude\tLongitude\n415712\tAasud\tMaharashtra\tRatnagiri\t17.7\t73.1\n415713\tDapoli\tMaharashtra\tRatnagiri\t17.9\tx\n")
    t = readers.postal_table(spark, str(tmp_path / "p.txt"))
    assert {(r.place_name, r.latitude, r.longitude) for r in t.collect()} == {("Aasud", 17.7, 73.1), ("Dapoli", 17.9, None)}
    boxes = readers.code_boxes(t).collect()
    assert {b.code for b in boxes} == {"415712", "415713"} and boxes[0].lat_min == pytest.approx(17.6)
    with pytest.raises(ValueError):
        readers.delimited(spark, str(tmp_path / "p.txt"), {"a": ("nope",)}, ("a",))


def test_layers(spark):
    a = spark.createDataFrame([("narara", "Jamnagar", "Gujarat")], "vill_name string, dist_name string, state string")
    b = spark.createDataFrame([("okha", "Gujarat", "B1")], "Village string, ST_NM string, block string")
    villages, admin = readers.layers({"a": a, "b": b})
    assert {(r.village, r.district, r.layer_name) for r in villages.collect()} == {("Narara", "Jamnagar", "a"), ("Okha", None, "b")}
    assert admin.count() == 2


def test_binary_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"\xff")
    parse = readers.first_parser(("ascii", lambda d: d.decode("ascii")), ("none", lambda d: ""))
    got = readers.binary_documents(spark, str(tmp_path), parse, "*.txt").collect()
    assert sorted(r.text for r in got) == ["", "one"]


def test_pages_and_archive(spark):
    p = spark.createDataFrame([(1, "http://x/y/some-page.html", "<html><title> A real  title </title><p>Body <b>text</b></p></html>"), (2, "http://x/y/other-page.html", "<p>x</p>")], "page_id int, url string, html string")
    got = {r.page_id: (r.title, r.body) for r in readers.html_pages(p).collect()}
    assert got[1] == ("A real title", "A real title Body text") and got[2][0] == "other page"
    a = spark.createDataFrame([("1", "Aus bus", 1.0, 2.0, "India"), ("1", "Aus bus", 1.0, 2.0, "India"), ("2", "Aus bus", 0.0, 0.0, "India"), ("3", "", 1.0, 1.0, "India")], "gbif_id string, scientificName string, decimalLatitude double, decimalLongitude double, country string")
    assert readers.occurrence_archive(a, "india").count() == 1


def test_metadata(spark):
    d = spark.createDataFrame([(1, "10.1/a", "T one"), (2, "", "T two"), (3, None, "T three")], "doc_id int, doi string, title string")
    s1 = spark.createDataFrame([("10.1/A", "t one", ["A"], 2001, "J1")], "doi string, title_key string, authors array<string>, year int, journal string")
    s2 = spark.createDataFrame([("10.1/a", "", ["B"], 2002, "J2"), ("", "t two", ["C"], 2003, "J3")], s1.schema)
    got = {r.doc_id: (r.authors, r.year) for r in readers.paper_metadata(d, [("one", s1), ("two", s2)]).collect()}
    assert got == {1: (["A"], 2001), 2: (["C"], 2003), 3: (None, None)}


def test_snapshots(spark, tmp_path):
    s = writers.Snapshots(spark, f"{tmp_path}/t")
    assert s.current() is None
    assert s.write(spark.range(3)) == 1 and s.write(spark.range(5)) == 2
    assert s.read().count() == 5 and s.read(1).count() == 3


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("A b", "P"), ("", "Q")], ["Recorded Name", "verbatimLocality"])
    writers.append_records(rows, f"{tmp_path}/occ", "h", "s")
    assert spark.read.parquet(f"{tmp_path}/occ").count() == 1
    atoms = spark.createDataFrame([("1", "B", "Phy"), ("2", "A", "Phy")], "atom_id string, valid_name string, phylum string")
    out = writers.darwin_core(atoms)
    assert tuple(out.columns) == writers.DARWIN_CORE and [r.valid_name for r in out.collect()] == ["A", "B"]
    writers.csv_file(out, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(4).write.parquet(f"{tmp_path}/in")
    order = F.struct("ts", "event_id")
    state = writers.Snapshots(spark, f"{tmp_path}/state")
    stream = incremental.file_stream(spark, f"{tmp_path}/in", e.schema, 1)
    incremental.fold(stream, state, f"{tmp_path}/cp", incremental.running_best(["user_id"], order))
    want = dedup.best_per_key(e, [F.col("user_id")], order)
    assert sorted(map(tuple, state.read().select("user_id", "event_id").collect())) == sorted(map(tuple, want.select("user_id", "event_id").collect()))
    again = incremental.file_stream(spark, f"{tmp_path}/in", e.schema, 1)
    incremental.fold(again, state, f"{tmp_path}/cp", incremental.running_best(["user_id"], order))
    assert state.read().count() == want.count()


def test_stage_stream(spark, tmp_path):
    stages = ["view", "click", "purchase"]
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("event_type").alias("stage")).where(F.col("event_type").isin(stages))
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    state = writers.Snapshots(spark, f"{tmp_path}/state")
    incremental.fold(incremental.file_stream(spark, f"{tmp_path}/in", e.schema, 1), state, f"{tmp_path}/cp", incremental.running_stage("user_id", stages))
    rank = {s: i for i, s in enumerate(stages)}
    want = {}
    for r in e.collect():
        want[r.user_id] = max(want.get(r.user_id, r.stage), r.stage, key=rank.get)
    assert {r.user_id: r.stage for r in state.read().collect()} == want


def test_a_fresh_checkpoint_loses_no_batch(spark, tmp_path):
    e = spark.range(40).select((F.col("id") % 5).alias("k"), F.lit(1).alias("n"))
    state = writers.Snapshots(spark, f"{tmp_path}/state")
    for turn in (1, 2):
        e.repartition(3).write.mode("append").parquet(f"{tmp_path}/in{turn}")
        stream = incremental.file_stream(spark, f"{tmp_path}/in{turn}", "k long, n int", 1)
        incremental.fold(stream, state, f"{tmp_path}/cp{turn}", incremental.running_sum(["k"], ["n"]))
        assert state.read().agg(F.sum("n")).first()[0] == 40 * turn
    assert state.note().startswith(f"{tmp_path}/cp2#")


def test_workspace(spark, tmp_path):
    from fieldloom.session import Workspace

    work = Workspace(spark, "t")
    assert work.save(spark.range(3), "a").count() == 3
    assert work.uri("a").startswith("file:///")
    work.drop("a")
    work.clear()


def test_windowed_counts(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = incremental.windowed_counts(e, "ts", ["event_type"], "1 day", "1 hour")
    assert got.agg(F.sum("n")).first()[0] == e.count()


def test_flow(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id int, text string")
    found = flows.records_from_texts(docs)
    assert "Cassiopea andromeda" in {r.recordedName for r in found.collect()}
    located = found.withColumns({"decimalLatitude": F.lit(None).cast("double"), "decimalLongitude": F.lit(None).cast("double"), "phylum": F.lit("P"), "class_": F.lit("C"), "order_": F.lit("O"), "family_": F.lit("F")})
    out, summary = flows.curate(located, F.lit("Smith 2014 in the Gulf of Kutch, India"), ["seq"])
    assert out.count() == summary.first().records >= 2
    derived = flows.derive(out, "seq")
    assert derived["nodes"].count() > 3 and derived["species"].count() >= 2
    assert flows.answer_context(derived["nodes"], derived["edges"], "Where is Cassiopea?").count() == 1
    assert flows.contexts(docs).where("full_text LIKE '%STUDY CONTEXT%'").count() > 0


def test_tables_of_few_row_groups_are_dealt(spark, tmp_path, monkeypatch):
    from fieldloom import session

    monkeypatch.setattr(session, "LEAST_DEALT", 1)
    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one of.parquet"))
    spark.range(1000).repartition(cores).write.parquet(str(tmp_path / "many.parquet"))
    one, many = (session.read_table(spark, str(tmp_path), n) for n in ("one of", "many"))
    assert one.rdd.getNumPartitions() == (cores if cores >= session.IDLE_SHARE else 1)
    assert sorted(r.id for r in one.collect()) == sorted(r.id for r in many.collect()) == list(range(1000))
    assert "Repartition" not in many._jdf.queryExecution().logical().toString()
