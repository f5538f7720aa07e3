"""Layers of files that the test writes."""

import json
import math
import sqlite3
import struct

import pytest

from fieldloom.sources import layer_files as lf
from fieldloom.sources.readers import layers


def polygon(rings, order="<", srs=4326, envelope=0, z=False):
    head = b"GP\x00" + bytes([1 | envelope << 1]) + struct.pack("<i", srs) + b"\x00" * lf.ENVELOPES[envelope]
    body = struct.pack(order + "B", order == "<") + struct.pack(order + "II", 1003 if z else 3, len(rings))
    for ring in rings:
        body += struct.pack(order + "I", len(ring)) + b"".join(struct.pack(order + ("3d" if z else "2d"), *p, *([7.0] * z)) for p in ring)
    return head + body


SQUARE = [[70.0, 20.0], [71.0, 20.0], [71.0, 21.0], [70.0, 20.0]]


@pytest.fixture(scope="module")
def package(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("gpkg") / "some layers.gpkg")
    con = sqlite3.connect(path)
    con.executescript(
        """CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT);
           CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INTEGER);
           CREATE TABLE gpkg_spatial_ref_sys (srs_id INTEGER, organization TEXT, organization_coordsys_id INTEGER);
           INSERT INTO gpkg_spatial_ref_sys VALUES (4326, 'EPSG', 4326), (1, 'EPSG', 3857), (2, 'EPSG', 32643);
           INSERT INTO gpkg_contents VALUES ('gujarat', 'features'), ('goa x', 'features'), ('utm', 'features'), ('notes', 'attributes'), ('tiles', 'tiles');
           INSERT INTO gpkg_geometry_columns VALUES ('gujarat', 'geom', 4326), ('goa x', 'shape', 1), ('utm', 'geom', 2);
           CREATE TABLE gujarat (fid INTEGER PRIMARY KEY, geom BLOB, VILLAGE TEXT, district TEXT, state_name TEXT, people INTEGER);
           CREATE TABLE "goa x" (fid INTEGER PRIMARY KEY, shape BLOB, vill_name TEXT, district TEXT, people REAL);
           CREATE TABLE utm (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT);
           CREATE TABLE notes (fid INTEGER PRIMARY KEY, name TEXT, district TEXT);"""
    )
    con.executemany("INSERT INTO gujarat VALUES (?, ?, ?, ?, ?, ?)", [(i, polygon([SQUARE], "<>"[i % 2], envelope=i % 5, z=i % 3 == 0) if i % 4 else None, f"v{i}", "Kutch" if i % 2 else None, "Gujarat", i) for i in range(1, 101)])
    x = math.radians(74) * lf.EARTH
    y = math.log(math.tan(math.pi / 4 + math.radians(15) / 2)) * lf.EARTH
    con.execute('INSERT INTO "goa x" VALUES (5, ?, ?, ?, 1.5)', (polygon([[[x, y]]], srs=1), "Panjim", "North"))
    con.execute("INSERT INTO utm VALUES (1, ?, 'far')", (polygon([SQUARE]),))
    con.commit()
    con.close()
    return path


def test_layers_in_row_ranges(spark, package):
    df = lf.layer_table(spark, package, ["gujarat", "goa x", "notes"], rows=30)
    assert df.rdd.getNumPartitions() == 5
    assert [f.name for f in df.schema][:2] == ["layer", "row"] and df.schema["people"].dataType.simpleString() == "string"
    rows = {(r["layer"], r["row"]): r for r in df.collect()}
    assert len(rows) == 101 and rows["gujarat", 7]["VILLAGE"] == "v7" and rows["gujarat", 7]["geometry"] == [SQUARE]
    assert rows["gujarat", 3]["geometry"] == [SQUARE] and rows["gujarat", 8]["geometry"] is None
    (point,) = rows["goa x", 5]["geometry"][0]
    assert point == pytest.approx([74.0, 15.0], abs=1e-9) and rows["goa x", 5]["VILLAGE"] is None


def test_columns_and_filters_reach_the_file(spark, package):
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df = lf.layer_table(spark, package, ["gujarat"], "VILLAGE string, district string, people long")
        hit = df.where("district = 'Kutch' AND people > 90 AND VILLAGE LIKE '%1'")
        # only what the file cannot tell is left for Spark to filter
        plan = hit._jdf.queryExecution().optimizedPlan().toString()
        assert "EndsWith" in plan and "Kutch" not in plan and "90" not in plan
        assert [tuple(r) for r in hit.collect()] == [("v91", "Kutch", 91)]
        assert df.where("district IS NULL").count() == 50 and df.where("people IN (1, 2, 999)").count() == 2
        whole = lf.layer_table(spark, package, ["gujarat", "notes"], rows=10)
        assert whole.where("layer = 'notes'").count() == 0 and whole.where("layer = 'gujarat' AND people <= 10").count() == 10
        geo = lf._FilteringReader(package, df.schema, ["gujarat"], 10)
        rest = list(geo.pushFilters([lf.EqualTo(("district",), "Kutch"), lf.EqualTo(("people",), "x"), lf.EqualTo(("other",), 1)]))
        assert len(rest) == 2 and len(geo.clauses) == 1
    finally:
        spark.conf.set(key, before)


def test_systems_of_reference(spark, package):
    with pytest.raises(Exception, match="32643"):
        lf.layer_table(spark, package).collect()
    # without the geometry there is nothing to refuse
    assert [tuple(r) for r in lf.layer_table(spark, package, ["utm"], "name string").collect()] == [("far",)]
    assert lf.rings_of(None) is None and lf.rings_of(b"xx") is None


def test_villages_of_a_file(spark, package):
    named = {n: lf.layer_table(spark, package, [n]) for n in ("gujarat", "goa x")}
    villages, admin = layers(named)
    assert villages.count() == 101 and {tuple(r)[:2] for r in admin.collect()} == {("Gujarat", "Kutch"), ("Gujarat", None)}


def test_pages(spark, tmp_path):
    for i, page in enumerate([{"offset": 0, "results": [{"key": 1, "name": "a"}, {"key": 2}]}, {"offset": 2, "results": []}, {"offset": 4, "results": [{"key": 3, "name": "é", "odd": 1}]}]):
        (tmp_path / f"page-{i}.json").write_text(json.dumps(page, indent=1))
    (tmp_path / "page-9.json").write_text("{broken")
    got = sorted(map(tuple, lf.occurrence_pages(spark, str(tmp_path), "key: long, name: string").collect()))
    assert got == [(0, 1, "a"), (0, 2, None), (4, 3, "é")]
