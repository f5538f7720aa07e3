"""Column functions on small fixtures."""

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import citations, coords, jsonfix, keys, names, places, text


def run(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_name_keys(spark):
    assert run(spark, names.name_key, "Elysia obtusa Baba, 1938", "Elysia  obtusa", "Berthellina cf. citrina", "Aus (Bus) cus", None) == ["elysia obtusa", "elysia obtusa", "berthellina citrina", "aus cus", ""]
    assert run(spark, lambda c: names.name_key(c, True), " Berthellina cf. citrina ") == ["berthellina cf. citrina"]
    once = run(spark, names.name_key, "Elysia obtusa Baba, 1938")
    assert run(spark, names.name_key, *once) == once


def test_not_a_taxon(spark):
    assert run(spark, names.not_a_taxon, "Medusa", "post-larva", "Scyphistoma polyp", "C. andromeda", "Cassiopea andromeda") == ["life_stage", "life_stage", "life_stage", "abbreviation", None]


def test_name_helpers(spark):
    assert run(spark, names.cardinality, "", "Aus", "Aus bus", "Aus bus cus") == [0, 1, 2, 2]
    assert run(spark, names.binomial_case, "CASSIOPEA  Andromeda", None) == ["Cassiopea andromeda", ""]
    assert run(spark, names.title_type, "primary", "SECONDARY", "maybe", None) == ["Primary", "Secondary", "Uncertain", "Uncertain"]
    scores = run(spark, names.latin_score, "Acanthurus", "zzqx", "a")
    assert scores[0] == 1.0 and scores[1] == 0.0 and scores[2] == 0.0
    df = spark.createDataFrame([("Animalia|Cnidaria|Scyphozoa", "kingdom|phylum|class")], "p string, r string")
    assert df.select(names.rank_of(F.col("p"), F.col("r"), "phylum")).first()[0] == "Cnidaria"
    assert df.select(names.rank_of(F.col("p"), F.col("r"), "genus")).first()[0] is None


def test_name_confidence(spark):
    df = spark.createDataFrame([(1.0, "accepted", "EXACT", "ACCEPTED", True, True, True), (0.5, "synonym", "FUZZY", "SYNONYM", False, False, False), (0.0, "none", "NONE", "", False, True, False)], "s double, t string, m string, b string, w boolean, c boolean, i boolean")
    got = [r[0] for r in df.select(names.name_confidence(*[F.col(c) for c in "stmbwci"])).collect()]
    assert got == [1.0, 0.23, 0.1]


def test_places_meet(spark):
    for a, b in (("Aasood", "Asud"), ("Aasud", "Asood"), ("Agar Vaigani", "Agar Baigani"), ("Shrivardhan", "Srivardhan"), ("Wada", "Vada")):
        x, y = run(spark, places.canonical_place, a, b)
        assert x == y
    assert run(spark, places.normal_place, "Aasood (Dapoli Tahsil)", "Sāgar") == ["aasood", "sagar"]


def test_locality_key(spark):
    assert run(spark, places.locality_key, "Narara,  Gulf of Kutch.", None) == ["narara gulf of kutch", ""]


@pytest.mark.parametrize(
    ("raw", "kind", "place"),
    [
        ("Umbrella circular, flattened, 10 cm to 15 cm in diameter", "morphology", None),
        ("intertidal area of dead coral reef", "habitat", None),
        ("intertidal area of dead coral reef at Narara", "habitat_with_place", "Narara"),
        ("Arambhada, Gulf of Kutch", None, None),
        ("Campbell Bay", None, None),
        ("Not Reported", None, None),
    ],
)
def test_locality_guard(spark, raw, kind, place):
    assert run(spark, places.place_class, raw) == [kind]
    if place:
        assert run(spark, places.rescued_place, raw) == [place]


def test_splits(spark):
    assert run(spark, places.split_sites, "Narara, Pirotan, Beyt Dwarka", "Narara Island, Gulf of Kutch", "Site A (Narara)") == [["Narara", "Pirotan", "Beyt Dwarka"], ["Narara Island, Gulf of Kutch"], ["Site A (Narara)"]]
    assert run(spark, places.split_compound, "Mandapam, Tuticorin, Rameswaram and Pamban", "Gulf of Mannar and Palk Bay", "Kovalam (near Chennai)", "Station 4") == [["Mandapam", "Tuticorin", "Rameswaram", "Pamban"], ["Gulf of Mannar", "Palk Bay"], ["Kovalam", "Chennai"], ["Station 4"]]


def test_degrees(spark):
    got = run(spark, coords.parse_degrees, "N 17°47'13.3\"", "N 17047'13.3\"", "S 9.5", "E 73°09'13.8\"", "22.59", "N 95.1", "", None, "no")
    assert got[0] == pytest.approx(17.7870278, abs=1e-6) and got[1] == got[0]
    assert got[2] == -9.5 and got[3] == pytest.approx(73.1538333, abs=1e-6) and got[4] == 22.59
    assert got[5:] == [None, None, None, None]


def test_checked_coordinates(spark):
    df = spark.createDataFrame([(22.5, 70.0, "coral reef", "Narara, Gujarat"), (50.0, 5.0, "forest", "x"), (0.0, 60.0, "coral", "x"), (95.0, 5.0, "", ""), (22.5, 70.0, "", "Kerala"), (None, 5.0, "", "")], "a double, o double, c string, l string")
    got = [r[0] for r in df.select(coords.checked(*[F.col(x) for x in "aocl"])).collect()]
    assert [g.note for g in got] == [None, "OUTSIDE_COUNTRY_BOX", "MARINE_OFFSHORE_ALLOWED", "INVALID_RANGE lat", "OUTSIDE_STATE_BOX kerala", None]
    assert got[0].lat == 22.5 and got[1].lat is None and got[2].lat == 0.0 and got[4].lat is None


def test_citations(spark):
    assert run(spark, citations.first_author, "Smith et al., 2016", "Bhave & Apte 2011", "", None) == ["Smith", "Bhave", "", ""]
    assert run(spark, citations.cited_year, "Smith (2016)", "x 1911") == ["2016", ""]
    assert run(spark, lambda c: citations.latest_year(c, True), "Cassiopea (Forsskål, 1775) in 2016", "none") == [2016, None]
    assert run(spark, citations.publication_year, "Prasade; Nagale; Apte 2016. Cassiopea andromeda (Forsskål, 1775)", "A study (2013)", "of 1999") == [2016, 2013, 1999]
    assert run(spark, citations.sampling_year, '{"date": "March 2014"}', "2011-05", None) == [2014, 2011, None]
    assert run(spark, citations.study_area, "Jellyfish in the Gulf of Kutch, India") == ["Gulf of Kutch, India"]


def test_references(spark):
    df = spark.createDataFrame([("k", ["A", "B"], "2016", "T", "journal", "J", "4", "2", "1-9", "10.1/x", None), ("m", ["A", "B", "C", "D"], None, None, "book", None, None, None, None, None, "P")], "k string, a array<string>, y string, t string, s string, j string, v string, i string, p string, d string, b string")
    got = [r[0] for r in df.select(citations.reference_line(*[F.col(c) for c in "aytsjvipdb"])).collect()]
    assert got == ['A & B (2016). "T." *J*, 4(2): 1-9. https://doi.org/10.1/x.', "A et al. (n.d.). *Untitled*. P."]
    entry = df.select(citations.bibtex_entry(*[F.col(c) for c in "kaytsjvipdb"])).first()[0]
    assert entry.startswith("@article{k,") and "author = {A and B}" in entry


def test_keys(spark):
    import hashlib

    df = spark.createDataFrame([("Aus bus", "Narara", "Doc")], "s string, l string, c string")
    assert df.select(keys.atom_id("s", "l", "c")).first()[0] == hashlib.sha1(b"aus bus|narara|doc").hexdigest()[:16]
    assert df.select(keys.node_id("Species", "s")).first()[0] == "species::aus_bus"


def test_text(spark):
    assert run(spark, text.sentences, "One sentence here. Another one there! x.") == [["One sentence here.", "Another one there!"]]
    assert run(spark, text.guarded_sentences, "Seen by Dr. Smith here. Elysia cf. Obtusa too. End") == [["Seen by Dr. Smith here.", "Elysia cf. Obtusa too.", "End"]]
    assert run(spark, text.section_role, "2. Materials and Methods", "Acknowledgements") == ["METHODS", "OTHER"]
    assert run(spark, text.names_species, "Cassiopea andromeda was found.", "January rains fell.", "Elysia sp. here") == [True, False, True]
    assert run(spark, text.occurrence_type, "we collected and observed", "reported by Rao, sensu lato", "nothing") == ["Primary", "Secondary", "Uncertain"]
    assert run(spark, text.source_type, "type specimen in a museum", "reported by Rao", "present study") == ["type_material", "secondary_literature", "primary_collection"]
    assert run(spark, text.expected_count, "we found 34 species and 9000 taxa, 12 species", "none") == [34, None]
    assert run(spark, lambda c: text.windows(c, 4, 1), "abcdefgh", "") == [["abcd", "defg", "gh"], []]
    assert run(spark, text.habitat_class, "Rocky shore", "") == ["rocky intertidal", "not reported"]
    facts = run(spark, text.specimen_facts, "Aus bus sp. nov. Holotype ZSI/MBRC/123, 12.5–18 mm, radula 60 × 31.1.31. Collected by J. Orton, 1969. Type locality: the reef flat at Narara island.")[0]
    assert (facts.status, facts.type_status, facts.size_min_mm, facts.size_max_mm, facts.radula) == ("sp. nov.", "holotype", 12.5, 18.0, "60 x 31.1.31")
    assert facts.vouchers == ["ZSI/MBRC/123"] and facts.collector == "J. Orton" and facts.type_locality.startswith("the reef flat")


def test_cite_numbers(spark):
    df = spark.createDataFrame([("a [cite:x] b [cite:y] c [cite:z]", {"x": 1, "y": 2})], "t string, i map<string,int>")
    assert df.select(text.cite_numbers("t", F.col("i"))).first()[0] == "a [1] b [2] c [cite:z]"


def test_json_repair():
    cases = {
        '```json\n[{"a": 1}]\n```': 1,
        '<think>[{"no": 1}]</think>[{"a": 1}, {"b": 2}]': 2,
        'Here you go: [{"a": 1}] done': 1,
        '{"records": [{"a": 1}, {"a": 2}]}': 2,
        '{"a": 1}': 1,
        '[{"a": 1}, {"b": "cut': 2,
        '[{"a": 1}, {"b": 2': 2,
        "[]": 0,
        "garbage": 0,
        None: 0,
    }
    for raw, n in cases.items():
        assert len(jsonfix.repair_records(raw)) == n, raw
