"""Operators on small fixtures: golden rows, invariants and brute force."""

import itertools

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import annotate, articles, dedup, feedback, filters, graph, lookup, nearest, reconcile, retrieval, segment, similarity, spatial, summaries, tables, upserts
from fieldloom.schemas import canonical, resolve

REC = "seq int, validName string, recordedName string, verbatimLocality string, occurrenceType string, rawTextEvidence string, sourceCitation string, habitat string, decimalLatitude double, decimalLongitude double"


def recs(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], REC)


def rec(name, place="Narara", kind="Primary", evidence="", cite="", habitat=None, lat=None, lon=None):
    return name, None, place, kind, evidence, cite, habitat, lat, lon


def test_dedup(spark):
    df = recs(spark, rec("Aus bus", kind="Primary", evidence="short"), rec("Aus bus Baba, 1938", kind="Secondary", evidence="a much longer text"), rec("Aus bus", kind="Primary", evidence="longer one"), rec("__candidate_1_2"), rec(""), rec("Aus bus", "Pirotan", "Secondary"))
    got = sorted((r.validName, r.verbatimLocality, r.rawTextEvidence) for r in dedup.dedup_records(df, ["seq"]).collect())
    assert got == [("Aus bus", "Narara", "longer one"), ("Aus bus", "Pirotan", "")]
    again = dedup.dedup_records(dedup.dedup_records(df, ["seq"]), ["seq"])
    assert again.count() == 2


def test_suppress_regional(spark):
    df = recs(spark, rec("Aus bus", "Gujarat"), rec("Aus bus", "Narara"), rec("Cus dus", "Gujarat"), rec("Aus bus", None), rec("Aus cf. bus", "Gujarat"))
    assert sorted((r.validName, r.verbatimLocality) for r in dedup.suppress_regional(df).collect()) == [("Aus bus", "Narara"), ("Cus dus", "Gujarat")]
    assert dedup.suppress_regional(df, strict=True).count() == 3


def test_conflicts_and_votes(spark):
    df = recs(spark, rec("Aus bus"), rec("aus bus", kind="Secondary"), rec("Cus dus"))
    assert [(r.species, r.n_records, r.types) for r in dedup.conflicts(df).collect()] == [("aus bus", 2, ["primary", "secondary"])]
    votes = dedup.merge_votes(df.withColumn("how", F.concat(F.lit("s"), "seq")), "how", ["habitat", "rawTextEvidence"], ["seq"])
    assert sorted((r.vote_key, r.votes, r.strategies, r.occurrenceType) for r in votes.collect()) == [("aus bus::narara", 2, ["s0", "s1"], "Primary"), ("cus dus::narara", 1, ["s2"], "Primary")]
    assert {r.weight for r in dedup.weigh_votes(votes, {"s0": 2.5}).collect()} == {3.5, 1.0}


def test_life_stage_guard(spark):
    docs = spark.createDataFrame([(1, "Cassiopea andromeda lives here. Cyanea capillata too.")], "doc_id int, text string")
    df = recs(spark, rec("C. andromeda"), rec("Medusa"), rec("X. unknown"), rec("Cassiopea andromeda (Forsskål, 1775)")).withColumns({"doc_id": F.lit(1), "recordedName": F.col("validName")})
    kept, gone = filters.guard_life_stages(df, filters.genus_context(docs))
    assert sorted(r.recordedName for r in kept.collect()) == ["Cassiopea andromeda", "Cassiopea andromeda"]
    assert sorted(r.reason for r in gone.collect()) == ["abbreviation", "life_stage"]
    assert kept.count() + gone.count() == df.count()


def test_locality_guard(spark):
    df = recs(spark, rec("A b", "Umbrella circular, 10 cm wide"), rec("A b", "intertidal area of dead coral reef"), rec("A b", "intertidal area of dead coral reef at Narara"), rec("A b", "Narara, Gulf of Kutch"))
    got = [(r.verbatimLocality, r.habitat is not None) for r in filters.guard_localities(df).orderBy("seq").collect()]
    assert got == [("Not Reported", False), ("Not Reported", True), ("Narara", True), ("Narara, Gulf of Kutch", False)]


def test_reconcile(spark):
    df = recs(spark, rec("A b", cite="Rao, 1990"), rec("A b", evidence="according to Gravely it is rare", cite="Smith 2016"), rec("A b", evidence="seen in 1999", cite="Smith 2016"), rec("A b", evidence="seen in 2015", cite="Smith 2016"), rec("A b", kind="Secondary"))
    out = reconcile.reconcile_types(df, F.lit("Smith et al., 2016"))
    assert [r.rule for r in out.orderBy("seq").collect()] == ["citation_mismatch", "historical", "older_year", None, None]
    assert reconcile.change_log(out).count() == 3
    near = reconcile.enhance_localities(df, F.lit("Jellyfish in the Gulf of Kutch, India"))
    assert near.first().enhanced_locality == "Narara, Gulf of Kutch, India"


def test_checks(spark):
    df = recs(spark, rec("A b", "Kerala", lat=22.5, lon=70.0), rec("A b", "Narara", lat=0.0, lon=70.0), rec("A b", "Narara", lat=None, lon=1.0), rec("A b", "unknown"))
    assert [r.coordinate_note for r in filters.check_coordinates(df).orderBy("seq").collect()][0] == "OUTSIDE_STATE_BOX kerala"
    assert [r.seq for r in filters.missing_coordinates(df).collect()] == [2]
    boxes = spark.createDataFrame([("415712", 17.0, 18.0, 73.0, 74.0)], "code string, lat_min double, lat_max double, lon_min double, lon_max double")
    coded = recs(spark, rec("A b", "Dapoli 415712"), rec("A b", "Dapoli 415712", lat=50.0, lon=5.0), rec("A b", "x", lat=1.0, lon=2.0))
    assert [(r.decimalLatitude, r.coordinate_note) for r in filters.check_by_code(coded, boxes).orderBy("seq").collect()] == [(17.5, "FROM_CODE"), (None, "OUTSIDE_CODE_BOX"), (1.0, None)]


def test_similarity_scores():
    assert similarity.indel_ratio("abc", "abc") == 100 and similarity.indel_ratio("", "a") == 0
    assert similarity.indel_ratio("kitten", "sitting") == pytest.approx(100 * 2 * 4 / 13)
    assert similarity.token_sort("b a", "a b") == 100
    assert similarity.token_set("gulf of kutch", "kutch gulf of india") == 100
    assert similarity.token_set("aa bb", "cc dd") < 50


def test_similar_pairs_equal_brute_force(spark):
    left = ["narara island", "pirotan", "beyt dwarka", "okha port", "xyz"]
    right = ["narara islands", "pirotann", "bet dwarka", "okha", "pamban"]
    df = spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string")
    got = {(r.left_key, r.right_key) for r in similarity.similar_pairs(*df, "a", "b", 80.0).collect()}
    assert got == {(x, y) for x in left for y in right if similarity.indel_ratio(x, y) >= 80}
    best = {r.left_key: r.right_key for r in similarity.best_similar(*df, "a", "b", 80.0).collect()}
    assert best["pirotan"] == "pirotann"


@pytest.mark.parametrize(("scorer", "threshold"), [("edit", 80.0), ("indel", 80.0), ("indel", 50.0), ("sequence", 80.0), ("token_sort", 88.0), ("token_set", 82.0)])
def test_similar_pairs_lose_nothing_in_a_large_dimension(spark, scorer, threshold):
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(5)
    names = {"".join(rnd.choices(["sha", "li", "ta", "sa", "na", "mo"], k=rnd.randint(2, 4))) + rnd.choice(["wadi", "pur", " wadi", " pur"]) for _ in range(4000)}
    right = sorted(names)
    left = []
    for name in rnd.sample(right, 30):
        at = rnd.randrange(len(name))
        left.append(name[:at] + rnd.choice("abcdxyz ") + name[at + 1 :])
    left += [" ".join(reversed(left[0].split(" "))), "ab", "sha", "Wadi", "pur shali"]
    right += ["ac", "x", "shaa", "wadi"]
    score = (lambda a, b: 100.0 * (1 - edits(a, b) / max(len(a), len(b)))) if scorer == "edit" else similarity.SCORERS[scorer]
    want = {(a, b) for a in set(left) for b in right if score(a, b) >= threshold}
    assert len(right) > 500
    df = spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string")
    got = [(r.left_key, r.right_key) for r in similarity.similar_pairs(*df, "a", "b", threshold, scorer).select("left_key", "right_key").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_greedy_clusters(spark):
    df = spark.createDataFrame([("d", "cassiopea andromeda::narara"), ("d", "cassiopea andromedae::narara"), ("d", "elysia obtusa::okha"), ("e", "x")], "doc string, k string")
    got = {(r.k, r.leader) for r in similarity.greedy_clusters(df, ["doc"], "k").collect()}
    assert ("cassiopea andromedae::narara", "cassiopea andromeda::narara") in got and ("elysia obtusa::okha", "elysia obtusa::okha") in got


def test_place_stages(spark):
    t = spark.createDataFrame([("Aasud", "415712", "Maharashtra", "Ratnagiri", 17.7, 73.1), ("Shrivardhan", "402110", "Maharashtra", "Raigad", 18.0, 73.0)], "place_name string, postal_code string, state_name string, county_name string, latitude double, longitude double")
    index = lookup.place_index(t, ["postal_code"])
    q = spark.createDataFrame([("aasud",), ("Asood",), ("Srivardhan",), ("Shrivardhanpur",), ("near 415712",), ("Nowhere",), (None,)], "q string")
    got = {r.query: (r.place_name, r.match_type) for r in lookup.match_places(q, "q", index).collect()}
    assert got["aasud"] == ("Aasud", "exact") and got["Asood"] == ("Aasud", "canonical") and got["Srivardhan"] == ("Shrivardhan", "canonical")
    assert got["Shrivardhanpur"] == ("Shrivardhan", "fuzzy") and got["near 415712"] == ("Aasud", "code") and got["Nowhere"] == (None, None)
    located = lookup.locate_records(recs(spark, rec("A b", "Asood"), rec("A b", "Asood", lat=1.0, lon=1.0)).withColumn("geocodingSource", F.lit("")), lookup.match_places(q, "q", index))
    assert [(r.decimalLatitude, r.geocodingSource) for r in located.orderBy("seq").collect()] == [(17.7, "IN_Pincode_canonical_95"), (1.0, "")]


def test_villages(spark):
    v = spark.createDataFrame([("Narara", "Jamnagar", "Gujarat"), ("Narara", "Dhubri", "Assam"), ("Okha", "Dwarka", "Gujarat")], "village string, district string, state string")
    q = spark.createDataFrame([("Narara", "reef in Assam"), ("narara", "Gujarat coast"), ("Nararaa", ""), ("near Okha jetty road", "")], "q string, c string")
    got = {(r.query, r.context): (r.district, r.score) for r in lookup.resolve_villages(q, "q", "c", v).collect()}
    assert got["Narara", "reef in Assam"] == ("Dhubri", 100.0) and got["narara", "Gujarat coast"] == ("Jamnagar", 100.0)
    assert got["Nararaa", ""][1] > 82 and got["near Okha jetty road", ""][0] == "Dwarka"


def test_cascade_and_resolve(spark):
    k = spark.createDataFrame([("a",), ("b",), ("c",)], "name_key string")
    one = spark.createDataFrame([("a", "x", None)], "name_key string, phylum string, family string")
    two = spark.createDataFrame([("a", "y", "f"), ("b", "z", "g")], "name_key string, phylum string, family string")
    got = {r.name_key: (r.phylum, r.family, r.sources) for r in lookup.resolve_names(k, {"one": one, "two": two}, ["phylum", "family"]).collect()}
    assert got == {"a": ("x", "f", ["one", "two"]), "b": ("z", "g", ["two"]), "c": (None, None, [])}
    stages = {r.name_key: r.stage for r in lookup.cascade(k, "name_key", [("one", one), ("two", two)], ["phylum"]).collect()}
    assert stages == {"a": "one", "b": "two", "c": None}


def test_split_records(spark):
    known = spark.createDataFrame([("Mandapam",), ("Pamban",), ("Narara",)], "p string")
    df = recs(spark, rec("A b", "Mandapam and Pamban"), rec("A b", "Narara and Nowhere"))
    assert sorted(r.verbatimLocality for r in lookup.split_records(df, known).collect()) == ["Mandapam", "Narara and Nowhere", "Pamban"]


def test_stations(spark):
    docs = spark.createDataFrame([(1, "Sampling at Station 1 (Narara Island, 22.59°N, 70.06°E) and Station 2 (Okha).")], "doc_id int, text string")
    m = lookup.station_map(docs)
    got = {r.station: (r.site, r.latitude) for r in m.collect()}
    assert got["1"][1] == 22.59 and got["1"][0].startswith("Narara Island") and got["2"][0] == "Okha"
    df = recs(spark, rec("A b", "St. 2")).withColumn("doc_id", F.lit(1))
    assert lookup.resolve_stations(df, m).first().verbatimLocality == "Okha"


def test_nearest_mention(spark):
    r = spark.createDataFrame([("d", p) for p in (0, 100, 700, 5000)], "doc string, at int")
    m = spark.createDataFrame([("d", 90, "x"), ("d", 640, "y"), ("e", 0, "z")], "doc string, at int, place string")
    got = {x.at: x.place for x in nearest.nearest_mention(r, m, "doc", "at", 500, ["place"]).collect()}
    want = {p: min(((abs(p - q), v) for q, v in ((90, "x"), (640, "y")) if abs(p - q) <= 500), default=(0, None))[1] for p in (0, 100, 700, 5000)}
    assert got == want


def test_windows_and_pairs(spark):
    docs = spark.createDataFrame([(1, "Aus bus at Okha. Aus bus again.")], "id int, t string")
    names = spark.createDataFrame([(1, "aus bus")], "id int, n string")
    got = sorted((r.at, r.window) for r in nearest.windows_around(docs, names, "id", "t", "n", 3).collect())
    assert got == [(0, "Aus bus at"), (17, "h. Aus bus ag")] or [a for a, _ in got] == [0, 17]
    pairs = nearest.same_sentence(docs, "id", "t", F.array(F.lit("Aus bus")), F.array(F.lit("Okha"), F.lit("Narara")))
    assert [(r.left, r.right) for r in pairs.collect()] == [("Aus bus", "Okha")]


def test_spatial(spark):
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 1.5, 2.4), (4, None, 1.0)], "id int, lat double, lon double")
    ring = [(0.0, 0.0), (0.0, 3.0), (2.0, 3.0), (2.0, 0.0)]
    poly = spark.createDataFrame([([{"y": y, "x": x} for y, x in ring], "A")], "ring array<struct<y:double,x:double>>, village string")
    assert sorted(r.id for r in spatial.points_in_polygons(pts, poly, "lat", "lon").collect()) == [1, 3]
    near = spark.createDataFrame([(5.0, 5.1, "B"), (40.0, 40.0, "C")], "place_lat double, place_lon double, village string")
    got = {r.id: (r.village, r.method) for r in spatial.locate_or_nearest(pts, poly, near, ["id"], "lat", "lon").collect()}
    assert got == {1: ("A", "contains"), 2: ("B", "nearest"), 3: ("A", "contains"), 4: (None, "out_of_bounds")}


def test_segments_cover_and_match(spark):
    doc = "Intro line one. More words here.\n\n# Methods\n\nWe sampled Narara in March 2014. Cassiopea andromeda was found there at a depth of 5 m.\n\nSecond paragraph is a little longer than the first one was.\n\n## Results\n\nElysia obtusa occurred. " + "Long sentence goes on. " * 40
    docs = spark.createDataFrame([(1, doc), (2, ""), (3, None)], "doc_id int, text string")
    rows = segment.levels(docs).where("doc_id = 1").collect()
    assert {r.level for r in rows} == {0, 1, 2} and all(doc[r.start : r.stop] == r.body for r in rows)
    assert {r.role for r in segment.sections(docs).collect()} == {"OTHER", "METHODS", "RESULTS"}
    for by in ("sections", "paragraphs", "sentences", "fixed"):
        parts = sorted(segment.chunks(docs, most=200, overlap=40, by=by).where("doc_id = 1").collect(), key=lambda r: r.n)
        assert all(doc[r.start : r.stop] == r.body for r in parts)
        fresh = "".join(doc[r.fresh : r.stop] for r in parts)
        covered = "".join(doc[a:b] for _, a, b in segment.section_spans(doc)) if by == "sections" else doc
        assert "".join(fresh.split()) == "".join(covered.split())
        assert all(r.stop - r.fresh <= 200 for r in parts)
    context = segment.study_context(segment.sections(docs)).first().context
    assert "Narara" in context and "March 2014" in context


def test_table_safe_chunks(spark):
    table = "\n".join("| a | b | c |" for _ in range(30))
    docs = spark.createDataFrame([(1, f"Before it. {'word ' * 30}\n{table}\nAfter it.")], "doc_id int, text string")
    got = segment.table_safe_chunks(docs, most=100).collect()
    assert sum(r.has_table for r in got) == 1 and next(r for r in got if r.has_table).body.count("| a | b | c |") == 30


def test_batches(spark):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate([3, 4, 5, 9, 1, 1])], "doc string, n bigint, size int")
    got = [r.batch for r in segment.batches(df, "doc", "n", F.col("size"), 8).orderBy("n").collect()]
    assert got == [0, 0, 1, 2, 3, 3]


def test_annotations(spark):
    doc = "Cassiopea andromeda medusae were collected at Narara in March 2014, 12 specimens. C. andromeda is associated with Elysia obtusa here."
    docs = spark.createDataFrame([(1, doc)], "doc_id int, text string")
    spans = annotate.spans(docs).collect()
    assert all(doc[s.start : s.stop] == s.told for s in spans)
    assert {"TAXON", "DATE", "LIFESTAGE", "LOCALITY", "MEASUREMENT"} <= {s.label for s in spans}
    names = annotate.extract_names(docs).collect()
    assert "Cassiopea andromeda" in {n.canonical for n in names}
    rel = {(r.subject, r.predicate, r.object) for r in annotate.relations(docs, F.array(F.lit("Cassiopea andromeda"), F.lit("andromeda is"))).collect()}
    assert ("Cassiopea andromeda", "FOUND_AT", "Narara") in rel
    replies = spark.createDataFrame([(1, '[{"subject": "A b", "relation": "found_at", "object": "N", "confidence": 0.9}, {"subject": "A b", "relation": "x", "object": "N", "confidence": 0.9}]')], "id int, raw string")
    assert annotate.stated_relations(replies, "raw", "id", ["FOUND_AT"]).count() == 1


def test_tables(spark):
    doc = "Text.\n| Species | Site | Date |\n|---|---|---|\n| Aus bus | Okha | 2014 |\n| Cus dus | Narara | 2015 |\nEnd."
    found = tables.find_tables(doc)
    assert len(found) == 1 and found[0]["kinds"] == ["species", "location", "date"] and doc[found[0]["start"] : found[0]["stop"]].startswith("| Species")
    assert tables.prose_of(doc) == "Text.\nAus bus was found at Okha in 2014. Cus dus was found at Narara in 2015.\nEnd."
    docs = spark.createDataFrame([(1, doc), (2, None)], "doc_id int, text string")
    assert docs.select(tables.without_tables("text").alias("t")).where("t IS NULL").count() == 1
    assert tables.find_tables("a\tb\tc\nd\te\tf\n")[0]["mark"] == "\t"


def test_graph(spark):
    df = recs(spark, rec("A b", "P", cite="c1"), rec("A b", "P", cite="c2"), rec("C d", "P"), rec("E f", "Q")).withColumns({"family_": F.when(F.col("seq") < 2, "Fam"), "order_": F.when(F.col("seq") == 0, "Ord"), "phylum": F.lit("Phy")})
    n, e = graph.nodes(df), graph.edges(df)
    ids = {r.id for r in n.collect()}
    assert {(r.src, r.dst) for r in e.collect()} <= set(itertools.product(ids, ids))
    weight = {(r.src, r.rel, r.dst): r.weight for r in e.collect()}
    assert weight["species::a_b", "FOUND_AT", "locality::p"] == 2 and weight["family::fam", "BELONGS_TO", "order::ord"] == 1
    assert [r.label for r in graph.species_at(n, e, "p").collect()] == ["A b", "C d"]
    pairs = graph.co_occurrences(df, "validName", "verbatimLocality")
    assert sorted((r.a, r.b, r.weight) for r in pairs.collect()) == [("A b", "C d", 1), ("C d", "A b", 1)]
    assert [r.label for r in graph.seeds_for(n, e, "What about Fam?").collect()] == ["Fam"]
    assert graph.context_lines(graph.neighbours(e, n, n.where("type = 'Species'"), 5)).count() == 3
    lines = [r.line for r in graph.graphml(n, e).collect()]
    assert lines[0].startswith("<?xml") and lines[-1].endswith("</graphml>")
    assert graph.communities(e, 3).select("id").distinct().count() == len(ids)


def test_upserts(spark):
    old = spark.createDataFrame([("a", "x", 2)], "atom_id string, family_ string, times_confirmed bigint")
    new = spark.createDataFrame([("a", "y", "WoRMS", 1), ("a", "x", "", 2), ("b", "z", "", 3)], "atom_id string, family_ string, nameAccordingTo string, seq int")
    merged, diff = upserts.merge_atoms(old, new, ["family_"])
    assert {r.atom_id: (r.family_, r.times_confirmed) for r in merged.collect()} == {"a": ("x", 4), "b": ("z", 1)}
    assert [(r.field, r.old_value, r.new_value, r.resolved_by) for r in diff.collect()] == [("family_", "x", "y", "register")]
    assert {r.family_ for r in upserts.resolve_conflicts(merged, diff, ["family_"]).collect()} == {"y", "z"}
    v = spark.createDataFrame([("k", 1, "one", ""), ("k", 2, "two", "")], "key string, version int, body string, note string")
    more = upserts.append_version(v, spark.createDataFrame([("k", "two", "same"), ("l", "first", "new")], "key string, body string, note string"), ["key"])
    assert sorted((r.key, r.version) for r in more.collect()) == [("k", 1), ("k", 2), ("l", 1)]
    assert upserts.current_version(upserts.rollback(v, ["key"], v.where("version = 1").select("key", "version")), ["key"]).first().body == "one"
    atoms = spark.createDataFrame([("1", "A b", "Old", "c", 2), ("2", "A b", "New", "c", 3)], "atom_id string, valid_name string, locality string, source_citation string, times_confirmed bigint")
    moved = upserts.rekey_atoms(atoms, spark.createDataFrame([("old", "New")], "old string, new string")).collect()
    assert len(moved) == 1 and moved[0].times_confirmed == 5
    df = spark.createDataFrame([({"a": "1", "b": ""}, {"a": "2", "b": "3", "c": "4"})], "x map<string,string>, y map<string,string>")
    assert df.select(upserts.deep_merge(F.col("x"), F.col("y"))).first()[0] == {"a": "1", "b": "3", "c": "4"}


def test_articles(spark):
    df = recs(spark, rec("A b", "P", cite="c1", habitat="reef", lat=1.0, lon=2.0), rec("A b", "Q", cite="c2")).withColumns({"phylum": F.lit("Phy"), "class_": F.lit(None).cast("string"), "order_": F.lit(""), "family_": F.lit("Fam")})
    a = articles.lead_sentence(articles.species_articles(df, "seq"))
    r = a.first()
    assert r.lead == "A b is a species of the family Fam recorded from P, Q." and len(r.points) == 1 and r.order_ is None
    assert articles.markdown(a).first().body.startswith("# A b") and "<ol>" in articles.html(a).first().body
    assert [(x.citation, x.number) for x in articles.references(df, "seq").orderBy("number").collect()] == [("c1", 1), ("c2", 2)]
    s = spark.createDataFrame([("k", 1, "x [cite:b] y [cite:a]"), ("k", 2, "z [cite:a]")], "key string, n int, body string")
    index = articles.citation_index(s, "key", "n", "body")
    assert {(x.cite, x.number) for x in index.collect()} == {("b", 1), ("a", 2)}
    assert [x.body for x in articles.resolve_citations(s, index, "key", "body").orderBy("n").collect()] == ["x [1] y [2]", "z [2]"]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "coral reef fish"), (2, "deep sea coral"), (3, "forest bird")], "id int, t string")
    q = spark.createDataFrame([(9, "coral fish")], "q int, t string")
    got = retrieval.recall(retrieval.tfidf(docs, "id", "t"), q, "id", "q", "t", 2).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2]
    norms = retrieval.tfidf(docs, "id", "t").groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(r.n == pytest.approx(1) for r in norms)
    p = spark.createDataFrame([([0.5, 0.5],), ([1.0, 0.0],)], "p array<double>")
    assert [round(r[0], 4) for r in p.select(retrieval.entropy(F.col("p"))).collect()] == [0.6931, 0.0]
    flushed = retrieval.flush_buckets(spark.createDataFrame([("k", i, 5) for i in range(6)], "k string, i int, n int"), ["k"], ["i"], F.col("n"), 12, 4)
    assert [r.bucket for r in flushed.orderBy("i").collect()] == [0, 0, 0, 1, 1, 2]


def test_feedback(spark):
    rows = [(f"we collected specimens number {i}", "Primary") for i in range(40)] + [(f"reported by earlier workers {i}", "Secondary") for i in range(40)]
    df = spark.createDataFrame(rows, "text string, label string")
    assert feedback.fit_types(df.limit(10)) is None
    out = feedback.predict_types(feedback.fit_types(df), df)
    assert out.where("predicted = label").count() >= 76 and out.where("confidence NOT BETWEEN 0 AND 1").count() == 0
    assert summaries.overall_metrics(out, "label", "predicted").first().accuracy > 0.9
    cells = feedback.changed_cells(df.withColumn("k", F.col("text")).limit(1), df.withColumn("k", F.col("text")).limit(1).withColumn("label", F.lit("X")), "k", ["label"])
    assert [(r.was, r["is"]) for r in cells.collect()] == [("Primary", "X")]


def test_schemas(spark):
    df = spark.createDataFrame([("A b", "", "22.5", "x")], ["Recorded Name", "validName", "lat", "other"])
    r = canonical(df).first()
    assert r.recordedName == "A b" and r.validName is None and r.decimalLatitude == 22.5 and r.other == "x"
    assert resolve(["Office Name", "PINCODE"], {"a": ("officename",), "b": ("pincode",), "c": ("zip",)}) == {"a": "Office Name", "b": "PINCODE"}
