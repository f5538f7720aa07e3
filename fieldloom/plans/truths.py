"""Queries over tables of cases: rules on texts that SQL cannot say, with their right answers told.

Each part of the part table gets a case by its key, so a query runs over the
whole table; its SQL joins the same table with the answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import citations, coords, jsonfix, names, places, text
from fieldloom.operators import articles, dedup, filters, nearest, reconcile, retrieval, summaries, upserts
from fieldloom.plans.queries import ORACLE_SQL, QUERIES
from fieldloom.session import read_table

_SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
c = F.col


def _literal(value, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {_SQL_TYPES[kind]})"
    if kind == "string":
        # control characters are spelled as chr() calls, which a VALUES list can hold
        quoted = "'" + str(value).replace("'", "''") + "'"
        return quoted.replace("\n", "' || chr(10) || '")
    return f"{str(value).lower()}::{_SQL_TYPES[kind]}"


def truth(name: str, doc: str, inputs: str, outputs: str, cases: list[tuple], answer: Callable[[DataFrame], list[Column] | DataFrame]) -> None:
    """Register a query: inputs and outputs are "name type, ..." lists, a case has the inputs and then the outputs.

    answer gives the output columns from a table of the inputs, or a whole
    table that has p_partkey and the outputs.
    """
    fields = [tuple(x.split()) for x in outputs.split(", ")]
    n_in = len(cases[0]) - len(fields)
    n = len(cases)

    def query(spark, sf_dir):
        given = spark.createDataFrame([(k, *case[:n_in]) for k, case in enumerate(cases)], f"case_no int, {inputs}")
        rows = read_table(spark, sf_dir, "part").select("p_partkey", (c("p_partkey") % n).cast("int").alias("case_no"))
        # a row per case
        rows = rows.join(F.broadcast(given), "case_no")
        found = answer(rows)
        if isinstance(found, DataFrame):
            return found.select("p_partkey", *[c(f).cast(t).alias(f) for f, t in fields])
        return rows.select("p_partkey", *[x.cast(t).alias(f) for x, (f, t) in zip(found, fields, strict=True)])

    query.__name__, query.__doc__ = name, doc
    values = ", ".join(f"({k}, {', '.join(_literal(v, t) for v, (_, t) in zip(case[n_in:], fields, strict=True))})" for k, case in enumerate(cases))
    QUERIES[name] = query
    ORACLE_SQL[name] = f"SELECT p_partkey, {', '.join(f for f, _ in fields)} FROM part JOIN (VALUES {values}) t(case_no, {', '.join(f for f, _ in fields)}) ON p_partkey % {n} = case_no"


# ---------------------------------------------------------------- names

truth("life_stage_words", "Life stages, abbreviations and names.", "t string", "kind string", [("medusa", "life_stage"), ("Egg masses", "life_stage"), ("post-larvae found", "life_stage"), ("A. aurita", "abbreviation"), ("Aurelia aurita", None), ("", None), (None, None)], lambda d: [names.not_a_taxon("t")])
truth("open_nomenclature", "Open nomenclature removed.", "t string", "name string", [("Aurelia cf. aurita", "Aurelia aurita"), ("Siganus sp.", "Siganus"), ("Conus n. sp. textile", "Conus textile"), ("Perna viridis", "Perna viridis"), (None, "")], lambda d: [names.clean_open_nomenclature("t")])
truth("name_cardinality", "Genus or species by the number of words.", "t string", "n int", [("Aurelia", 1), ("Aurelia aurita", 2), ("Aurelia aurita aurita", 2), ("", 0), (None, 0)], lambda d: [names.cardinality("t")])
truth("taxon_ranks", "Rank told by the words of a name.", "t string", "rank string", [("Aurelia cf. aurita", "species"), ("Aurelia sp.", "genus"), ("Panthera leo persica", "subspecies"), ("", "unranked")], lambda d: [names.taxon_rank("t")])
truth("genus_initials", "Initial of a genus.", "t string", "initial string", [("aurelia aurita", "A"), (" Perna", "P"), ("", "")], lambda d: [names.genus_initial("t")])
truth("binomial_casing", "First word capitalised.", "t string", "name string", [("AURELIA  AURITA", "Aurelia aurita"), ("perna Viridis", "Perna viridis"), ("", "")], lambda d: [names.binomial_case("t")])
truth("occurrence_type_titles", "Occurrence types spelled in one way.", "t string", "kind string", [("primary", "Primary"), ("SECONDARY", "Secondary"), ("uncertain", "Uncertain"), ("perhaps", "Uncertain"), (None, "Uncertain")], lambda d: [names.title_type("t")])
truth("latin_scores", "Share of a name's trigrams that genera have.", "t string", "score double", [("Perna", 1.0), ("Qqqqqq", 0.0), ("ab", 0.0), ("Conus", 1.0)], lambda d: [names.latin_score("t")])
truth("classification_ranks", "Ranks of a classification path.", "path string, ranks string", "phylum string, order_ string", [("Animalia|Cnidaria|Scyphozoa", "kingdom|phylum|class", "Cnidaria", None), ("Mollusca|Mytilida", "Phylum|Order", "Mollusca", "Mytilida"), (None, None, None, None)], lambda d: [names.rank_of(c("path"), c("ranks"), "phylum"), names.rank_of(c("path"), c("ranks"), "order")])
truth(
    "name_confidence_weights",
    "Weighted agreement of sources.",
    "s double, status string, m string, b string, marine boolean, cat boolean, ser boolean",
    "confidence double",
    [(1.0, "accepted", "EXACT", "ACCEPTED", True, True, True, 1.0), (0.5, "synonym", "FUZZY", "SYNONYM", False, False, False, 0.23), (0.9, "none", "EXACT", "DOUBTFUL", False, True, False, 0.1), (None, None, None, None, None, None, True, 0.05)],
    lambda d: [names.name_confidence(*[c(x) for x in ("s", "status", "m", "b", "marine", "cat", "ser")])],
)
truth("usable_name_rules", "Placeholders, short names and pieces of JSON are no names.", "r string, v string", "usable boolean", [("Aurelia aurita", "", True), ("__candidate_1_2", "Perna", False), ("", "", False), ('[{"a"', "", False), ("abc", "Abc def", False), ("Perna", None, True)], lambda d: [names.usable_name("r", "v")])


def _usable(d: DataFrame) -> DataFrame:
    kept, gone = filters.usable_names(d.select("p_partkey", c("r").alias("recordedName"), c("v").alias("validName")))
    return kept.select("p_partkey", F.lit("kept").alias("side")).unionByName(gone.select("p_partkey", F.lit("rejected").alias("side")))


truth("usable_names_split", "Kept and rejected records.", "r string, v string", "side string", [("Aurelia aurita", "", "kept"), ("__candidate_3_4", "", "rejected"), ("12", "", "rejected")], _usable)

# ---------------------------------------------------------------- places and coordinates

truth("core_places", "Prepositions and administrative words removed.", "t string", "place string", [("near Okha, Gujarat", "Okha"), ("off Veraval", "Veraval"), ("Jamnagar district", "Jamnagar"), ("Port Blair", "Port Blair"), (None, "")], lambda d: [places.core_place("t")])
truth("country_hint", "The country added unless it is told.", "t string", "place string", [("Okha", "Okha, India"), ("Kochi, Kerala", "Kochi, Kerala"), ("Chilika,", "Chilika, India"), ("Port Blair, Andaman", "Port Blair, Andaman")], lambda d: [places.with_country("t")])
truth("place_classes", "Anatomy, habitat or place.", "t string", "kind string", [("Gulf of Kutch", None), ("umbrella 5 cm", "morphology"), ("Intertidal zone", "habitat"), ("found near Okha", "habitat_with_place"), ("Not reported", None), ("coral reef", "habitat")], lambda d: [places.place_class("t")])
truth("proper_nouns", "A capitalised word after the first.", "t string", "has boolean", [("found near Okha", True), ("rocky reef", False), ("Okha", False), ("the Reef", False)], lambda d: [places.has_proper_noun("t")])
truth("rescued_places", "The place after a preposition.", "t string", "place string", [("collected at Pirotan Island, 2 m", "Pirotan Island"), ("no place told", None), ("near Ok.", None), ("from Veraval", "Veraval")], lambda d: [places.rescued_place("t")])
truth("states_named", "The first state that a text names.", "t string", "state string", [("Veraval, Gujarat", "gujarat"), ("from Kerala to Goa", "goa"), ("nowhere", None)], lambda d: [places.state_in("t")])
truth("enriched_places", "Place, district and state.", "p string, d string, s string", "place string", [("Okha", "Devbhumi Dwarka", "Gujarat", "Okha, Devbhumi Dwarka District, Gujarat"), ("Okha", "", "Gujarat", "Okha, Gujarat"), ("Okha", None, None, "Okha")], lambda d: [places.enriched_place(c("p"), c("d"), c("s"))])
truth("site_lists", "Lists of sites, and hierarchies that are one.", "t string", "n int, first string", [("Okha; Dwarka; Veraval", 3, "Okha"), ("Gulf of Kutch, Gujarat", 1, "Gulf of Kutch, Gujarat"), ("Okha (north), Dwarka", 1, "Okha (north), Dwarka")], lambda d: [F.size(places.split_sites("t")), F.get(places.split_sites("t"), F.lit(0))])
truth("compound_places", "Parts of a compound locality.", "t string", "parts string", [("Okha and Dwarka", "Okha|Dwarka"), ("Okha (near Beyt)", "Okha|Beyt"), ("Station 4", "Station 4"), ("Okha/Positra", "Okha|Positra")], lambda d: [F.array_join(places.split_compound("t"), "|")])
truth("phonetic_places", "Spellings of one place meet in its sound key.", "a string, b string", "same boolean", [("Veraval", "Verawal", True), ("Okha", "Oka", True), ("Okha", "Mandvi", False)], lambda d: [places.phonetic_place("a") == places.phonetic_place("b")])
truth("canonical_keys", "Canonical keys of places.", "t string", "key string", [("Khambhat", "kambat"), ("Veeraval", "birabal"), ("Okha (Port)", "oka"), ("Sikka Dist", "sika")], lambda d: [places.canonical_place("t")])
truth("safe_numbers", "Numbers, zero among them.", "t string", "x double", [("0", 0.0), (" 12.5 ", 12.5), ("abc", None), ("", None), ("-3", -3.0)], lambda d: [coords.to_double("t")])
truth("marine_words", "Whether texts tell of the sea.", "a string, b string", "marine boolean", [("coral reef", "", True), ("hill forest", "path", False), (None, "trawl", True)], lambda d: [coords.is_marine("a", "b")])
_CHECKED = [
    (91.0, 70.0, "", "", None, "INVALID_RANGE lat"),
    (20.0, 190.0, "", "", None, "INVALID_RANGE lon"),
    (22.5, 70.0, "", "Okha, Gujarat", 22.5, None),
    (22.5, 85.0, "", "Okha, Gujarat", None, "OUTSIDE_STATE_BOX gujarat"),
    (50.0, 10.0, "", "", None, "OUTSIDE_COUNTRY_BOX"),
    (3.0, 60.0, "deep sea", "", 3.0, "MARINE_OFFSHORE_ALLOWED"),
    (None, 60.0, "", "", None, None),
]
truth("coordinate_rules", "Coordinates held against ranges and boxes.", "lat double, lon double, told string, place string", "kept double, note string", _CHECKED, lambda d: [coords.checked(c("lat"), c("lon"), c("told"), c("place"))["lat"], coords.checked(c("lat"), c("lon"), c("told"), c("place"))["note"]])
truth("feedback_points", "Points that feedback may set.", "lat double, lon double", "valid boolean", [(0.0, 0.0, False), (10.0, 20.0, True), (95.0, 0.0, False), (0.0, 5.0, True)], lambda d: [filters.valid_feedback_point(c("lat"), c("lon"))])
truth("coordinates_in_text", "Pairs of decimal degrees in a text.", "t string", "n int, lat double, lon double", [("at 22.47 N, 69.07 E", 1, 22.47, 69.07), ("from 12.34, 75.60 to 12.40, 75.66", 2, 12.34, 75.6), ("none", 0, None, None)], lambda d: [F.size(nearest.coordinates_in("t")), F.get(nearest.coordinates_in("t"), F.lit(0))["lat"], F.get(nearest.coordinates_in("t"), F.lit(0))["lon"]])


def _by_code(d: DataFrame) -> DataFrame:
    boxes = d.sparkSession.createDataFrame([("361350", 22.0, 23.0, 69.0, 70.0)], "code string, lat_min double, lat_max double, lon_min double, lon_max double")
    return filters.check_by_code(d.withColumnsRenamed({"t": "verbatimLocality", "a": "decimalLatitude", "b": "decimalLongitude"}), boxes).withColumnRenamed("decimalLatitude", "lat")


truth("postal_boxes", "Coordinates held against the box of a postal code.", "t string, a double, b double", "lat double, coordinate_note string", [("Okha 361350", None, None, 22.5, "FROM_CODE"), ("Okha 361350", 10.0, 10.0, None, "OUTSIDE_CODE_BOX"), ("Okha 361350", 22.1, 69.2, 22.1, None), ("Okha", 1.0, 2.0, 1.0, None)], _by_code)
truth(
    "locality_guards",
    "Anatomy and habitat in the locality column.",
    "t string, h string",
    "place string, hab string, was string",
    [("umbrella 5 cm", "", "Not Reported", "", "umbrella 5 cm"), ("found near Okha", "", "Okha", "found near Okha", None), ("Intertidal zone", "rock", "Not Reported", "rock", None), ("Veraval", "", "Veraval", "", None)],
    lambda d: filters.guard_localities(d.withColumnsRenamed({"t": "verbatimLocality", "h": "habitat"})).select("p_partkey", c("verbatimLocality").alias("place"), c("habitat").alias("hab"), c("locality_was").alias("was")),
)
truth(
    "checked_records",
    "Coordinates read from text and checked.",
    "a string, b string, place string",
    "lat double, note string",
    [("22.5", "70.0", "Okha, Gujarat", 22.5, None), ("95", "70", "x", None, "INVALID_RANGE lat"), ("", "", "x", None, None)],
    lambda d: filters.check_coordinates(d.select("p_partkey", c("a").alias("decimalLatitude"), c("b").alias("decimalLongitude"), c("place").alias("verbatimLocality"))).select("p_partkey", c("decimalLatitude").alias("lat"), c("coordinate_note").alias("note")),
)

# ---------------------------------------------------------------- texts

truth("section_roles", "Roles of headings.", "t string", "role string", [("Materials and Methods", "METHODS"), ("Abstract", "ABSTRACT"), ("Results", "RESULTS"), ("Systematics", "TAXONOMY"), ("Acknowledgements", "OTHER"), ("Background", "INTRODUCTION"), (None, "OTHER")], lambda d: [text.section_role("t")])
truth("layout_roles", "Roles of layout labels.", "t string", "role string", [("table", "TABLES"), ("caption", None), ("Results", "RESULTS"), ("page_header", None)], lambda d: [text.layout_role("t")])
truth("sentences_with_species", "Sentences that name a species.", "t string", "has boolean", [("We saw Aurelia aurita.", True), ("In March sampling began", False), ("A Siganus sp. seen", True), ("nothing here", False)], lambda d: [text.names_species("t")])
truth("binomials_in_text", "Two-word names.", "t string", "names string", [("Aurelia aurita and Table two and Aurelia aurita", "Aurelia aurita"), ("Perna viridis near Conus textile", "Perna viridis|Conus textile"), ("none", "")], lambda d: [F.array_join(text.binomials("t"), "|")])
truth("places_in_text", "Capitalised names of places.", "t string", "names string", [("the Gulf of Kutch and Okha", "Gulf of Kutch|Okha"), ("see Table and Okha", "Okha"), ("none", "")], lambda d: [F.array_join(text.places_named("t"), "|")])
truth("locality_contexts", "Places, dates and depths of a text.", "t string", "sites string, dates string, depths string", [("Okha in March 2004 at depth of 12 m", "Okha|March", "March 2004", "at depth of 12 m"), ("none", "", "", "")], lambda d: [F.array_join(text.locality_context("t")[k], "|") for k in ("localities", "dates", "depths")])
truth("occurrence_types", "Types by signals.", "t string", "kind string", [("specimens were collected and examined", "Primary"), ("reported by Rao", "Secondary"), ("nothing told", "Uncertain")], lambda d: [text.occurrence_type("t")])
truth("source_types", "Kinds of source.", "t string", "kind string, stands string", [("holotype in museum", "type_material", "Primary"), ("museum voucher", "museum_specimen", "Primary"), ("reported by Rao", "secondary_literature", "Secondary"), ("present study", "primary_collection", "Primary"), ("", "unknown", "Uncertain")], lambda d: [text.source_type("t"), text.type_of_source(text.source_type("t"))])
truth("habitat_classes", "First class whose keyword a text holds.", "t string", "kind string", [("dead coral", "coral reef"), ("mangrove mud", "mangrove"), ("deep slope", "deep sea"), ("", "not reported")], lambda d: [text.habitat_class("t")])
truth("nomenclatural_states", "Status patterns.", "t string", "status string", [("Aus bus sp. nov.", "sp. nov."), ("redescription of Aus", "re-description"), ("first report from Okha", "new record"), ("", "established")], lambda d: [text.nomenclatural_status("t")])
_FACTS = "Holotype ZSI/CRC/1234, type locality: Okha reef on the coast. 12-15 mm long"
truth("specimen_patterns", "What patterns tell of a specimen.", "t string", "type_status string, site string, low double, high double", [(_FACTS, "holotype", "Okha reef on the coast", 12.0, 15.0), ("none", None, None, None, None)], lambda d: [text.specimen_facts("t")[k] for k in ("type_status", "type_locality", "size_min_mm", "size_max_mm")])
truth("guarded_sentence_ends", "Sentences that abbreviations do not end.", "t string", "parts string", [("Seen by Dr. Rao at Okha. It was alive. Fig. 2 shows it.", "Seen by Dr. Rao at Okha.|It was alive.|Fig. 2 shows it."), ("One only", "One only"), ("", "")], lambda d: [F.array_join(text.guarded_sentences("t"), "|")])
truth("paragraph_parts", "Paragraphs of more than twenty letters.", "t string", "n int", [("This paragraph is long enough.\n\nshort\n\nAnother one that is long enough.", 2), ("short", 0), ("", 0)], lambda d: [F.size(text.paragraphs("t"))])
truth("page_estimates", "Page of a position.", "p int, l int, n int", "page int", [(0, 100, 10, 1), (50, 100, 10, 5), (100, 100, 10, 10), (5, 0, 3, 15)], lambda d: [text.page_of(c("p"), c("l"), c("n"))])
truth("expected_counts", "The number of species that a text states.", "t string", "n int", [("45 species and 12 taxa", 45), ("1 species", None), ("6000 species", None), ("none", None)], lambda d: [text.expected_count("t")])
truth("scan_cleanup", "Scanned text mended.", "t string", "clean string, scanned boolean", [("inter-\ntidal  zone", "intertidal zone", True), ("plain", "plain", True), ("x" * 90, "x" * 90, False)], lambda d: [text.clean_scan("t"), text.is_scanned(F.length("t"))])
truth("noise_titles", "Titles that are none.", "t string", "noise boolean", [("Untitled document", True), ("short", True), ("A checklist of the fishes of Okha", False), ("Microsoft Word - paper.doc", True)], lambda d: [text.noise_title("t")])
truth("title_ladder", "The first title that is no noise.", "a string, b string, l string", "title string, line string, cut string", [("Untitled", "A checklist of the fishes of Okha", "abc\nA checklist of fishes\n", "A checklist of the fishes of Okha", "A checklist of fishes", "A checklist of the"), ("", "", "", "", "", "")], lambda d: [text.best_title(c("a"), c("b")), text.first_good_line("l"), text.trimmed_title("b", 20)])
truth("page_texts", "Text of a page without tags.", "t string", "body string", [("<p>a <b>b</b></p><script>x</script>", "a b"), ("plain", "plain"), (None, "")], lambda d: [text.html_text("t")])
truth("author_names", "Surnames in a document's head.", "t string", "names string, tokens string", [("Smith et al. 2001", "Smith", "smith|et|al"), ("Nair and Pillai", "Nair|Pillai", "nair|and|pillai"), ("J. K. Rao", "Rao", "rao"), ("", "", "")], lambda d: [F.array_join(text.authors_named("t"), "|"), F.array_join(text.author_tokens("t"), "|")])
truth("citation_marks", "Marks replaced by numbers.", "t string", "body string", [("a [cite:k1] b [cite:k2]", "a [1] b [2]"), ("a [cite:zz]", "a [cite:zz]"), (None, "")], lambda d: [text.cite_numbers("t", F.create_map(F.lit("k1"), F.lit(1), F.lit("k2"), F.lit(2)))])
truth("chunk_relevance_scores", "Relevance of a chunk to a species.", "t string, s string", "score double", [("Aurelia aurita habitat", "Aurelia aurita", 1.0), ("aurelia seen", "Aurelia aurita", 0.15), ("none", "Aurelia aurita", 0.0)], lambda d: [F.round(text.chunk_relevance("t", "s"), 6)])
truth("repaired_replies", "Records of replies in broken JSON.", "t string", "found string", [('<think>x</think>[{"a": 1}]', '{"a": 1}'), ('Sure:\n```json\n[{"a": 1}, {"a": 2', '{"a": 1};{"a": 2}'), ('{"records": [{"a": 3}]}', '{"a": 3}'), ("none", ""), ('[{"a": "x"}, {"b"', '{"a": "x"}'), (None, "")], lambda d: [F.array_join(jsonfix.json_records("t"), ";")])

# ---------------------------------------------------------------- citations and files

truth("study_areas", "Areas that titles name.", "t string", "area string", [("Fauna in the Gulf of Kutch: a list", "Gulf of Kutch"), ("Reefs (Okha, India)", "Okha, India"), ("No area told", "")], lambda d: [citations.study_area("t")])
truth("dois", "DOIs in texts.", "t string", "doi string", [("see https://doi.org/10.1234/abc.def.", "10.1234/abc.def"), ("10.5555/XYZ-1)", "10.5555/XYZ-1"), ("none", "")], lambda d: [citations.doi("t")])
truth("file_citations", "Citations that are file names.", "t string", "is_file boolean, cited string", [("rao_2004.pdf", True, "The document"), ("Rao 2004", True, "The document"), ("Rao, A. 2004. Fauna of the reef.", False, "Rao, A. 2004. Fauna of the reef.")], lambda d: reconcile.fill_citation(d.withColumns({"sourceCitation": c("t"), "is_file": citations.looks_like_file("t")}), F.lit("The document")).withColumn("cited", c("sourceCitation")))
_REFS = [
    (["Rao"], "2004", "Fauna", "journal", "J Nat", "12", "3", "1-9", "10.1/x", "", 'Rao (2004). "Fauna." *J Nat*, 12(3): 1-9. https://doi.org/10.1/x.', "@article"),
    (["Rao", "Nair"], "2004", "Fauna", "book", "", "", "", "", "", "ZSI", "Rao & Nair (2004). *Fauna*. ZSI.", "@book"),
    ([], "", "", "web", "", "", "", "", "", "", "Anonymous (n.d.). Untitled.", "@book"),
    (["A", "B", "C", "D"], "1999", "T", "web", "", "", "", "", "", "", "A et al. (1999). T.", "@book"),
]
_PARTS = ("who", "y", "ti", "k", "j", "v", "i", "pg", "doi", "pub")
truth("reference_lines", "References in author-date style and in BibTeX.", "who array<string>, y string, ti string, k string, j string, v string, i string, pg string, doi string, pub string", "line string, entry string", _REFS, lambda d: [citations.reference_line(*map(c, _PARTS)), F.regexp_extract(citations.bibtex_entry(F.lit("key"), *map(c, _PARTS)), r"^(@\w+)", 1)])
truth("citation_texts", "Citations put together.", "who array<string>, y string, ti string, j string", "cited string, stem string", [(["Rao", "Nair"], "2004", "Fauna of Okha", "J Nat", "Rao; Nair. 2004. Fauna of Okha. J Nat", "Rao_2004_Fauna_of_Okha"), (["Rao"], "", "A/B: c", "", "Rao. A/B: c", "Rao_A_B_c")], lambda d: [citations.citation_text(*map(c, ("who", "y", "ti", "j"))), citations.file_stem(F.get("who", F.lit(0)), c("y"), c("ti"))])

# ---------------------------------------------------------------- arrays, maps and numbers

truth("case_blind_unions", "Lists united without regard to case.", "a array<string>, b array<string>", "u string", [(["x", "Y"], ["y", "z"], "x|Y|z"), ([], ["a", "A"], "a"), (None, ["b"], "b")], lambda d: [F.array_join(dedup.union_ignoring_case(c("a"), c("b")), "|")])
truth("longer_texts", "The longer of two texts, the first of equals.", "a string, b string", "longer string, once string", [("ab", "abc", "abc", "ab\n\nabc"), ("abc", "xyz", "abc", "abc\n\nxyz"), (None, "b", "b", "b"), ("has b", "b", "has b", "has b")], lambda d: [articles.prefer_longer(c("a"), c("b")), articles.append_once(c("a"), c("b"))])
truth("merged_maps", "Maps merged; filled values stay.", "a map<string,string>, b map<string,string>", "x string, y string", [({"x": "1", "y": ""}, {"x": "9", "y": "2"}, "1", "2"), ({}, {"x": "9"}, "9", None)], lambda d: [upserts.deep_merge(c("a"), c("b"))["x"], F.try_element_at(upserts.deep_merge(c("a"), c("b")), F.lit("y"))])
truth("uncertainty_measures", "Entropy and margin of probabilities.", "p array<double>", "e double, m double", [([0.5, 0.5], 0.693147, 0.0), ([0.7, 0.2, 0.1], 0.801819, 0.5), ([1.0, 0.0], 0.0, 1.0)], lambda d: [F.round(retrieval.entropy(c("p")), 6), F.round(retrieval.margin(c("p")), 6)])
truth("time_left", "Seconds left at a mean duration.", "e double, n int, w int", "left_s double", [(2.0, 10, 4, 5.0), (2.0, 10, 0, 20.0), (1.5, 0, 3, 0.0)], lambda d: [summaries.eta(c("e"), c("n"), c("w"))])
truth(
    "record_validation",
    "Flags and confidence caps of records.",
    "n string, p string, f double",
    "flags string, confidence double",
    [("", "Okha", 0.9, "missing_name", 0.0), ("Aurelia", "umbrella 5 cm", 0.9, "suspicious_locality", 0.4), ("Aurelia", "unknown", 0.9, "missing_locality", 0.5), ("Aurelia", "Okha", 0.9, "", 0.9)],
    lambda d: filters.record_flags(d.select("p_partkey", c("n").alias("validName"), F.lit(None).cast("string").alias("recordedName"), c("p").alias("verbatimLocality"), c("f").alias("confidence"))).withColumn("flags", F.array_join("flags", "|")),
)
_AREA = "Fauna in the Gulf of Kutch"
truth("locality_enhancement", "Short places followed by the study area.", "p string, lat double", "place string", [("Okha", None, "Okha, Gulf of Kutch"), ("Marine National Park at Pirotan", None, "Marine National Park at Pirotan"), ("Okha", 1.0, None), ("unknown", None, None)], lambda d: reconcile.enhance_localities(d.withColumns({"verbatimLocality": c("p"), "decimalLatitude": c("lat"), "decimalLongitude": c("lat")}), F.lit(_AREA)).withColumn("place", c("enhanced_locality")))
truth(
    "reconciliation_rules",
    "Primary records that are secondary.",
    "kind string, cited string, told string",
    "occurrenceType string, rule string",
    [("Primary", "Rao 2010", "collected", "Secondary", "citation_mismatch"), ("Primary", "", "according to Nair it lives here", "Secondary", "historical"), ("Primary", "", "collected in 1990", "Secondary", "older_year"), ("Primary", "Smith 2014", "collected in 2013", "Primary", None), ("Uncertain", "Rao 2010", "", "Uncertain", None)],
    lambda d: reconcile.reconcile_types(d.select("p_partkey", c("kind").alias("occurrenceType"), c("cited").alias("sourceCitation"), c("told").alias("rawTextEvidence")), F.lit("Smith, J. 2014. Fauna")),
)
