"""Rules on names, places, citations and texts over columns of the tables, with the rules stated in SQL.

What a row says differs from row to row: whole texts of documents, or texts put
together from a row's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import citations, coords, jsonfix, names, places, text
from fieldloom.functions import vocabulary as V
from fieldloom.operators import annotate, dedup, filters, retrieval, summaries, upserts
from fieldloom.plans.queries import query
from fieldloom.session import read_table

c = F.col


def _in_sql(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _text_of(parts: list, *rest) -> Column:
    return F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in [*parts, *rest]])


# ---------------------------------------------------------------- whole texts of documents

#: Word boundaries beside letters beyond ASCII are told differently by different engines.
_PLAIN_SQL = r"d AS (SELECT doc_id, n_chars, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'x', 'g') AS t FROM documents)"
_ORDERED = lambda found: f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"


def _plain(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "x").alias("t"))


@query(
    rf"""WITH {_PLAIN_SQL}, f AS (SELECT doc_id, regexp_extract_all(t, '{V.BINOMIAL}') AS b, regexp_extract_all(t, '{V.PLACE}') AS p FROM d),
        k AS (SELECT doc_id, list_filter({_ORDERED("b")}, lambda n: regexp_extract(n, '^\S+') NOT IN ({_in_sql(V.NOT_GENERA)})) AS b,
                     list_filter({_ORDERED("p")}, lambda n: regexp_extract(n, '^\S+') NOT IN ({_in_sql(V.NOT_PLACES)}))[1:20] AS p FROM f)
        SELECT doc_id, len(b)::INTEGER AS n_names, array_to_string(b, '|') AS names, array_to_string(p, '|') AS places FROM k"""
)
def document_names(spark, sf_dir):
    """Two-word names and places of whole texts, in order of appearance."""
    d = _plain(spark, sf_dir)
    return d.select("doc_id", F.size(text.binomials("t")).alias("n_names"), F.array_join(text.binomials("t"), "|").alias("names"), F.array_join(text.places_named("t"), "|").alias("places"))


_SAID_SQL = r"""s AS (SELECT doc_id, t || CASE doc_id % 6 WHEN 1 THEN ' Specimens were collected and examined.' WHEN 2 THEN ' Reported by Rao, cited by Nair.' WHEN 3 THEN ' Aus bus sp. nov., holotype on dead coral.'
        WHEN 4 THEN ' First report of ' || (doc_id % 60) || ' species in mangrove mud.' WHEN 5 THEN ' Museum voucher.' ELSE '' END AS t FROM d)"""


def _said(spark, sf_dir) -> DataFrame:
    k = c("doc_id") % 6
    more = F.when(k == 1, " Specimens were collected and examined.").when(k == 2, " Reported by Rao, cited by Nair.").when(k == 3, " Aus bus sp. nov., holotype on dead coral.")
    more = more.when(k == 4, _text_of([" First report of ", (c("doc_id") % 60).cast("string"), " species in mangrove mud."])).when(k == 5, " Museum voucher.").otherwise("")
    return _plain(spark, sf_dir).select("doc_id", F.concat("t", more).alias("t"))


@query(
    rf"""WITH {_PLAIN_SQL}, {_SAID_SQL}, n AS (SELECT *, lower(t) AS low, len(regexp_extract_all(t, '{V.PRIMARY_SIGNALS}')) AS a, len(regexp_extract_all(t, '{V.SECONDARY_SIGNALS}')) AS b,
            list_max(list_filter(list_transform(regexp_extract_all(t, '{V.EXPECTED_COUNT}', 1), lambda x: try_cast(x AS INTEGER)), lambda x: x > 1 AND x < 5000)) AS expected FROM s)
        SELECT doc_id, CASE WHEN a > b THEN 'Primary' WHEN b > a THEN 'Secondary' ELSE 'Uncertain' END AS kind,
               CASE WHEN regexp_matches(low, 'holotype|paratype|type specimen|type material') THEN 'type_material' WHEN regexp_matches(low, 'museum|specimen|voucher|herbarium') THEN 'museum_specimen'
                    WHEN regexp_matches(low, 'reported by|according to|cited|literature|previous') THEN 'secondary_literature' WHEN regexp_matches(low, 'collected|present study|this study|survey|observed') THEN 'primary_collection' ELSE 'unknown' END AS source,
               CASE {" ".join(f"WHEN contains(low, '{w}') THEN '{n}'" for n, w in V.HABITAT_CLASSES)} ELSE 'not reported' END AS habitat,
               CASE {" ".join(f"WHEN regexp_matches(t, '{p}') THEN '{s}'" for p, s in V.STATUS)} ELSE 'established' END AS status, expected FROM n"""
)
def document_signals(spark, sf_dir):
    """What whole texts tell of their records: type, source, habitat, status, expected species."""
    s = _said(spark, sf_dir)
    return s.select("doc_id", text.occurrence_type("t").alias("kind"), text.source_type("t").alias("source"), text.habitat_class("t").alias("habitat"), text.nomenclatural_status("t").alias("status"), text.expected_count("t").alias("expected"))


@query(
    """SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x, ' ')) > 20))::INTEGER AS paragraphs,
              greatest(1, round((doc_id % n_chars)::DOUBLE / greatest(n_chars, 1) * 12))::INTEGER AS page, n_chars / 40.0 < 80 AS scanned FROM documents"""
)
def document_layout(spark, sf_dir):
    """Paragraphs of more than twenty characters, the page of a position, and whether pages hold too little text."""
    d = read_table(spark, sf_dir, "documents")
    spaced = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))
    page = text.page_of((c("doc_id") % c("n_chars")).cast("double"), c("n_chars").cast("double"), F.lit(12))
    return d.select("doc_id", F.size(text.paragraphs(spaced)).alias("paragraphs"), page.alias("page"), text.is_scanned(c("n_chars") / 40.0).alias("scanned"))


# ---------------------------------------------------------------- names and citations of parts

_FORM = "CASE p_size % 4 WHEN 0 THEN p_name || ' sp.' WHEN 1 THEN regexp_replace(p_name, ' ', ' cf. ') WHEN 2 THEN p_name || '  minor' ELSE p_name END"


@query(
    f"""SELECT p_partkey, CASE WHEN p_size % 4 = 2 THEN p_name || ' minor' ELSE p_name END AS clean, CASE WHEN p_size % 4 = 2 THEN 'subspecies' ELSE 'species' END AS rank, 2 AS words, 1 AS first_words,
               upper(p_name[1]) AS initial, upper(p_name[1]) || lower(replace(p_name[2:], '  ', ' ')) AS cased, upper(p_type[1]) || lower(p_type[2:]) = 'Primary' AS is_primary FROM part"""
)
def part_name_forms(spark, sf_dir):
    """Names with open nomenclature: cleaned, ranked, counted, cased."""
    k = c("p_size") % 4
    form = F.when(k == 0, F.concat("p_name", F.lit(" sp."))).when(k == 1, F.replace("p_name", F.lit(" "), F.lit(" cf. "))).when(k == 2, F.concat("p_name", F.lit("  minor"))).otherwise(c("p_name"))
    p = read_table(spark, sf_dir, "part").withColumn("form", form)
    return p.select(
        "p_partkey", names.clean_open_nomenclature("form").alias("clean"), names.taxon_rank("form").alias("rank"), names.cardinality("p_name").alias("words"), names.cardinality(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("first_words"),
        names.genus_initial("p_name").alias("initial"), names.binomial_case(F.upper(F.replace("p_name", F.lit(" "), F.lit("  ")))).alias("cased"), (names.title_type("p_type") == "Primary").alias("is_primary"),
    )


_YEAR_SQL = "CASE WHEN p_size % 5 = 0 THEN '' ELSE (1960 + p_size)::VARCHAR END"


@query(
    rf"""WITH r AS (SELECT *, {_YEAR_SQL} AS y, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'J ' || p_type END AS j, '10.' || (1000 + p_partkey) || '/' || lower(replace(p_brand, '#', '.')) AS doi FROM part)
        SELECT p_partkey, p_brand || '; ' || p_type || CASE WHEN y = '' THEN '' ELSE '. ' || y END || '. ' || p_name || CASE WHEN j = '' THEN '' ELSE '. ' || j END AS cited,
               trim(regexp_replace(p_brand || '_' || CASE WHEN y = '' THEN '' ELSE y || '_' END || p_name, '[^A-Za-z0-9]+', '_', 'g'), '_') AS stem,
               p_brand || ' & ' || p_type || ' (' || CASE WHEN y = '' THEN 'n.d.' ELSE y END || '). "' || p_name || '." *' || j || '*, ' || p_size || ': 1-9. https://doi.org/' || doi || '.' AS line, doi,
               length(p_name || '.pdf') < 20 OR p_size % 2 = 0 AS is_file FROM r"""
)
def part_citations(spark, sf_dir):
    """Citations, file stems, references, DOIs in texts, and citations that are file names."""
    p = read_table(spark, sf_dir, "part")
    year = F.when(c("p_size") % 5 == 0, "").otherwise((1960 + c("p_size")).cast("string"))
    journal = F.when(c("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("J "), "p_type"))
    who, key = F.array("p_brand", "p_type"), _text_of(["10.", (1000 + c("p_partkey")).cast("string"), "/", F.lower(F.replace("p_brand", F.lit("#"), F.lit(".")))])
    line = citations.reference_line(who, year, c("p_name"), F.lit("journal"), journal, c("p_size").cast("string"), F.lit(""), F.lit("1-9"), key, F.lit(""))
    told = F.when(c("p_size") % 2 == 0, _text_of([c("p_name"), " and much more about it.pdf"])).otherwise(F.concat("p_name", F.lit(".pdf")))
    plain = F.when(c("p_size") % 2 == 0, told).otherwise(told)
    return p.select("p_partkey", citations.citation_text(who, year, c("p_name"), journal).alias("cited"), citations.file_stem(c("p_brand"), year, c("p_name")).alias("stem"), line.alias("line"), citations.doi(_text_of(["see https://doi.org/", key, ")."])).alias("doi"), citations.looks_like_file(plain).alias("is_file"))


def _told_parts(spark, sf_dir) -> DataFrame:
    """A sentence or two about each part."""
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 100))
    more = F.when(c("p_size") % 2 == 0, _text_of([name, " lives at ", c("p_size").cast("string"), "-", (c("p_size") + 3).cast("string"), " m depth."])).otherwise(_text_of([name, " lives on sandy bottom."]))
    return read_table(spark, sf_dir, "part").select(c("p_partkey").alias("doc_id"), _text_of([name, " was found at ", F.initcap("p_type"), " Harbour. ", more]).alias("text"))


_TOLD_SQL = """n AS (SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS name, upper(p_type[1]) || lower(p_type[2:]) || ' Harbour' AS place, p_size FROM part),
    t AS (SELECT p_partkey AS doc_id, name AS subject, 'FOUND_AT' AS predicate, place AS object, 0.8::DOUBLE AS confidence FROM n
          UNION ALL SELECT p_partkey, name, 'HAS_DEPTH', p_size || '-' || (p_size + 3), 0.75 FROM n WHERE p_size % 2 = 0
          UNION ALL SELECT p_partkey, name, 'HAS_HABITAT', 'sandy bottom', 0.7 FROM n WHERE p_size % 2 = 1)"""


@query(f"WITH {_TOLD_SQL} SELECT doc_id, subject, predicate, object, confidence FROM t")
def part_relations(spark, sf_dir):
    """Triples that sentences about parts tell."""
    return annotate.relations(_told_parts(spark, sf_dir))


@query(f"WITH {_TOLD_SQL} SELECT 'REL_' || predicate AS rel, object AS label, count(*) AS weight FROM t GROUP BY ALL")
def part_relation_edges(spark, sf_dir):
    """Typed edges of those triples, by what they reach."""
    nodes, edges = annotate.relation_graph(annotate.relations(_told_parts(spark, sf_dir)))
    reached = edges.join(nodes.select(c("id").alias("dst"), "label"), "dst")
    return reached.groupBy("rel", "label").agg(F.sum("weight").alias("weight"))


@query(
    """WITH r AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '' ELSE p_name END AS name, CASE p_size % 4 WHEN 1 THEN 'umbrella ' || p_size || ' cm' WHEN 2 THEN 'unknown' ELSE upper(p_type[1]) || lower(p_type[2:]) END AS place FROM part)
       SELECT p_partkey, CASE WHEN name = '' THEN 'missing_name' WHEN place = 'unknown' THEN 'missing_locality' WHEN place LIKE 'umbrella%' THEN 'suspicious_locality' ELSE '' END AS flags,
              CASE WHEN name = '' THEN 0.0 WHEN place LIKE 'umbrella%' THEN 0.4 WHEN place = 'unknown' THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM r"""
)
def part_record_flags(spark, sf_dir):
    """Records without a name, without a place, or with anatomy for one."""
    k = c("p_size") % 4
    p = read_table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, "").otherwise(c("p_name")).alias("validName"), F.lit(None).cast("string").alias("recordedName"), F.when(k == 1, _text_of(["umbrella ", c("p_size").cast("string"), " cm"])).when(k == 2, "unknown").otherwise(F.initcap("p_type")).alias("verbatimLocality"), F.lit(0.9).alias("confidence"))
    return filters.record_flags(p).select("p_partkey", F.array_join("flags", "|").alias("flags"), "confidence")


@query("SELECT p_partkey, 3 AS n, p_name AS first, p_type || ', India' AS hinted, 0.5::DOUBLE + 0.3 + 0.15 + CASE WHEN p_size % 2 = 0 THEN 0.05 ELSE 0 END AS relevance FROM part")
def part_sites(spark, sf_dir):
    """Lists of sites, the country added, and the relevance of a chunk to its species."""
    sites = places.split_sites(F.concat_ws("; ", "p_name", "p_brand", "p_type"))
    chunk = F.concat("p_name", F.when(c("p_size") % 2 == 0, " habitat").otherwise(" seen"))
    return read_table(spark, sf_dir, "part").select("p_partkey", F.size(sites).alias("n"), F.get(sites, F.lit(0)).alias("first"), places.with_country("p_type").alias("hinted"), text.chunk_relevance(chunk, "p_name").alias("relevance"))


# ---------------------------------------------------------------- points of customers

_BOX = lambda box, margin=0: f"(lat BETWEEN {box[0] - margin} AND {box[1] + margin} AND lon BETWEEN {box[2] - margin} AND {box[3] + margin})"


@query(
    f"""WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE ' ' || (c_custkey % 190 - 95) || '.5 ' END AS a, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE ((c_custkey * 7) % 380 - 190)::VARCHAR END AS b, c_custkey % 3 = 0 AS sea FROM customer),
        p AS (SELECT c_custkey, sea, try_cast(trim(a) AS DOUBLE) AS lat, try_cast(nullif(b, '') AS DOUBLE) AS lon FROM s),
        n AS (SELECT *, {_BOX(V.COUNTRY_BOX)} AS home, {" OR ".join(_BOX(b) for b in V.NEIGHBOUR_BOXES.values())} AS near, {_BOX(V.OCEAN_BOX)} AS ocean FROM p),
        r AS (SELECT *, CASE WHEN lat IS NULL OR lon IS NULL THEN NULL WHEN lat NOT BETWEEN -90 AND 90 THEN 'INVALID_RANGE lat' WHEN lon NOT BETWEEN -180 AND 180 THEN 'INVALID_RANGE lon'
                                WHEN NOT home AND NOT sea AND NOT near THEN 'OUTSIDE_COUNTRY_BOX' WHEN NOT home AND NOT sea AND ocean THEN 'POSSIBLE_OCEAN' END AS note FROM n)
        SELECT c_custkey, lat AS told, CASE WHEN note IS NULL AND lon IS NOT NULL THEN lat END AS lat, coalesce(note, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND NOT home AND sea THEN 'MARINE_OFFSHORE_ALLOWED' END) AS note,
               lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0) AS usable FROM r"""
)
def customer_points(spark, sf_dir):
    """Numbers out of texts, held against ranges, boxes and the sea."""
    k = c("c_custkey")
    a = F.when(k % 11 == 0, "x").otherwise(_text_of([" ", (k % 190 - 95).cast("string"), ".5 "]))
    b = F.when(k % 13 == 0, "").otherwise(((k * 7) % 380 - 190).cast("string"))
    p = read_table(spark, sf_dir, "customer").select("c_custkey", coords.to_double(a).alias("told"), coords.to_double(b).alias("lon"), F.when(k % 3 == 0, "coral reef").otherwise("hill").alias("context"))
    held = coords.checked(c("told"), c("lon"), c("context"), F.lit(""))
    return p.select("c_custkey", "told", held["lat"].alias("lat"), held["note"].alias("note"), filters.valid_feedback_point(c("told"), c("lon")).alias("usable"))


# ---------------------------------------------------------------- replies, maps and numbers of events


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 1 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS n, CASE WHEN event_id % 4 < 3 THEN json_extract(props, '$.k')::BIGINT END AS k FROM events"""
)
def event_replies(spark, sf_dir):
    """Records of replies: fenced, after reasoning, unwrapped from an object, or none."""
    k, props = c("event_id") % 4, c("props")
    raw = F.when(k == 0, _text_of(["Sure:\n```json\n[", props, "]\n```"])).when(k == 1, _text_of(["<think>", props, "?</think>[", props, ", ", props, "]"])).when(k == 2, _text_of(['{"records": [', props, "]}"])).otherwise(F.lit("nothing found"))
    e = read_table(spark, sf_dir, "events").select("event_id", jsonfix.json_records(raw).alias("r"))
    return e.select("event_id", F.size("r").alias("n"), F.get_json_object(F.get("r", F.lit(0)), "$.k").cast("long").alias("k"))


@query(
    """SELECT event_id, 'user ' || user_id AS subject, 'FOUND_AT' AS predicate, 'place ' || json_extract(props, '$.k') AS object, (event_id % 10) / 10.0::DOUBLE AS confidence FROM events WHERE event_type IN ('view', 'click') AND event_id % 10 >= 5"""
)
def event_relations(spark, sf_dir):
    """Triples of replies: known predicates, sure enough."""
    row = F.struct(_text_of(["user ", c("user_id").cast("string")]).alias("subject"), F.when(c("event_type").isin("view", "click"), "found_at").otherwise("eats").alias("relation"), _text_of(["place ", F.get_json_object("props", "$.k")]).alias("object"), ((c("event_id") % 10) / 10.0).alias("confidence"))
    raw = read_table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), F.to_json(row), F.lit("]")).alias("raw"))
    return annotate.stated_relations(raw, "raw", "event_id", ["FOUND_AT", "HAS_HABITAT"]).select("event_id", "subject", "predicate", "object", "confidence")


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE event_type END AS kind, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 2 = 0 THEN event_type || '|other' ELSE event_type || '|more|other' END AS tags FROM events"""
)
def event_maps(spark, sf_dir):
    """Maps merged, filled values stay; lists united without regard to case."""
    e = read_table(spark, sf_dir, "events")
    base = F.create_map(F.lit("kind"), F.when(c("event_id") % 3 == 0, " ").otherwise(c("event_type")))
    merged = upserts.deep_merge(base, F.create_map(F.lit("kind"), F.lit("new"), F.lit("k"), F.get_json_object("props", "$.k")))
    more = F.when(c("event_id") % 2 == 0, F.initcap("event_type")).otherwise(F.lit("more"))
    tags = dedup.union_ignoring_case(F.array("event_type", F.upper("event_type")), F.array(more, F.lit("other"), F.lit("OTHER")))
    return e.select("event_id", merged["kind"].alias("kind"), merged["k"].alias("k"), F.array_join(tags, "|").alias("tags"))


@query(
    """WITH p AS (SELECT event_id, value, user_id, (event_id % 101) / 101.0::DOUBLE AS a FROM events)
       SELECT event_id, round(0 - (CASE WHEN a > 0 THEN a * ln(a) ELSE 0 END) - (1 - a) * ln(1 - a), 6) + 0 AS entropy, round(abs(2 * a - 1), 6) AS margin, value * (event_id % 50) / greatest(user_id % 5, 1) AS left_s FROM p"""
)
def event_measures(spark, sf_dir):
    """Entropy and margin of probabilities, and the time left at a mean duration."""
    e = read_table(spark, sf_dir, "events").withColumn("a", (c("event_id") % 101) / 101.0)
    p = F.array(c("a"), 1 - c("a"))
    return e.select("event_id", F.round(retrieval.entropy(p), 6).alias("entropy"), F.round(retrieval.margin(p), 6).alias("margin"), summaries.eta(c("value"), c("event_id") % 50, c("user_id") % 5).alias("left_s"))
