"""Spans and triples that patterns find in texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import names, text
from fieldloom.functions import vocabulary as V
from fieldloom.functions.names import blank
from fieldloom.operators.segment import flat_map


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, label, start, stop, told: taxa, measurements, dates, life stages, habitats and places, with offsets."""
    stages = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, V.LIFE_STAGES), key=len, reverse=True)) + r")\b", re.I)
    habitats = re.compile("|".join(re.escape(h) for h in sorted({*(h for h, _ in V.HABITAT_CLASSES), "seagrass", "intertidal", "subtidal", "lagoon", "estuary", "reef flat"}, key=len, reverse=True)), re.I)
    kinds = [("TAXON", re.compile(V.BINOMIAL)), ("MEASUREMENT", re.compile(V.MEASURE_SPAN)), ("DATE", re.compile(V.DATE)), ("LIFESTAGE", stages), ("HABITAT", habitats), ("LOCALITY", re.compile(V.PLACE))]
    stage_words = {s.lower() for s in V.LIFE_STAGES}

    def make(doc: str):
        taxa = set()
        for label, pattern in kinds:
            for m in pattern.finditer(doc):
                words = m[0].lower().split()
                if label == "TAXON":
                    if set(words) & stage_words or m[1] in V.NOT_GENERA:
                        continue
                    taxa.add(m.start())
                if label == "LOCALITY" and (m.start() in taxa or words[0] in stage_words or m[0].split()[0] in V.NOT_PLACES):
                    continue
                yield label, m.start(), m.end(), m[0]

    return flat_map(docs, id_col, text_col, make, "label string, start int, stop int, told string")


def annotation_block(span_table: DataFrame, id_col: str = "doc_id", shown: int = 20) -> DataFrame:
    """id, block: per label its distinct texts in order of appearance."""
    first = span_table.groupBy(id_col, "label", "told").agg(F.min("start").alias("start"))
    lists = first.groupBy(id_col, "label").agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("start", "told"))), 1, shown), lambda s: s["told"]), ", ").alias("list"))
    return lists.groupBy(id_col).agg(F.array_join(F.sort_array(F.collect_list(F.concat("label", F.lit(": "), "list"))), "\n").alias("block"))


def name_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 150) -> DataFrame:
    """id, canonical, start, stop, context, occurrence_type: each two-word name where it is first told."""
    pattern = re.compile(V.BINOMIAL)

    def make(doc: str):
        seen = set()
        for m in pattern.finditer(doc):
            name = f"{m[1]} {m[2]}"
            if m[1] not in V.NOT_GENERA and name.lower() not in seen:
                seen.add(name.lower())
                yield name, m.start(), m.end(), doc[max(0, m.start() - reach) : m.end() + reach].strip()

    found = flat_map(docs, id_col, text_col, make, "canonical string, start int, stop int, context string")
    return found.withColumns({"occurrence_type": text.occurrence_type("context"), "source": F.lit("pattern"), "latin": F.round(names.latin_score("canonical"), 6)})


def abbreviated_names(docs: DataFrame, genera: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 150) -> DataFrame:
    """id, canonical, start, stop, context, occurrence_type of "G. epithet", by the document's genera (id, initial, genus)."""
    pattern = re.compile(r"\b([A-Z])\.\s+([a-z]{3,})\b")
    make = lambda doc: ((m[1], m[2], m.start(), m.end(), doc[max(0, m.start() - reach) : m.end() + reach].strip()) for m in pattern.finditer(doc))
    found = flat_map(docs, id_col, text_col, make, "initial string, epithet string, start int, stop int, context string")
    return found.join(genera, [id_col, "initial"]).select(id_col, F.concat_ws(" ", "genus", "epithet").alias("canonical"), "start", "stop", "context", text.occurrence_type("context").alias("occurrence_type"), F.lit("abbreviation").alias("source"), F.lit(None).cast("double").alias("latin"))


def merge_candidates(tables: list[DataFrame], priority: list[str], id_col: str = "doc_id") -> DataFrame:
    """One candidate per document and name: of the best source, then the first told."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    order = F.struct(F.array_position(F.array(*map(F.lit, priority)), F.col("source")).alias("p"), F.col("start"))
    rest = [c for c in rows.columns if c != id_col]
    return rows.groupBy(id_col, F.lower("canonical").alias("__k")).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(id_col, "__r.*")


def extract_names(docs: DataFrame, genera: DataFrame | None = None, reference: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Name candidates in full and abbreviated, merged, with the reference's fields (canonical, unique) where it knows them, by position."""
    full = name_candidates(docs, id_col, text_col)
    known = genera if genera is not None else full.groupBy(id_col, names.genus_initial("canonical").alias("initial")).agg(F.min_by(F.element_at(F.split("canonical", " "), 1), "start").alias("genus"))
    merged = merge_candidates([full, abbreviated_names(docs, known, id_col, text_col)], ["pattern", "abbreviation"], id_col)
    if reference is not None:
        merged = merged.join(reference, "canonical", "left")
    return merged.orderBy(id_col, "start")


def candidate_records(candidates: DataFrame) -> DataFrame:
    """Candidates as records."""
    return candidates.select(F.col("canonical").alias("recordedName"), F.col("canonical").alias("validName"), names.taxon_rank("canonical").alias("taxonRank"), F.col("context").alias("rawTextEvidence"), F.col("occurrence_type").alias("occurrenceType"), F.col("start").alias("char_start"), F.col("source").alias("detection_source"))


def relations(docs: DataFrame, species: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, subject, predicate, object, confidence: what sentences tell of the species they name.

    species: an array of names to look for; a sentence that names none of them
    speaks of the two-word names that it holds.
    """
    rows = docs.select(id_col, F.explode(text.sentences(text_col, 0)).alias("sentence"), (species if species is not None else F.array().cast("array<string>")).alias("__all"))
    named = F.filter("__all", lambda s: F.contains(F.lower(F.col("sentence")), F.lower(s)))
    rows = rows.withColumn("subject", F.explode(F.when(F.size(named) > 0, named).otherwise(text.binomials("sentence"))))
    parts = [rows.select(id_col, "subject", F.lit(p).alias("predicate"), F.explode(text.matches("sentence", pattern, 1)).alias("object"), F.lit(c).alias("confidence")) for p, pattern, c in V.RELATIONS]
    out = reduce(DataFrame.unionByName, parts).withColumn("object", F.regexp_replace(F.trim("object"), r"[.,;]+$", ""))
    return out.where((F.col("object") != "") & (F.col("object") != F.col("subject"))).distinct()


def stated_relations(replies: DataFrame, raw: str, id_col: str, vocabulary: list[str], least: float = 0.5) -> DataFrame:
    """id, subject, predicate, object, evidence, confidence from a model's JSON, of known predicates and sure enough."""
    from fieldloom.functions.jsonfix import json_records

    one = F.from_json("r", "subject string, relation string, object string, evidence string, confidence double")
    rows = replies.select(id_col, F.explode(json_records(raw)).alias("r")).select(id_col, one.alias("t")).select(id_col, "t.subject", F.upper("t.relation").alias("predicate"), "t.object", "t.evidence", "t.confidence")
    return rows.where(F.col("predicate").isin(vocabulary) & (F.coalesce("confidence", F.lit(0.0)) >= least) & (blank("subject") != "") & (blank("object") != ""))


def relation_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed nodes and edges of triples; relations carry the prefix REL_."""
    from fieldloom.functions import keys

    kind = F.when(F.col("predicate") == "FOUND_AT", "Locality").when(F.col("predicate") == "HAS_HABITAT", "Habitat").when(F.col("predicate") == "CO_OCCURS_WITH", "Species").otherwise("Value")
    ends = triples.select(F.explode(F.array(F.struct(F.lit("Species").alias("type"), F.col("subject").alias("label")), F.struct(kind.alias("type"), F.col("object").alias("label")))).alias("n")).select("n.*").distinct()
    nodes = ends.select(keys.node_id(F.col("type"), F.col("label")).alias("id"), "type", "label").dropDuplicates(["id"])
    edges = triples.groupBy(keys.node_id("Species", "subject").alias("src"), F.concat(F.lit("REL_"), "predicate").alias("rel"), keys.node_id(kind, F.col("object")).alias("dst")).agg(F.count(F.lit(1)).alias("weight"), F.max("confidence").alias("confidence"))
    return nodes, edges


def related_values(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per relation the labels that its edges reach, sorted."""
    hits = edges.where(F.col("rel").startswith("REL_")).join(nodes.select(F.col("id").alias("dst"), "label"), "dst")
    return hits.groupBy("rel").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def species_windows(docs: DataFrame, verified: DataFrame, reach: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """verified (id, canonical, start, stop) with the text around each, places in it, and its occurrence type."""
    joined = verified.join(docs.select(id_col, text_col), id_col)
    start = F.greatest(F.col("start") - reach, F.lit(0))
    body = F.substr(F.col(text_col), start + 1, F.col("stop") - start + reach)
    return joined.withColumn("window", body).withColumns({"places": text.places_named("window"), "occurrence_type": text.occurrence_type("window")}).drop(text_col)


def section_updates(section_table: DataFrame, species: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(species, id, n): sections that name a species, and methods and abstracts for all species of the document. species: id, species."""
    joined = section_table.select(id_col, "n", "role", "body").join(species, id_col)
    return joined.where(F.col("role").isin("METHODS", "ABSTRACT") | F.contains(F.lower("body"), F.lower("species"))).select("species", id_col, "n")
