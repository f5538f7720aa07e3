"""Whole flows: from texts to records, and from records to derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import keys, text
from fieldloom.operators import annotate, articles, dedup, filters, graph, lookup, reconcile, segment, summaries
from fieldloom.operators.tables import without_tables


def records_from_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rule-based records of documents: names with context, nearest place, date and type, by position.

    Tables are told as sentences first, names of a document's authors are no
    places, and life stages are no names.
    """
    clean = docs.withColumn(text_col, without_tables(text_col))
    names = annotate.extract_names(clean, None, None, id_col, text_col)
    authors = clean.select(id_col, F.transform(text.authors_named(text_col), F.lower).alias("__authors"))
    rows = names.join(authors, id_col).withColumns({"places": text.places_named("context"), "dates": text.dates_named("context")})
    local = F.filter("places", lambda p: ~F.contains(F.lower(F.col("canonical")), F.lower(p)) & (F.size(F.array_intersect(F.split(F.lower(p), " "), F.col("__authors"))) == 0) & ~F.contains(F.col("canonical"), F.element_at(F.split(p, " "), 1)))
    out = rows.select(
        id_col,
        F.col("start").alias("seq"),
        F.col("canonical").alias("recordedName"),
        F.col("canonical").alias("validName"),
        F.get(local, F.lit(0)).alias("verbatimLocality"),
        F.lit(None).cast("string").alias("habitat"),
        F.col("occurrence_type").alias("occurrenceType"),
        F.col("context").alias("rawTextEvidence"),
        F.lit(None).cast("string").alias("sourceCitation"),
        F.get("dates", F.lit(0)).alias("date"),
    )
    context = filters.genus_context(clean, id_col, text_col)
    kept, _ = filters.guard_life_stages(out, context, id_col)
    return filters.guard_localities(kept)


def curate(records: DataFrame, citation: Column, seq: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records without unusable names, deduplicated in three stages, reconciled; and the summary."""
    usable, _ = filters.usable_names(records)
    once = dedup.suppress_regional(dedup.dedup_records(usable, seq))
    return reconcile.postprocess(once, citation)


def enrich(records: DataFrame, taxa: DataFrame, places: list[tuple[str, DataFrame]], fields: list[str]) -> DataFrame:
    """Taxonomy from a reference, coordinates from a cascade of place tables, then validation."""
    verified = lookup.verify_records(records, taxa, fields)
    return filters.check_coordinates(lookup.locate_cascade(verified, places))


def derive(records: DataFrame, seq: str) -> dict[str, DataFrame]:
    """Graph, articles, boxes and atoms of records, as lazily built tables."""
    atoms = records.withColumn("atom_id", keys.atom_id(dedup.record_name(), "verbatimLocality", "sourceCitation"))
    return {
        "nodes": graph.nodes(records),
        "edges": graph.edges(records),
        "species": articles.lead_sentence(articles.species_articles(records, seq)),
        "localities": articles.locality_articles(records, seq),
        "boxes": summaries.bounding_boxes(records, ["validName"], "decimalLatitude", "decimalLongitude"),
        "atoms": atoms.groupBy("atom_id").agg(F.count(F.lit(1)).alias("times_confirmed"), F.first("validName").alias("valid_name")),
    }


def contexts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4000) -> DataFrame:
    """Chunks of documents with their study context before them and whether they name a species."""
    parts = segment.chunk_documents(docs, id_col, text_col, most)
    told = segment.study_context(segment.sections(docs, id_col, text_col), id_col)
    return segment.with_context(parts, told, id_col).withColumn("has_species", text.names_species("body"))


def answer_context(nodes: DataFrame, edges: DataFrame, question: str, k: int = 10) -> DataFrame:
    """Neighbourhoods of the nodes that a question names, as text."""
    return graph.context_lines(graph.neighbours(edges, nodes, graph.seeds_for(nodes, edges, question), k))


def retry_until_complete(extract, docs: DataFrame, expected: Column, rounds: int = 2, threshold: float = 0.95) -> DataFrame:
    """extract(docs, round) repeated, adding what is newly found, until enough of the stated species are there."""
    found, stated = extract(docs, 0), docs.agg(F.max(expected)).first()[0]
    for i in range(1, rounds + 1):
        if reconcile.completeness(found, F.lit(stated), threshold).first()["complete"]:
            break
        found = found.unionByName(reconcile.newly_found(extract(docs, i), found), allowMissingColumns=True)
    return found
