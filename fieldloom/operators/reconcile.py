"""Occurrence types set right by the citation and the evidence, and localities made findable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import citations, places, text
from fieldloom.functions import vocabulary as V
from fieldloom.functions.names import blank
from fieldloom.operators.dedup import record_name


def reconcile_types(df: DataFrame, citation: Column) -> DataFrame:
    """df with Primary turned to Secondary where a rule says so, and the rule in ``rule``.

    citation_mismatch: the record cites another author than its document.
    historical: the evidence reports what another author found.
    older_year: the evidence tells of a year more than one before the document's.
    """
    author, year = citations.first_author(citation), citations.cited_year(citation).try_cast("int")
    cited = citations.first_author("sourceCitation")
    evidence = blank("rawTextEvidence")
    reported = F.regexp_extract(evidence, V.HISTORICAL, 1)
    years = F.transform(text.matches(evidence, V.EVIDENCE_YEAR, 1), lambda y: y.cast("int"))
    rule = (
        F.when(blank("occurrenceType") != "Primary", None)
        .when((cited != "") & (author != "") & (F.lower(cited) != F.lower(author)), "citation_mismatch")
        .when((reported != "") & (author != "") & (F.lower(reported) != F.lower(author)), "historical")
        .when(year.isNotNull() & F.exists(years, lambda y: y < year - 1), "older_year")
    )
    return df.withColumn("rule", rule).withColumn("occurrenceType", F.when(F.col("rule").isNotNull(), "Secondary").otherwise(F.col("occurrenceType")))


def change_log(reconciled: DataFrame) -> DataFrame:
    """What reconcile_types changed."""
    return reconciled.where("rule IS NOT NULL").select(record_name().alias("species"), "rule", F.lit("Primary").alias("was"), F.lit("Secondary").alias("now"))


def enhance_localities(df: DataFrame, citation: Column) -> DataFrame:
    """df with ``enhanced_locality``: the core place, followed by the citation's study area where it is short.

    Null where nothing is reported or coordinates are known.
    """
    area, core = citations.study_area(citation), places.core_place("verbatimLocality")
    known = F.col("decimalLatitude").isNotNull() & F.col("decimalLongitude").isNotNull()
    short = (F.length(core) < 12) & (area != "") & ~F.contains(F.lower(blank("verbatimLocality")), F.lower(area))
    none = F.lower(blank("verbatimLocality")).isin("", "not reported", "unknown")
    return df.withColumn("enhanced_locality", F.when(none | known, None).when(short, F.concat_ws(", ", core, area)).otherwise(core))


def fill_citation(df: DataFrame, citation: Column) -> DataFrame:
    """The document's citation where a record's looks like a file name or is too short."""
    return df.withColumn("sourceCitation", F.when(citations.looks_like_file("sourceCitation"), citation).otherwise(F.col("sourceCitation")))


def postprocess(df: DataFrame, citation: Column) -> tuple[DataFrame, DataFrame]:
    """Reconciled and enhanced records, and a one-row summary."""
    out = enhance_localities(reconcile_types(df, citation), citation)
    summary = out.agg(F.count(F.lit(1)).alias("records"), F.count("rule").alias("changed"), F.count_if(F.col("decimalLatitude").isNotNull() & F.col("decimalLongitude").isNotNull()).alias("located"), F.count("enhanced_locality").alias("enhanced"))
    return out, summary


def completeness(found: DataFrame, expected: Column, threshold: float = 0.95) -> DataFrame:
    """Share of the stated number of species that were found, and whether that is enough."""
    return found.agg(F.count_distinct(F.lower(record_name())).alias("n_found"), F.max(expected).alias("n_stated")).withColumn("share", F.when(F.col("n_stated") > 0, F.col("n_found") / F.col("n_stated"))).withColumn("complete", F.coalesce(F.col("share") >= threshold, F.lit(True)))


def newly_found(new: DataFrame, old: DataFrame) -> DataFrame:
    """Records of new whose name old does not have."""
    return new.withColumn("__n", F.lower(record_name())).join(old.select(F.lower(record_name()).alias("__n")).distinct(), "__n", "left_anti").drop("__n")
