"""Canonical record layouts, and the alias map that is applied once, at ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLING = "struct<date:string,depth_m:string,method:string>"

#: Column of the canonical record to the names under which inputs may bring it, best first.
ALIASES: dict[str, tuple[str, ...]] = {
    "recordedName": ("recordedName", "Recorded Name", "recorded_name"),
    "validName": ("validName", "Valid Name", "valid_name", "scientificName"),
    "phylum": ("phylum", "Phylum"),
    "class_": ("class_", "class", "Class"),
    "order_": ("order_", "order", "Order"),
    "family_": ("family_", "family", "Family"),
    "verbatimLocality": ("verbatimLocality", "Verbatim Locality", "locality"),
    "habitat": ("habitat", "Habitat"),
    "occurrenceType": ("occurrenceType", "occurrence_type", "Occurrence Type"),
    "rawTextEvidence": ("rawTextEvidence", "Raw Text Evidence"),
    "sourceCitation": ("sourceCitation", "Source Citation"),
    "samplingEvent": ("samplingEvent", "Sampling Event"),
    "decimalLatitude": ("decimalLatitude", "latitude", "lat"),
    "decimalLongitude": ("decimalLongitude", "longitude", "lon"),
    "geocodingSource": ("geocodingSource", "geocoding_src"),
    "validationStatus": ("validationStatus",),
    "wormsID": ("wormsID", "worms_id"),
    "taxonRank": ("taxonRank", "taxon_rank"),
    "taxonomicStatus": ("taxonomicStatus", "taxonomic_status"),
    "matchScore": ("matchScore",),
}
#: Longest text that a column keeps.
CAPS = {"recordedName": 300, "validName": 300, "verbatimLocality": 500, "rawTextEvidence": 1000, "sourceCitation": 500, "habitat": 300}
NUMBERS = ("decimalLatitude", "decimalLongitude", "matchScore")


def first_present(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first non-blank of the columns that df has; null if it has none of them."""
    present = [F.col(f"`{n}`") for n in names if n in df.columns]
    text = [F.nullif(F.trim(c.cast("string")), F.lit("")) for c in present]
    return F.coalesce(*text) if text else F.lit(None).cast("string")


def canonical(df: DataFrame) -> DataFrame:
    """df in canonical columns: aliases resolved, texts trimmed and capped, numbers cast; other columns are kept."""
    known = {a for names in ALIASES.values() for a in names}
    out = []
    for name, names in ALIASES.items():
        c = first_present(df, names)
        if name in NUMBERS:
            c = c.try_cast("double")
        elif name in CAPS:
            c = F.substring(c, 1, CAPS[name])
        out.append(c.alias(name))
    return df.select(*out, *[F.col(f"`{c}`") for c in df.columns if c not in known])


def fit_to(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The given columns (name to type) of df, nulls where df lacks one."""
    return df.select(*[(F.col(f"`{n}`") if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in columns.items()])


def resolve(columns: list[str], wanted: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """For each wanted name the first column whose squashed name fits one of its candidates."""
    squash = lambda s: "".join(ch for ch in s.lower().lstrip("﻿") if ch.isalnum())
    by_name = {squash(c): c for c in columns}
    return {w: next(by_name[squash(x)] for x in names if squash(x) in by_name) for w, names in wanted.items() if any(squash(x) in by_name for x in names)}
