"""Deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.names import blank, col


def slug(c: Column | str, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.lower(blank(c)), "[^a-z0-9_]", "_"), 1, most)


def prefix(kind: str) -> str:
    """What the ids of a kind's nodes begin with."""
    return f"{kind.lower()}::"


def node_id(kind: Column | str, label: Column | str) -> Column:
    return F.concat(F.lower(F.lit(kind) if isinstance(kind, str) else kind), F.lit("::"), slug(label))


def atom_id(species: Column | str, locality: Column | str, source: Column | str) -> Column:
    """16 hex digits that stand for a species at a locality by a source."""
    parts = F.concat_ws("|", F.lower(blank(species)), F.lower(blank(locality)), F.substring(F.lower(blank(source)), 1, 80))
    return F.substring(F.sha1(parts), 1, 16)


def document_hash(c: Column | str) -> Column:
    """16 hex digits of a text."""
    return F.substring(F.sha1(F.coalesce(col(c), F.lit(""))), 1, 16)


def record_key(name: Column | str, locality: Column | str, date: Column | str) -> Column:
    """Name, the first 60 letters of the locality, and year and month."""
    return F.concat_ws("|", F.lower(blank(name)), F.substring(F.lower(blank(locality)), 1, 60), F.substring(blank(date), 1, 7))


def vote_key(name: Column | str, locality: Column | str) -> Column:
    """Name and the first 12 letters of the locality without stop words."""
    place = F.trim(F.regexp_replace(F.regexp_replace(F.lower(blank(locality)), r"\b(?:the|of|at|near|in|off|from)\b", ""), r"\s+", " "))
    return F.concat(F.lower(blank(name)), F.lit("::"), F.substring(place, 1, 12))
