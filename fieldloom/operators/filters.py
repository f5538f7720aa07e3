"""Filters and guards. Those that reject rows return (kept, rejected)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import coords, names, places, text
from fieldloom.functions import vocabulary as V
from fieldloom.functions.names import blank


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet a condition, and those that do not (null counts as not)."""
    met = F.coalesce(condition, F.lit(False))
    return df.where(met), df.where(~met)


def usable_names(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_by(df, names.usable_name("recordedName", "validName"))


def genus_context(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document and initial letter the genus that is named first in full."""
    found = docs.select(id_col, F.posexplode(text.matches(text_col, r"\b([A-Z][a-z]{2,})\s+[a-z]{2,}", 1)).alias("at", "genus"))
    return found.groupBy(id_col, F.substring("genus", 1, 1).alias("initial")).agg(F.min_by("genus", "at").alias("genus"))


def guard_life_stages(df: DataFrame, context: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Authority removed, abbreviated genera spelled out by their document's context.

    Life stages and abbreviations that the context does not tell are rejected;
    rejected rows carry the reason.
    """
    name = names.strip_authority(F.coalesce(F.nullif(blank("recordedName"), F.lit("")), "validName"))
    marked = df.withColumn("__name", name).withColumn("reason", names.not_a_taxon("__name")).withColumn("initial", F.when(F.col("reason") == "abbreviation", F.substring("__name", 1, 1)))
    joined = marked.join(context.select(id_col, "initial", "genus"), [id_col, "initial"], "left")
    epithet = F.regexp_extract("__name", r"^[A-Z]\.\s+(.+)$", 1)
    full = F.when((F.col("reason") == "abbreviation") & F.col("genus").isNotNull() & (epithet != ""), F.concat_ws(" ", "genus", epithet))
    out = joined.withColumn("recordedName", F.coalesce(full, "__name")).withColumn("reason", F.when(full.isNull(), F.col("reason")))
    return out.where("reason IS NULL").select(*df.columns), out.where("reason IS NOT NULL").select(*df.columns, "reason")


def guard_localities(df: DataFrame) -> DataFrame:
    """Localities that describe anatomy or habitat replaced, in new columns beside the old.

    ``locality_class`` tells what the locality was; ``verbatimLocality`` is the
    place that a habitat phrase names, or Not Reported; a habitat phrase fills a
    blank ``habitat``; ``locality_was`` keeps anatomical text for audit.
    """
    kind, rescued = places.place_class("verbatimLocality"), places.rescued_place("verbatimLocality")
    habitat = kind.isin("habitat", "habitat_with_place")
    empty = F.lower(blank("habitat")).isin("", "not reported")
    return df.withColumns(
        {
            "locality_class": kind,
            "locality_was": F.when(kind == "morphology", F.col("verbatimLocality")),
            "habitat": F.when(habitat & empty, F.col("verbatimLocality")).otherwise(F.col("habitat")),
            "verbatimLocality": F.when(kind == "morphology", "Not Reported").when(habitat, F.coalesce(rescued, F.lit("Not Reported"))).otherwise(F.col("verbatimLocality")),
        }
    )


def check_coordinates(df: DataFrame) -> DataFrame:
    """df with coordinates read from text, those that do not hold removed, and the reason in coordinate_note."""
    lat = F.coalesce(coords.to_double("decimalLatitude"), coords.parse_degrees("decimalLatitude"))
    lon = F.coalesce(coords.to_double("decimalLongitude"), coords.parse_degrees("decimalLongitude"))
    told = F.concat_ws(" ", *[F.col(c) for c in ("habitat", "verbatimLocality", "rawTextEvidence") if c in df.columns])
    read = df.withColumns({"__lat": lat, "__lon": lon, "__told": told})
    out = coords.checked(F.col("__lat"), F.col("__lon"), F.col("__told"), F.col("__told"))
    return read.withColumn("__c", out).withColumns({"decimalLatitude": F.col("__c.lat"), "decimalLongitude": F.col("__c.lon"), "coordinate_note": F.col("__c.note")}).drop("__c", "__lat", "__lon", "__told")


def check_by_code(df: DataFrame, boxes: DataFrame, text_col: str = "verbatimLocality") -> DataFrame:
    """Coordinates held against the box of the postal code in a text: filled from its centre, or removed outside it.

    boxes: code, lat_min, lat_max, lon_min, lon_max, one row per code.
    """
    code = F.regexp_extract(blank(text_col), r"\b([1-9]\d{5})\b", 1)
    joined = df.withColumn("__code", F.nullif(code, F.lit(""))).join(boxes.withColumnRenamed("code", "__code"), "__code", "left")
    lat, lon = F.col("decimalLatitude"), F.col("decimalLongitude")
    known, missing = F.col("lat_min").isNotNull(), lat.isNull() | lon.isNull()
    inside = lat.between(F.col("lat_min"), F.col("lat_max")) & lon.between(F.col("lon_min"), F.col("lon_max"))
    out = lambda v, a, b: F.when(known & missing, (F.col(a) + F.col(b)) / 2).when(known & ~inside, None).otherwise(v)
    return joined.withColumns({"decimalLatitude": out(lat, "lat_min", "lat_max"), "decimalLongitude": out(lon, "lon_min", "lon_max"), "coordinate_note": F.when(known & missing, "FROM_CODE").when(known & ~inside, "OUTSIDE_CODE_BOX")}).select(*df.columns, "coordinate_note")


def valid_feedback_point(lat: Column, lon: Column) -> Column:
    """In range, and not the null island."""
    return lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


def skip_silent_chunks(chunks: DataFrame, doc: str, has_signal: Column, least: int = 10) -> DataFrame:
    """Chunks without a signal left out of documents of more than ``least`` chunks."""
    counts = chunks.groupBy(doc).agg(F.count(F.lit(1)).alias("__n"))
    return chunks.join(counts, doc).where((F.col("__n") <= least) | has_signal).drop("__n")


def primary_only(df: DataFrame) -> DataFrame:
    return df.where(F.lower(blank("occurrenceType")) == "primary")


def approve(df: DataFrame, reference: DataFrame, least: float = 0.8) -> DataFrame:
    """df with the reference's match and whether it approves: confident enough, or with an authoritative id.

    reference: name (unique), match_confidence.
    """
    joined = df.join(reference.withColumnRenamed("name", "__name"), F.lower(blank("validName")) == F.lower(F.col("__name")), "left").drop("__name")
    return joined.withColumn("approved", (F.coalesce("match_confidence", F.lit(0.0)) >= least) | (blank("wormsID") != ""))


def all_of(selections: dict[str, list]) -> Column:
    """Each column among its selected values; a column without a selection does not limit."""
    return reduce(lambda a, b: a & b, (F.col(c).isin(*v) for c, v in selections.items() if v), F.lit(True))


def select_taxa(df: DataFrame, selections: dict[str, list]) -> DataFrame:
    return df.where(all_of(selections))


def select_related(df: DataFrame, selections: dict[str, list[str]], values: dict[str, str]) -> DataFrame:
    """Rows whose arrays (predicate to column in ``values``) hold a selected text, for every predicate with a selection."""
    hit = lambda c, wanted: F.exists(F.col(c), lambda v: reduce(lambda a, b: a | b, (F.contains(F.lower(v), F.lit(w.lower())) for w in wanted)))
    return df.where(reduce(lambda a, b: a & b, (hit(values[p], w) for p, w in selections.items() if w), F.lit(True)))


def search_text(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows in which a column holds the query, letter case aside."""
    return df.where(reduce(lambda a, b: a | b, (F.contains(F.lower(blank(c)), F.lit(query.lower())) for c in columns)))


def not_rejected(status: Column | str) -> Column:
    """Null means pending and is not rejected; reject and rejected are the same."""
    return ~F.lower(blank(status)).isin("reject", "rejected")


def missing_coordinates(df: DataFrame) -> DataFrame:
    """Rows to be located: no coordinate pair (zero is a coordinate), a locality, and not rejected."""
    place = F.lower(blank("verbatimLocality"))
    status = not_rejected("validationStatus") if "validationStatus" in df.columns else F.lit(True)
    return df.where((F.col("decimalLatitude").isNull() | F.col("decimalLongitude").isNull()) & ~place.isin(*V.NO_LOCALITY) & status)


def boost_known(df: DataFrame, known: DataFrame, name: str, confidence: str, boost: float = 0.05) -> DataFrame:
    """Confidence raised, to 1 at most, for names of the known list (one column, ``name``)."""
    flags = known.select(F.lower(blank(known.columns[0])).alias("__known")).distinct()
    joined = df.join(flags, F.lower(blank(name)) == F.col("__known"), "left")
    return joined.withColumn(confidence, F.when(F.col("__known").isNotNull(), F.least(F.col(confidence) + boost, F.lit(1.0))).otherwise(F.col(confidence))).select(*df.columns)


def outside_spans(df: DataFrame, spans: DataFrame, doc: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """Rows of a document that lie in none of its spans (doc, start, stop)."""
    s = spans.select(F.col(doc).alias("__doc"), F.col("start").alias("__a"), F.col("stop").alias("__b"))
    inside = (F.col(doc) == F.col("__doc")) & (F.col(start) >= F.col("__a")) & (F.col(stop) <= F.col("__b"))
    return df.join(s, inside, "left_anti")


def without_authors(df: DataFrame, place: str, authors: Column) -> DataFrame:
    """Places none of whose words is an author's name (an array of lower-case names)."""
    words = F.split(F.lower(blank(place)), r"[^a-zà-ÿ'\-]+")
    return df.where(F.size(F.array_intersect(words, F.coalesce(authors, F.array().cast("array<string>")))) == 0)


def uncertain(df: DataFrame, threshold: float, confidence: str = "confidence", label: str = "label") -> DataFrame:
    """Unlabelled rows below a confidence, least first."""
    return df.where((F.col(confidence) < threshold) & F.col(label).isNull()).orderBy(confidence)


def pending_chunks(df: DataFrame) -> DataFrame:
    """Chunks that are approved and not yet used."""
    return df.where(F.col("approved") & ~F.coalesce("processed", F.lit(False)))


def record_flags(df: DataFrame) -> DataFrame:
    """df with validation flags and a confidence capped by them."""
    name, place = blank(F.coalesce("validName", "recordedName")), F.lower(blank("verbatimLocality"))
    odd = places.place_class("verbatimLocality").isNotNull()
    flags = F.array_compact(F.array(F.when(odd, "suspicious_locality"), F.when(name == "", "missing_name"), F.when(place.isin(*V.NO_LOCALITY), "missing_locality")))
    cap = F.when(name == "", 0.0).when(odd, 0.4).when(place.isin(*V.NO_LOCALITY), 0.5).otherwise(1.0)
    return df.withColumn("flags", flags).withColumn("confidence", F.least(F.coalesce("confidence", F.lit(1.0)) if "confidence" in df.columns else F.lit(1.0), cap))


def budget_prefix(df: DataFrame, group: list[str], order: list, size: Column, most: int) -> DataFrame:
    """The first rows of each group, as long as those before them take less than ``most``."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__before", before).where(F.col("__before") < most).drop("__before")
