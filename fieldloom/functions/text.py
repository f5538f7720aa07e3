"""Text: segmentation that needs no state, classification and extraction by pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions import vocabulary as V
from fieldloom.functions.names import blank, col


def matches(c: Column | str, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(pattern), group)


def count_of(c: Column | str, pattern: str) -> Column:
    return F.size(matches(c, pattern))


def paragraphs(c: Column | str, least: int = 20) -> Column:
    """Parts between blank lines that are longer than ``least``."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\n\s*\n"), lambda x: F.trim(x)), lambda p: F.length(p) > least)


def sentences(c: Column | str, least: int = 10) -> Column:
    """Parts ending in a stop, question or exclamation mark, longer than ``least``."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), V.SENTENCE_END), lambda x: F.trim(x)), lambda s: F.length(s) > least)


def guarded_sentences(c: Column | str) -> Column:
    """Sentences that do not break after titles and taxonomic abbreviations."""
    guard = "".join(rf"(?<!\b{a}[.])" for a in ("Dr", "Mr", "Ms", "vs", "sp", "cf", "al", "et", "Mrs", "Sr", "Jr", "Fig", "aff", "var", "spp", "Prof", "subsp"))
    parts = F.split(F.trim(F.coalesce(col(c), F.lit(""))), rf"(?<=[.!?]){guard}\s+(?=[A-Z\"'])")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def lines(c: Column | str) -> Column:
    return F.split(F.coalesce(col(c), F.lit("")), "\n")


def windows(c: Column | str, size: int, overlap: int = 0) -> Column:
    """Pieces of ``size`` characters that start every size - overlap; the last may be shorter."""
    text = F.coalesce(col(c), F.lit(""))
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1 - overlap, F.lit(0)), F.lit(size - overlap))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda s: F.substr(text, s + 1, F.lit(size))))


def page_of(position: Column, length: Column, pages: Column) -> Column:
    return F.greatest(F.lit(1), F.round(position / F.greatest(length, F.lit(1)) * pages)).cast("int")


def section_role(heading: Column | str) -> Column:
    text = F.lower(F.coalesce(col(heading), F.lit("")))
    role = F.lit("OTHER")
    for name, words in reversed(V.SECTION_ROLES.items()):
        role = F.when(text.rlike("|".join(words)), name).otherwise(role)
    return role


def layout_role(label: Column | str) -> Column:
    """Role of a layout label; null for those that carry no text of their own."""
    text = F.lower(blank(label))
    return F.when(text.rlike("table"), "TABLES").when(text.rlike("caption|footnote|page"), None).otherwise(section_role(text))


def names_species(c: Column | str) -> Column:
    """Whether a sentence names a species or an unnamed one of a genus."""
    genera = matches(c, V.BINOMIAL, 1)
    return F.exists(genera, lambda g: ~g.isin(*V.NOT_GENERA)) | (count_of(c, V.GENUS_ONLY) > 0)


def binomials(c: Column | str) -> Column:
    """Distinct two-word names in order of appearance."""
    found = matches(c, V.BINOMIAL, 0)
    return F.array_distinct(F.filter(found, lambda n: ~F.element_at(F.split(n, r"\s+"), 1).isin(*V.NOT_GENERA)))


def places_named(c: Column | str, most: int = 20) -> Column:
    found = F.array_distinct(matches(c, V.PLACE, 0))
    return F.slice(F.filter(found, lambda n: ~F.element_at(F.split(n, r"\s+"), 1).isin(*V.NOT_PLACES)), 1, most)


def dates_named(c: Column | str, most: int = 5) -> Column:
    return F.slice(F.array_distinct(matches(c, V.DATE, 0)), 1, most)


def depths_named(c: Column | str, most: int = 5) -> Column:
    return F.slice(F.array_distinct(matches(c, V.DEPTH, 0)), 1, most)


def locality_context(c: Column | str) -> Column:
    return F.struct(places_named(c).alias("localities"), dates_named(c).alias("dates"), depths_named(c).alias("depths"))


def occurrence_type(c: Column | str) -> Column:
    """Primary, Secondary or Uncertain, by which signals are more."""
    first, second = count_of(c, V.PRIMARY_SIGNALS), count_of(c, V.SECONDARY_SIGNALS)
    return F.when(first > second, "Primary").when(second > first, "Secondary").otherwise("Uncertain")


def source_type(c: Column | str) -> Column:
    """Kind of source that a comment tells of; type material is tested before specimens."""
    text = F.lower(blank(c))
    return (
        F.when(text.rlike(r"holotype|paratype|type specimen|type material"), "type_material")
        .when(text.rlike(r"museum|specimen|voucher|herbarium"), "museum_specimen")
        .when(text.rlike(r"reported by|according to|cited|literature|previous"), "secondary_literature")
        .when(text.rlike(r"collected|present study|this study|survey|observed"), "primary_collection")
        .otherwise("unknown")
    )


def type_of_source(c: Column | str) -> Column:
    """Occurrence type that a source type stands for."""
    text = F.lower(blank(c))
    return F.when(text.isin("primary_collection", "type_material", "museum_specimen"), "Primary").when(text == "secondary_literature", "Secondary").otherwise("Uncertain")


def habitat_class(c: Column | str) -> Column:
    """First class whose keyword a habitat text holds; not reported if none."""
    text = F.lower(blank(c))
    return F.coalesce(*[F.when(F.contains(text, F.lit(word)), name) for name, word in V.HABITAT_CLASSES], F.lit("not reported"))


def nomenclatural_status(c: Column | str) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    return F.coalesce(*[F.when(text.rlike(pattern), status) for pattern, status in V.STATUS], F.lit("established"))


def specimen_facts(c: Column | str) -> Column:
    """What patterns tell of a specimen: authority, type, vouchers, collector, type locality, sizes, radula."""
    text = F.coalesce(col(c), F.lit(""))
    some = lambda x: F.when(x != "", x)
    low, high = F.transform(matches(text, V.SIZE_MM, 1), lambda x: x.cast("double")), F.transform(F.filter(matches(text, V.SIZE_MM, 2), lambda x: x != ""), lambda x: x.cast("double"))
    sizes = F.concat(low, high)
    return F.struct(
        some(F.trim(F.regexp_extract(text, V.AUTHORITY, 0))).alias("authority"),
        nomenclatural_status(text).alias("status"),
        some(F.lower(F.regexp_extract(text, V.TYPE_STATUS, 1))).alias("type_status"),
        F.slice(F.array_distinct(matches(text, V.VOUCHER, 0)), 1, 10).alias("vouchers"),
        some(F.trim(F.regexp_extract(text, V.COLLECTOR, 1))).alias("collector"),
        some(F.trim(F.regexp_extract(text, V.TYPE_LOCALITY, 1))).alias("type_locality"),
        F.array_min(sizes).alias("size_min_mm"),
        F.array_max(sizes).alias("size_max_mm"),
        some(F.regexp_replace(F.regexp_extract(text, V.RADULA, 0), r"\s*[×x]\s*", " x ")).alias("radula"),
    )


def chunk_relevance(chunk: Column | str, species: Column | str) -> Column:
    """0.5 for the full name, 0.3 for the epithet, 0.15 for the genus, 0.05 for a section keyword; at most 1."""
    text, name = F.lower(F.coalesce(col(chunk), F.lit(""))), F.lower(blank(species))
    words = F.split(name, r"\s+")
    genus, epithet = F.get(words, F.lit(0)), F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    score = lambda test, w: F.when(test, w).otherwise(0.0)
    total = score(F.contains(text, name) & (name != ""), 0.5) + score((epithet != "") & F.contains(text, epithet), 0.3) + score((genus != "") & F.contains(text, genus), 0.15) + score(text.rlike("diagnosis|description|habitat|distribution|material examined"), 0.05)
    return F.least(total, F.lit(1.0))


def expected_count(c: Column | str) -> Column:
    """The largest number of species from 2 to 4999 that a text states; null if none."""
    found = F.transform(matches(c, V.EXPECTED_COUNT, 1), lambda x: x.cast("int"))
    return F.array_max(F.filter(found, lambda n: (n > 1) & (n < 5000)))


def clean_scan(c: Column | str) -> Column:
    """Scanned text with words joined over line ends, odd blanks and long blank runs mended."""
    text = F.coalesce(col(c), F.lit(""))
    for pattern, instead in ((r"(\w)-\n(\w)", "$1$2"), (r"[ ​﻿]", " "), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, instead)
    return F.trim(text)


def is_scanned(mean_page_chars: Column, least: int = 80) -> Column:
    return mean_page_chars < least


def html_title(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def html_text(c: Column | str) -> Column:
    """Text of a page without scripts, styles and tags."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " "))


def noise_title(c: Column | str) -> Column:
    text = blank(c)
    return (F.length(text) < 10) | text.rlike(r"(?i)^(untitled|microsoft word|document\d*|abstract|introduction|vol(ume)?\b|page \d|https?:|\d+$)")


def trimmed_title(c: Column | str, most: int = 200) -> Column:
    """The title up to ``most`` characters, cut at the end of a sentence or word."""
    text = blank(c)
    head = F.substring(text, 1, most)
    return F.when(F.length(text) <= most, text).otherwise(F.coalesce(F.nullif(F.regexp_extract(head, r"^(.*[.!?])\s", 1), F.lit("")), F.regexp_extract(head, r"^(.*)\s", 1)))


def best_title(*candidates: Column) -> Column:
    """First candidate that is no noise, trimmed; empty if none."""
    return F.coalesce(*[F.when(~noise_title(c), trimmed_title(c)) for c in candidates], F.lit(""))


def first_good_line(c: Column | str) -> Column:
    good = F.filter(F.transform(lines(c), lambda x: F.trim(x)), lambda x: (F.length(x) >= 10) & (F.length(x) <= 300))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def cite_numbers(c: Column | str, index: Column) -> Column:
    """[cite:KEY] marks replaced by the key's number in a map; unknown keys stay."""
    pairs = F.map_entries(index)
    return F.aggregate(pairs, F.coalesce(col(c), F.lit("")), lambda text, p: F.replace(text, F.concat(F.lit("[cite:"), p["key"], F.lit("]")), F.concat(F.lit("["), p["value"].cast("string"), F.lit("]"))))


def author_tokens(c: Column | str) -> Column:
    """Lower-case name parts of two letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(blank(c)), r"[^a-zà-ÿ'\-]+"), lambda w: F.length(w) >= 2))


def authors_named(c: Column | str, most: int = 2000) -> Column:
    """Surnames in a document's head: "X et al.", "X and Y", and "Initials Surname"."""
    head = F.substring(F.coalesce(col(c), F.lit("")), 1, most)
    parts = [matches(head, r"\b([A-Z][a-zà-ÿ'\-]{2,})\s+et\s+al\b", 1), matches(head, r"\b([A-Z][a-zà-ÿ'\-]{2,})\s+(?:and|&)\s+[A-Z]", 1), matches(head, r"\b[A-Z][a-zà-ÿ'\-]{2,}\s+(?:and|&)\s+([A-Z][a-zà-ÿ'\-]{2,})", 1), matches(head, r"\b(?:[A-Z]\.\s*)+([A-Z][a-zà-ÿ'\-]{2,})", 1)]
    return F.array_distinct(F.concat(*parts))
