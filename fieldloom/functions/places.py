"""Place names: keys of several strengths, classification, splitting and enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions import vocabulary as V
from fieldloom.functions.names import blank, squeeze


def locality_key(c: Column | str) -> Column:
    """Lower case, punctuation as blanks, dist as district."""
    text = F.regexp_replace(F.lower(blank(c)), r"[,;.]+", " ")
    text = F.trim(F.regexp_replace(text, r"\s{2,}", " "))
    return F.replace(F.replace(text, F.lit(" dist."), F.lit(" district")), F.lit(" dist "), F.lit(" district "))


def normal_place(c: Column | str) -> Column:
    """Lower case without accents, parentheses and administrative endings."""
    text = F.translate(F.lower(blank(c)), V.ACCENTED, V.PLAIN)
    text = F.regexp_replace(F.regexp_replace(text, r"[̀-ͯ]", ""), r"\(.*?\)", "")
    for ending, instead in V.PLACE_SUFFIXES:
        text = F.replace(text, F.lit(ending), F.lit(instead))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def canonical_place(c: Column | str) -> Column:
    """A key on which common spellings of one place meet: vowel length, aspiration, v/w/b, doubled letters."""
    text = normal_place(c)
    for old, new in (*V.LONG_VOWELS, *V.ASPIRATES, *V.INTERCHANGEABLE):
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(text, "(?<=[aeiou])h", "")
    return F.replace(F.regexp_replace(text, r"(.)\1+", "$1"), F.lit(" "), F.lit(""))


def phonetic_place(c: Column | str) -> Column:
    """A sound key of the canonical form."""
    text = canonical_place(c)
    return F.when(text == "", "").otherwise(F.soundex(text))


def sorted_tokens(c: Column | str) -> Column:
    return F.array_join(F.array_sort(F.array_remove(F.split(squeeze(c), " "), "")), " ")


def core_place(c: Column | str) -> Column:
    """The place without a leading preposition and administrative words."""
    text = F.regexp_replace(F.regexp_replace(blank(c), V.RELATIVE_PREFIX, ""), V.ADMIN_NOISE, "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def with_country(c: Column | str, country: str = "India") -> Column:
    """The place, followed by the country unless it tells it already."""
    text = blank(c)
    return F.when(text.rlike(V.COUNTRY_SIGNALS), text).otherwise(F.concat(F.rtrim(F.regexp_replace(text, r",+$", "")), F.lit(f", {country}")))


def has_proper_noun(c: Column | str) -> Column:
    """Whether a word after the first is capitalised and no common geographic word."""
    words = F.transform(F.split(blank(c), r"\s+"), lambda w: F.regexp_replace(w, "[^a-zA-Z]", ""))
    return F.exists(F.slice(words, 2, 1000), lambda w: w.rlike("^[A-Z]") & ~F.lower(w).isin(*V.NOT_PROPER))


def place_class(c: Column | str) -> Column:
    """"morphology", "habitat", "habitat_with_place", or null for what looks geographic.

    Anatomical terms count as whole words only, so that they do not hit inside a
    place's name.
    """
    text = blank(c)
    terms = "|".join(t.replace(" ", r"\s+") for t in V.MORPHOLOGY_TERMS)
    words = F.array_remove(F.transform(F.split(text, r"\s+"), lambda w: F.lower(F.regexp_replace(w, "[^a-zA-Z]", ""))), "")
    habitat_words = F.array(*map(F.lit, V.HABITAT_WORDS))
    return (
        F.when(F.lower(text).isin(*V.NO_LOCALITY), None)
        .when(text.rlike(V.MEASUREMENT) | text.rlike(rf"(?i)\b(?:{terms})\b") & ~text.rlike(r"(?i)\bbell\b\s+bay"), "morphology")
        .when(text.rlike(V.HABITAT_LEAD), F.when(has_proper_noun(text), "habitat_with_place").otherwise("habitat"))
        .when((F.size(words) > 0) & F.forall(words, lambda w: F.array_contains(habitat_words, w)), "habitat")
    )


def rescued_place(c: Column | str) -> Column:
    """The capitalised name after a preposition, of three letters or more; else null."""
    found = F.rtrim(F.regexp_replace(F.trim(F.regexp_extract(blank(c), r"\b(?:at|near|in|off|from)\s+([A-Z][a-zA-Z\s,]+?)(?:\s*[,;.]|$)", 1)), r"[,;.]+$", ""))
    return F.when(F.length(found) >= 3, found)


def split_sites(c: Column | str) -> Column:
    """The sites of a list such as "A, B, C"; one element where it tells a hierarchy or has parentheses."""
    text = blank(c)
    parts = F.filter(F.transform(F.split(text, r"[;,]\s*"), lambda x: F.trim(x)), lambda p: p != "")
    has_word = lambda p: reduce(lambda a, b: a | b, (F.contains(F.lower(p), F.lit(w)) for w in V.HIERARCHY_WORDS))
    hits = F.size(F.filter(parts, has_word))
    single = text.rlike(r"[()]") | (F.size(parts) <= 1) | (hits >= F.floor(F.size(parts) / 2))
    return F.when(single, F.array(text)).otherwise(parts)


def split_compound(c: Column | str) -> Column:
    """Parts joined by commas, semicolons, slashes or "and", and what stands in parentheses; station ids stay whole."""
    text = blank(c)
    inner = F.transform(F.regexp_extract_all(text, F.lit(r"\(([^)]+)\)"), 1), lambda p: F.trim(F.regexp_replace(p, r"(?i)^(?:near|off|at)\s+", "")))
    outer = F.split(F.regexp_replace(text, r"\([^)]*\)", " "), r"\s*(?:[,;/]|\band\b|&)\s*")
    parts = F.array_distinct(F.filter(F.transform(F.concat(outer, inner), lambda x: F.trim(x)), lambda p: F.length(p) >= 3))
    station = text.rlike(r"(?i)^(?:st(?:ation|n)?|site)\.?\s*[A-Z0-9]+$")
    return F.when(station | (F.size(parts) == 0), F.array(text)).otherwise(parts)


def state_box(c: Column | str) -> Column:
    """struct(name, a, b, c, d): the first state, in the table's order, that the text names, and its box; else null."""
    text = F.lower(blank(c))
    boxes = F.array(*[F.struct(F.lit(s).alias("name"), *[F.lit(x).alias(n) for n, x in zip("abcd", box, strict=True)]) for s, box in V.STATE_BOXES.items()])
    return F.get(F.filter(boxes, lambda s: F.contains(text, s["name"])), F.lit(0))


def state_in(c: Column | str) -> Column:
    """The name of state_box."""
    return state_box(c)["name"]


def enriched_place(place: Column, district: Column, state: Column) -> Column:
    """"place, X District, State", leaving out what is blank."""
    some = lambda x, y: F.when(blank(x) != "", y)
    return F.concat_ws(", ", place, some(district, F.concat(district, F.lit(" District"))), some(state, state))


def source_tag(kind: Column, score: Column) -> Column:
    return F.when(kind.isNotNull(), F.concat(F.lit("IN_Pincode_"), kind, F.lit("_"), F.round(score).cast("int"))).otherwise("")


def is_regional(key: Column) -> Column:
    """Whether a locality key names a region or nothing."""
    return (key == "") | key.isin(*V.REGIONAL_PLACES)


