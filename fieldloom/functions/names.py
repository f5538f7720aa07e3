"""Scientific names: keys, classification of strings that are no names, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions import vocabulary as V


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """The trimmed text, empty where null."""
    return F.trim(F.coalesce(col(c).cast("string"), F.lit("")))


def squeeze(c: Column | str) -> Column:
    """Lower case, trimmed, each run of blanks one space."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " ")))


def letters_only(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z]", "")


def strip_chars(c: Column, chars: str) -> Column:
    """c without any of ``chars`` at its ends."""
    return F.btrim(c, F.lit(chars))


def name_key(c: Column | str, strict: bool = False) -> Column:
    """The key by which names are the same.

    Loose keys drop authority, parentheses and open nomenclature; strict ones
    only lower the case.
    """
    text = blank(c)
    if not strict:
        # each pattern is tried only on texts that hold what every match of it holds
        text = F.when(F.lower(text) != text, F.regexp_replace(text, V.AUTHORITY, "")).otherwise(text)
        text = F.when(F.contains(text, F.lit("(")), F.regexp_replace(text, r"\s*\([^)]+\)", "")).otherwise(text)
        text = F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, V.OPEN_NOMENCLATURE, "")).otherwise(text)
        text = F.trim(F.regexp_replace(text, r"\s{2,}", " "))
    return strip_chars(F.lower(text), ".,;- ")


def strip_authority(c: Column | str) -> Column:
    """The name without a closing parenthesis that holds a year."""
    return F.trim(F.regexp_replace(blank(c), V.TRAILING_AUTHORITY, ""))


def clean_open_nomenclature(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(blank(c), V.OPEN_NOMENCLATURE, ""), r"\s{2,}", " "))


def not_a_taxon(c: Column | str) -> Column:
    """"life_stage", "abbreviation", or null for what may be a name.

    Both sides of the comparison are reduced to letters, so hyphenated stages
    are found too.
    """
    stages = sorted({"".join(x for x in s if x.isalpha()) for s in V.LIFE_STAGES})
    text = blank(c)
    stage = letters_only(text).isin(stages) | letters_only(F.element_at(F.split(text, r"\s+"), 1)).isin(stages)
    return F.when(stage, "life_stage").when(text.rlike(V.SHORT_GENUS) | text.rlike(r"^[A-Z]\.\s+\S+$"), "abbreviation")


def genus_initial(c: Column | str) -> Column:
    return F.upper(F.substring(blank(c), 1, 1))


def binomial_case(c: Column | str) -> Column:
    """First word capitalised, all others in lower case."""
    text = F.lower(F.regexp_replace(blank(c), r"\s+", " "))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 20))


def title_type(c: Column | str) -> Column:
    """Primary, Secondary or Uncertain; anything else is Uncertain."""
    text = F.initcap(blank(c))
    return F.when(text.isin("Primary", "Secondary", "Uncertain"), text).otherwise("Uncertain")


def type_rank(c: Column | str) -> Column:
    """0 for the best occurrence type, one more for each worse."""
    text = F.lower(blank(c))
    rank = F.lit(len(V.TYPE_ORDER))
    for i, name in reversed(list(enumerate(V.TYPE_ORDER))):
        rank = F.when(text == name, i).otherwise(rank)
    return rank


def cardinality(c: Column | str) -> Column:
    """0 for no word, 1 for a genus, 2 for more."""
    return F.least(F.size(F.array_remove(F.split(blank(c), r"\s+"), "")), F.lit(2))


def taxon_rank(c: Column | str) -> Column:
    words = F.size(F.array_remove(F.split(clean_open_nomenclature(c), r"\s+"), ""))
    return F.when(words >= 3, "subspecies").when(words == 2, "species").when(words == 1, "genus").otherwise("unranked")


def is_placeholder(c: Column | str) -> Column:
    text = blank(c)
    return text.startswith("__candidate_") & text.rlike(V.PLACEHOLDER)


def usable_name(recorded: Column | str, valid: Column | str) -> Column:
    """Whether a record's names are no placeholder, blank, too short or a piece of JSON."""
    r, v = blank(recorded), blank(valid)
    placeholder = r.rlike(V.ANY_PLACEHOLDER) | v.rlike(V.ANY_PLACEHOLDER)
    short = (F.length(r) < 4) | ((F.length(r) < 8) & r.rlike(V.JSON_START))
    return ~placeholder & ((r != "") | (v != "")) & ~short


def latin_score(c: Column | str) -> Column:
    """Share of a name's distinct letter trigrams that occur in known genera."""
    seeds = sorted({s.lower()[i : i + 3] for s in V.LATIN_SEEDS for i in range(len(s) - 2)})
    text = letters_only(c)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))
    known = F.size(F.array_intersect(grams, F.array(*map(F.lit, seeds))))
    return F.when(F.length(text) < 3, 0.0).otherwise(known / F.size(grams))


def name_confidence(score: Column, status: Column, match: Column, backbone_status: Column, marine: Column, catalogue: Column, serials: Column) -> Column:
    """Weighted agreement of name sources, at most 1, to three places."""
    w = V.NAME_WEIGHTS
    accepted = backbone_status.isin("ACCEPTED", "SYNONYM")
    parts = [
        F.when(marine, w["marine_register"]),
        F.when(status.isin("accepted", "synonym"), F.least(F.lit(w["verifier"]), w["verifier"] * score)),
        F.when((match == "EXACT") & accepted, w["backbone_exact"]).when((match == "FUZZY") & accepted, w["backbone_fuzzy"]),
        F.when(catalogue, w["catalogue"]),
        F.when(serials, w["serials"]),
    ]
    total = F.lit(0.0)
    for part in parts:
        total = total + F.coalesce(part, F.lit(0.0))
    return F.round(F.least(total, F.lit(1.0)), 3)


def rank_of(path: Column, ranks: Column, rank: str) -> Column:
    """The name at ``rank`` of a classification given as two bar-separated lists."""
    names, kinds = F.split(F.coalesce(path, F.lit("")), r"\|"), F.split(F.lower(F.coalesce(ranks, F.lit(""))), r"\|")
    at = F.array_position(kinds, rank).cast("int")
    return F.when(at > 0, F.get(names, at - 1))
