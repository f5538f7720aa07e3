"""Removing repeated records, merging votes, and finding contradictions.

Winners are chosen with min_by and max_by, which aggregate map-side, so a key
that holds a large share of the rows costs its own partial results only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from fieldloom.functions import keys, names, places
from fieldloom.functions.names import blank


def record_name() -> Column:
    """The name a record goes by: the valid one, else the recorded one."""
    return F.coalesce(F.nullif(blank("validName"), F.lit("")), F.nullif(blank("recordedName"), F.lit("")))


def best_per_key(df: DataFrame, key: list[Column], order: Column, wins: str = "min") -> DataFrame:
    """One whole row per key: the one of least (or greatest) order."""
    pick = F.min_by if wins == "min" else F.max_by
    parts = [k.alias(f"__k{i}") for i, k in enumerate(key)]
    return df.groupBy(*parts).agg(pick(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("__row")).select("__row.*")


def dedup_records(df: DataFrame, seq: list[str], evidence: Column | None = None) -> DataFrame:
    """Of records of one name and locality the one of best type, then longest evidence, then first by ``seq``.

    Records without a usable name are left out.
    """
    name = record_name()
    length = evidence if evidence is not None else F.length(F.coalesce(F.col("rawTextEvidence"), F.lit("")))
    named = df.where(name.isNotNull() & ~names.is_placeholder(name))
    key = [names.name_key(name), places.locality_key("verbatimLocality")]
    rest = [c for c in df.columns if c not in seq]
    if len(set(seq)) < len(seq) or any(_unordered(df.schema[c].dataType) for c in rest):
        return best_per_key(named, key, F.struct(names.type_rank("occurrenceType").alias("t"), (-length).alias("e"), *[F.col(c) for c in seq]))
    # one struct is order and row, so that what orders is not sent a second time; rows that tie go by the rest
    row = F.struct(names.type_rank("occurrenceType").alias("__t"), (-length).alias("__e"), *[F.col(c) for c in seq], *[F.col(f"`{c}`") for c in rest])
    best = named.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(key)]).agg(F.min(row).alias("__row"))
    return best.select(*[F.col("__row")[c].alias(c) for c in df.columns])


def _unordered(kind: DataType) -> bool:
    """Whether values of a type cannot be put in order: maps and variants, also within others."""
    if isinstance(kind, StructType):
        return any(_unordered(f.dataType) for f in kind.fields)
    return _unordered(kind.elementType) if isinstance(kind, ArrayType) else isinstance(kind, (MapType, VariantType))


def suppress_regional(df: DataFrame, strict: bool = False) -> DataFrame:
    """df without records at a region or nowhere whose species also has a record at a place."""
    name = names.name_key(record_name(), strict)
    marked = df.withColumn("__name", name).withColumn("__regional", places.is_regional(places.locality_key("verbatimLocality")))
    placed = marked.where(~F.col("__regional") & (F.col("__name") != "")).select("__name").distinct().withColumn("__placed", F.lit(True))
    joined = marked.join(placed, "__name", "left")
    return joined.where(~(F.col("__regional") & F.coalesce("__placed", F.lit(False)))).select(*df.columns)


def first_of_key(df: DataFrame, key: list[Column], seq: list[str]) -> DataFrame:
    """The first record of each key, by ``seq``."""
    return best_per_key(df, key, F.struct(*[F.col(c) for c in seq]))


def first_of_record(df: DataFrame, seq: list[str]) -> DataFrame:
    """The first record of each name, locality start, and year and month."""
    date = F.col("samplingEvent.date") if "samplingEvent" in df.columns else F.lit("")
    return first_of_key(df, [keys.record_key(record_name(), "verbatimLocality", date)], seq)


def distinct_in_order(df: DataFrame, group: list[str], value: str, position: str) -> DataFrame:
    """The first spelling of each value, letter case aside, within a group, with its position."""
    return df.where(blank(value) != "").groupBy(*group, F.lower(blank(value)).alias("key")).agg(F.min_by(value, position).alias(value), F.min(position).alias(position)).drop("key")


def merge_votes(df: DataFrame, strategy: str, fields: list[str], seq: list[str]) -> DataFrame:
    """Records of one vote key as one: its strategies, how many votes, and each field's first non-blank value.

    The occurrence type is the best that any of them has.
    """
    order = F.struct(*[F.col(c) for c in seq])
    some = lambda f: F.nullif(blank(f), F.lit(""))
    first = [F.min_by(some(f), F.when(some(f).isNotNull(), order)).alias(f) for f in fields]
    best = F.min_by(F.col("occurrenceType"), F.struct(names.type_rank("occurrenceType"), order)).alias("occurrenceType")
    key = keys.vote_key(record_name(), "verbatimLocality").alias("vote_key")
    return df.where(record_name().isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(strategy)).alias("strategies"), F.count(F.lit(1)).alias("votes"), best, *first)


def weigh_votes(merged: DataFrame, weights: dict[str, float]) -> DataFrame:
    """merged with the summed weight of its strategies; one that is not listed weighs 1."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
    weight = lambda s: F.coalesce(table[s], F.lit(1.0)) if table is not None else F.lit(1.0)
    return merged.withColumn("weight", F.aggregate("strategies", F.lit(0.0), lambda total, s: total + weight(s)))


def expand_abbreviations(df: DataFrame, name: str = "recordedName", group: list[str] | None = None) -> DataFrame:
    """df with "G. epithet" names spelled out by a full name of the same initial and epithet in the group."""
    group = group or []
    text = blank(name)
    full = df.where(text.rlike(r"^[A-Z][a-z]{2,}\s+[a-z]")).select(*group, names.genus_initial(name).alias("__i"), F.element_at(F.split(text, r"\s+"), 2).alias("__e"), text.alias("__full"))
    full = full.groupBy(*group, "__i", "__e").agg(F.min("__full").alias("__full"))
    short = F.when(text.rlike(r"^[A-Z]\.\s*[a-z]"), F.regexp_extract(text, r"^[A-Z]\.\s*(\S+)", 1))
    marked = df.withColumn("__i", names.genus_initial(name)).withColumn("__e", short)
    return marked.join(full, [*group, "__i", "__e"], "left").withColumn(name, F.coalesce("__full", F.col(name))).select(*df.columns)


def conflicts(df: DataFrame) -> DataFrame:
    """Species and localities with records of more than one occurrence type: the types, and how many records."""
    name, place = F.lower(record_name()), names.squeeze("verbatimLocality")
    grouped = df.where(name.isNotNull()).groupBy(name.alias("species"), place.alias("locality"))
    out = grouped.agg(F.count(F.lit(1)).alias("n_records"), F.sort_array(F.collect_set(F.lower(F.coalesce("occurrenceType", F.lit(""))))).alias("types"))
    return out.where(F.size("types") > 1)


def longest(df: DataFrame, group: list[str], fields: list[str]) -> DataFrame:
    """Per group the longest value of each field."""
    return df.groupBy(*group).agg(*[F.max_by(f, F.struct(F.length(blank(f)), F.col(f))).alias(f) for f in fields])


def union_ignoring_case(a: Column, b: Column) -> Column:
    """Elements of a, then those of b that a lacks, letter case aside."""
    a, b = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("seen"))
    step = lambda acc, x: F.when(F.array_contains(acc["seen"], F.lower(x)), acc).otherwise(F.struct(F.array_append(acc["out"], x).alias("out"), F.array_append(acc["seen"], F.lower(x)).alias("seen")))
    return F.aggregate(F.concat(a, b), start, step, lambda acc: acc["out"])


def drop_contained(df: DataFrame, group: list[str], name: str) -> DataFrame:
    """Names of a group that are not part of a longer name of it. Groups are documents, so each is small."""
    mine = df.select(*group, F.col(name).alias("__name")).distinct()
    all_names = mine.groupBy(*group).agg(F.collect_set("__name").alias("__all"))
    inside = F.exists("__all", lambda x: (x != F.col(name)) & F.contains(F.lower(x), F.lower(F.col(name))))
    return df.join(all_names, group).where(~inside).select(*df.columns)


def numbered_first_seen(df: DataFrame, group: list[str], key: str, position: str) -> DataFrame:
    """group, key, number: keys numbered by where they first appear in their group."""
    first = df.groupBy(*group, key).agg(F.min(position).alias("__at"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(*group).orderBy("__at", key))).drop("__at")


def numbered_by_name(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """group, key, number: keys numbered in alphabetical order."""
    return df.select(*group, key).distinct().withColumn("number", F.dense_rank().over(Window.partitionBy(*group).orderBy(key)))
