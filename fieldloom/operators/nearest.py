"""Joins by distance in a text, and windows over its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import text


def nearest_mention(records: DataFrame, mentions: DataFrame, doc: str, at: str, within: int, fields: list[str]) -> DataFrame:
    """records with the fields of the mention of its document that is nearest by character, none beyond ``within``.

    mentions: doc, at, fields. Positions are cut into cells as wide as the reach,
    so a record meets mentions of its own and the two neighbouring cells only.
    records must tell rows apart by (doc, at). Ties go to the earlier mention.
    """
    reach = max(1, within)
    cells = mentions.select(F.col(doc).alias("__doc"), F.floor(F.col(at) / reach).alias("__cell"), F.col(at).alias("__at"), *[F.col(f).alias(f"__{f}") for f in fields])
    mine = records.select(doc, at).distinct().withColumn("__cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(at) / reach) + d)))
    pairs = mine.join(cells, (F.col(doc) == F.col("__doc")) & (mine["__cell"] == cells["__cell"]))
    near = pairs.where(F.abs(F.col(at) - F.col("__at")) <= within)
    best = near.groupBy(doc, at).agg(F.min_by(F.struct(*[F.col(f"__{f}").alias(f) for f in fields]), F.struct(F.abs(F.col(at) - F.col("__at")), F.col("__at"))).alias("__best"))
    return records.join(best, [doc, at], "left").select(*records.columns, *[F.col(f"__best.{f}").alias(f) for f in fields])


def around(df: DataFrame, group: list[str], order: str, value: Column, reach: int, out: str) -> DataFrame:
    """df with the distinct non-null values of rows at most ``reach`` places before or after."""
    w = Window.partitionBy(*group).orderBy(order).rangeBetween(-reach, reach)
    return df.withColumn(out, F.array_distinct(F.collect_list(value).over(w)))


def windows_around(docs: DataFrame, names: DataFrame, id_col: str, text_col: str, name: str, reach: int) -> DataFrame:
    """id, name, at, window: the text around every mention of a name. names: id, name."""
    joined = docs.select(id_col, text_col).join(names.select(id_col, name).distinct(), id_col)
    low, key = F.lower(F.col(text_col)), F.lower(F.col(name))
    # the text between mentions tells where they are
    pieces = F.transform(F.split(low, F.concat(F.lit(r"\Q"), key, F.lit(r"\E"))), F.length)
    ends = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: F.aggregate(F.slice(pieces, 1, k), F.lit(0), lambda s, x: s + x) + (k - 1) * F.length(key))
    found = joined.where(F.contains(low, key) & (key != "")).select(id_col, name, text_col, F.explode(ends).alias("at"))
    start = F.greatest(F.col("at") - reach, F.lit(0))
    return found.select(id_col, name, "at", F.substr(F.col(text_col), start + 1, F.col("at") - start + F.length(name) + reach).alias("window"))


def same_sentence(docs: DataFrame, id_col: str, text_col: str, left: Column, right: Column, most: int = 20) -> DataFrame:
    """id, left, right: elements of two arrays that a sentence of the document holds both; the first ``most`` per document."""
    rows = docs.select(id_col, F.posexplode(text.sentences(text_col, 0)).alias("s", "sentence"), left.alias("__l"), right.alias("__r"))
    has = lambda arr: F.filter(arr, lambda x: F.contains(F.lower(F.col("sentence")), F.lower(x)))
    pairs = rows.select(id_col, "s", F.explode(has(F.col("__l"))).alias("left"), has(F.col("__r")).alias("__r")).select(id_col, "s", "left", F.explode("__r").alias("right"))
    first = pairs.groupBy(id_col, "left", "right").agg(F.min("s").alias("s"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(id_col).orderBy("s", "left", "right"))).where(F.col("n") <= most).select(id_col, "left", "right")


def best_in_window(species: DataFrame, places: DataFrame, on: list[str], confidence: str, fields: list[str]) -> DataFrame:
    """species with the fields of its window's most confident place."""
    best = places.groupBy(*on).agg(F.max_by(F.struct(*fields), F.struct(F.col(confidence), *fields)).alias("__b"))
    return species.join(best, on, "left").select(*species.columns, *[F.col(f"__b.{f}").alias(f) for f in fields])


def coordinates_in(c: Column | str) -> Column:
    """Pairs of decimal degrees in a text that are in range."""
    raw = text.matches(c, r"-?\d{1,2}\.\d{2,}\s*°?\s*[NS]?\s*[,;]\s*-?\d{1,3}\.\d{2,}\s*°?\s*[EW]?")
    number = lambda p, i: F.get(F.transform(text.matches(p, r"-?\d{1,3}\.\d{2,}"), lambda x: x.cast("double")), F.lit(i))
    pairs = F.transform(raw, lambda p: F.struct(number(p, 0).alias("lat"), number(p, 1).alias("lon")))
    return F.filter(pairs, lambda p: p["lat"].between(-90, 90) & p["lon"].between(-180, 180))
