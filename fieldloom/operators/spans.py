"""Spans of texts: overlaps resolved, neighbours merged.

Spans that overlap, directly or through others, form an island; islands are told
apart by a running maximum of ends over a document's spans in order, and what is
folded in sequence is one island. All of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matches(docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """id, start, stop, told of every match of a pattern; offsets count characters, matches of nothing are left out.

    What stands between matches tells where they are: its lengths are summed up
    over a document's matches in order. Ids must tell documents apart.
    """
    hits = F.filter(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0)), lambda x: x != "")
    gaps = F.transform(F.slice(F.split(text_col, pattern, -1), F.lit(1), F.size(hits)), F.length)
    # texts move once, so that neither these windows nor later ones by document move their matches
    texts = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col).repartition(id_col)
    found = texts.select(id_col, F.posexplode(F.arrays_zip(gaps.alias("gap"), hits.alias("told"))).alias("i", "x")).select(id_col, "i", "x.gap", "x.told")
    so_far = Window.partitionBy(id_col).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.length("told")).over(so_far).cast("int")
    return found.select(id_col, stop.alias("stop"), "told").select(id_col, (F.col("stop") - F.length("told")).alias("start"), "stop", "told")


def islands(spans: DataFrame, id_col: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """spans with island: the number of groups of overlapping spans that begin before in the document, its own included."""
    order = Window.partitionBy(id_col).orderBy(start, stop)
    before = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (before.isNull() | (F.col(start) >= before)).cast("int")
    return spans.withColumn("__fresh", fresh).withColumn("island", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (a["stop"] > b["start"])


def resolve_overlaps(spans: DataFrame, id_col: str, order: list[str], confidence: str = "confidence") -> DataFrame:
    """spans (id, start, stop, confidence, ...) of which those that lose against an overlapping one go.

    Spans come in ``order``. One that overlaps none of the kept is kept. One that
    overlaps some is held against the first of these, in the order in which they
    came to be kept: it takes that one's place, as the last, if it is surer, and
    goes otherwise; ties stay with the kept one. Spans that only touch do not
    overlap, an empty span overlaps those around it. Null starts or stops go.
    """
    rows = spans.where("start IS NOT NULL AND stop IS NOT NULL")
    rest = [c for c in spans.columns if c != id_col]
    item = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row"))
    listed = islands(rows, id_col).groupBy(id_col, "island").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["row"]).alias("all"))
    sure = lambda x: F.coalesce(x[confidence].cast("double"), F.lit(float("-inf")))

    def fold(kept: Column, x: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: _overlap(k, x)), True)
        rival = F.get(kept, (at - 1).cast("int"))
        without = F.filter(kept, lambda k, i: i != (at - 1).cast("int"))
        return F.when(at == 0, F.concat(kept, F.array(x))).when(sure(x) > sure(rival), F.concat(without, F.array(x))).otherwise(kept)

    none = F.filter("all", lambda x: F.lit(False))
    kept = listed.withColumn("kept", F.aggregate("all", none, fold))
    return kept.select(id_col, F.inline("kept")).select(*spans.columns)


def leftmost_longest(spans: DataFrame, id_col: str) -> DataFrame:
    """Of spans (id, start, stop, ...) the leftmost, at one start the longest, then the next behind it; equal ones go by all their values."""
    rest = [c for c in spans.columns if c != id_col]
    item = F.struct("start", (-F.col("stop")).alias("__end"), F.struct(*rest).alias("row"))
    rows = spans.where("start IS NOT NULL AND stop IS NOT NULL")
    listed = islands(rows, id_col).groupBy(id_col, "island").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["row"]).alias("all"))

    def fold(kept: Column, x: Column) -> Column:
        free = (F.size(kept) == 0) | (F.get(kept, F.size(kept) - 1)["stop"] <= x["start"])
        return F.when(free, F.concat(kept, F.array(x))).otherwise(kept)

    none = F.filter("all", lambda x: F.lit(False))
    return listed.withColumn("kept", F.aggregate("all", none, fold)).select(id_col, F.inline("kept")).select(*spans.columns)


def merge_subwords(pieces: DataFrame, id_col: str, order: list[str], gap: int = 2) -> DataFrame:
    """id, n, word, label, score, start, stop: neighbouring pieces (word, label, score, start, stop) made into spans.

    Pieces come in ``order``. Word-piece marks (##) and blanks around a word go,
    and pieces without a word with them. A piece joins the span before it if the
    label is the same and it starts at most ``gap`` characters after that span's
    end (or before it); words are joined by a blank, the end is the piece's, the
    score the mean of the span's so far and the piece's. A null label is a label;
    a null score counts as 1, null offsets as 0. n numbers a document's spans.
    """
    word = F.trim(F.replace("word", F.lit("##"), F.lit("")))
    rows = pieces.select(id_col, *order, *[F.coalesce(c, F.lit(0)).alias(f"__{c}") for c in ("start", "stop")], "label", F.coalesce(F.col("score").cast("double"), F.lit(1.0)).alias("__score"), word.alias("__word")).where("__word <> ''")
    by = Window.partitionBy(id_col).orderBy(*order)
    joins = F.col("label").eqNullSafe(F.lag("label").over(by)) & (F.col("__start") - F.lag("__stop").over(by) <= gap)
    rows = rows.withColumn("__fresh", F.when(joins, 0).otherwise(1)).withColumn("n", F.sum("__fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], "__word", "__score", "__start", "__stop")
    grouped = rows.groupBy(id_col, "n").agg(F.sort_array(F.collect_list(item)).alias("p"), F.first("label").alias("label"))
    first = F.get("p", F.lit(0))
    mean = F.aggregate(F.slice("p", F.lit(2), F.size("p")), first["__score"], lambda s, x: (s + x["__score"]) / 2)
    return grouped.select(id_col, F.col("n").cast("int").alias("n"), F.array_join(F.transform("p", lambda x: x["__word"]), " ").alias("word"), "label", mean.alias("score"), first["__start"].alias("start"), F.element_at("p", -1)["__stop"].alias("stop"))
