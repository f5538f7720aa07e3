"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source of rate r (its target over its own size) gets floor(r) certain copies
of every document; the rest is a sample without replacement. There each
document has a random number u, from a seeded digest of its id and text, and
inclusion odds of its own: those of its source's rate, multiplied by a tilt of
the document. Documents are ranked by their random odds u/(1-u) over their
inclusion odds. The sample is the start of that order, of fixed size in words:
it is cut where the words taken come nearest to the target. One document per
source may then join or leave it, if that comes nearer still.

The cut is found without sorting a source: logarithms of the ranks are mapped to
60-bit keys, and a histogram of key ranges narrows the range that holds the cut,
1024 times per level, until few documents are left in it. All that is gathered
per source has at most 1024 rows, however large the source. Sources may be many
as well: they are numbered by a range partition and filled up by sums alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm import common
from fieldloom.session import Workspace

#: Word separators of the size contract: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS, LEVEL_BITS = 60, 10
#: Logarithms of ranks lie between -HALF and HALF.
HALF = 128


def word_count(text: Column) -> Column:
    """Number of WORD matches; null counts 0. Blanks become one kind, and words start where a blank precedes a non-blank."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(flat, " +"), "")).cast("long")


def _numbered_sources(sizes: DataFrame, work: Workspace) -> DataFrame:
    """sizes with place, the number from 0 of each source in code point order, null last."""
    dealt = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("deal", F.spark_partition_id())
    dealt = work.save(dealt, "dealt")
    # a row per partition
    ends = dealt.groupBy("deal").agg(F.count(F.lit(1)).alias("n"))
    before = ends.select("deal", (F.sum("n").over(Window.orderBy("deal")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("deal").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("within", within).join(before, "deal").withColumn("place", F.col("before") + F.col("within")).drop("deal", "within", "before")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float, work: Workspace) -> DataFrame:
    """sizes (source, source_size, ...) with each source's target.

    Sources in code point order, null last, get ``weights`` in turn, repeating.
    Targets share ``share`` times all sizes by weight but stop at ``most`` times
    the source's size; what that leaves over is shared again by weight until
    none is above. Each round is two sums over the sources. One row per source.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = work.save(_numbered_sources(sizes, work).withColumn("weight", weight).withColumn("room", most * F.col("source_size")), "ranked")
    total, left_weight = ranked.agg(share * F.sum("source_size"), F.sum("weight")).first()
    level, stopped = (total / left_weight if left_weight else 0.0), -1
    while True:
        full = F.col("room") <= level * F.col("weight")
        n, used, left_weight = ranked.agg(F.count_if(full), F.sum(F.when(full, F.col("room"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == stopped or not left_weight:
            break
        level, stopped = (total - (used or 0.0)) / left_weight, n
    # with every source full, the level is of no account
    target = F.least(F.col("room"), level * F.col("weight")) if left_weight else F.col("room")
    return ranked.withColumn("target", target).drop("place", "weight", "room")


def pareto_mix(
    docs: DataFrame,
    weights: list[float],
    share: float = 1.0,
    most: float = 2.0,
    seed: str = "mix",
    length_power: float = 0.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tilt_col: str | None = None,
) -> DataFrame:
    """Per row: row_id, doc_id, source, size, source_size, target, copies, taken (size x copies).

    A document's inclusion odds are those of its source's rate, times
    (mean size of the source's documents / its own size) ** length_power, times
    ``tilt_col``, a positive number per document (null or absent means 1).
    Rows alike in id and text share a random number; equal keys are told apart
    by row_id, so a part of such rows may be taken. Documents without a word are
    of size 0 and never change a total. Null sources are one source; ids may be
    null or of any type. An empty table gives no rows. The draw depends on ids,
    texts and seed alone, so reruns agree.
    """
    work = Workspace(docs.sparkSession, "mix")
    tilt = common.named(tilt_col) if tilt_col else F.lit(1.0)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), common.named(id_col).alias("doc_id"), common.named(source_col).alias("source"), common.named(text_col).alias("text"), tilt.alias("tilt"))
    return _mixed(rows, weights, share, most, seed, length_power, work)


def mix_documents(docs: DataFrame, weights: list[float], share: float = 1.0, most: float = 2.0, seed: str = "mix", length_power: float = 0.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tilt_col: str | None = None) -> DataFrame:
    """docs with every row repeated as often as the mix takes it, and all columns kept.

    Nulls, ties and repeated rows are as in pareto_mix; each row has its own
    number of copies. An empty table gives no rows. Columns may have any names.
    """
    work = Workspace(docs.sparkSession, "mix")
    base = common.numbered(docs, work)
    tilt = common.place(docs, tilt_col) if tilt_col else F.lit(1.0)
    rows = base.select("row_id", common.place(docs, id_col).alias("doc_id"), common.place(docs, source_col).alias("source"), common.place(docs, text_col).alias("text"), tilt.alias("tilt"))
    copies = _mixed(rows, weights, share, most, seed, length_power, work).where("copies > 0").select("row_id", "copies")
    each = base.join(copies, "row_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return common.restored(each, docs)


def _mixed(rows: DataFrame, weights: list[float], share: float, most: float, seed: str, length_power: float, work: Workspace) -> DataFrame:
    """pareto_mix over rows: row_id, doc_id, source, text, tilt."""
    known = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(F.coalesce("text", F.lit(""))).cast("string"))
    draw = F.conv(F.substring(F.md5(known.cast("binary")), 1, 13), 16, 10).cast("long")
    rows = work.save(rows.select("row_id", "doc_id", "source", word_count(F.col("text")).alias("size"), draw.alias("draw"), F.coalesce(F.col("tilt").cast("double"), F.lit(1.0)).alias("tilt")), "rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("docs"))
    targets = (
        source_targets(sizes, weights, share, most, work)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("part", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    )
    targets = work.save(targets, "targets")
    u = (F.col("draw") + 0.5) / float(1 << 52)
    p = F.greatest(F.least(F.col("part") / F.col("source_size"), F.lit(1.0 - 1e-12)), F.lit(1e-12))
    mean = F.col("source_size") / F.col("docs")
    tilted = F.log("tilt") + length_power * (F.log(mean) - F.log(F.greatest("size", F.lit(1))))
    log_rank = F.log(u) - F.log(1.0 - u) - F.log(p) + F.log(1.0 - p) - tilted
    # logarithms keep the order and are spread evenly enough, however near p is to 0 or 1
    within = F.greatest(F.least(log_rank, F.lit(HALF - 2.0**-40)), F.lit(-float(HALF)))
    key = F.floor((within + HALF) * float(1 << (KEY_BITS - 8))).cast("long")
    keyed = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select("row_id", "doc_id", rows["source"], "size", "source_size", "target", "whole", "part", F.when(F.col("source_size") > 0, key).otherwise(F.lit(0)).alias("key"))
    keyed = work.save(keyed, "keyed")
    cuts = work.save(_find_cuts(keyed, targets, work).withColumnRenamed("source", "cut_source"), "cuts")
    joined = keyed.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    sampled = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("row_id") <= F.col("cut_row")))
    drawn = work.save(joined.select("row_id", "doc_id", "source", "size", "source_size", "target", "whole", "part", "key", F.coalesce(sampled, F.lit(False)).alias("sampled")), "drawn")
    moves = work.save(_closing_moves(drawn), "moves")
    work.keep_only("numbered", "drawn", "moves")
    final = drawn.join(moves, F.col("source").eqNullSafe(F.col("move_source")), "left")
    moved = F.coalesce(F.col("row_id") == F.col("move_row"), F.lit(False))
    copies = F.col("whole") + (F.col("sampled") != moved).cast("long")
    return final.select("row_id", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def _closing_moves(drawn: DataFrame) -> DataFrame:
    """move_source, move_row: the document whose joining or leaving the sample brings its source nearest to the target, if any does.

    In a small source the document at the cut may be a large part of all words;
    this last move makes up for it.
    """
    taken = drawn.groupBy("source", "target").agg(F.sum(F.col("size") * (F.col("whole") + F.col("sampled").cast("long"))).alias("words"))
    gaps = taken.select(F.col("source").alias("move_source"), (F.col("target") - F.col("words")).alias("gap"))
    each = drawn.where("part > 0 AND size > 0").select("source", "row_id", "key", "size", "sampled")
    open_ = each.join(gaps, F.col("source").eqNullSafe(F.col("move_source")))
    left = F.abs(F.col("gap") - F.when(F.col("sampled"), -F.col("size")).otherwise(F.col("size")))
    nearer = open_.withColumn("left", left).where(F.col("left") < F.abs("gap"))
    return nearer.groupBy("move_source").agg(F.min(F.struct("left", "key", "row_id")).alias("m")).select("move_source", F.col("m.row_id").alias("move_row"))


def _find_cuts(keyed: DataFrame, targets: DataFrame, work: Workspace) -> DataFrame:
    """The last document of each source's sample: source, cut_key, cut_row; none where nothing is sampled."""
    low = targets.where("part > 0").select("source", F.col("part").alias("need"), F.lit(0).cast("long").alias("low"))
    for shift in range(KEY_BITS - LEVEL_BITS, KEY_BITS - 4 * LEVEL_BITS, -LEVEL_BITS):
        inside = _within(keyed, low, shift + LEVEL_BITS)
        bins = inside.groupBy("source", "need", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("words"))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
        crossing = bins.withColumn("upto", running).where(F.col("upto") >= F.col("need"))
        first = crossing.groupBy("source").agg(F.min_by(F.struct("bin", "words", "upto", "need"), "bin").alias("b"))
        # without a crossing (the sample takes all), the last bin holds the cut
        last = bins.groupBy("source").agg(F.max_by(F.struct("bin", "words", F.lit(None).cast("long").alias("upto"), "need"), "bin").alias("z"), F.sum("words").alias("all_words"))
        found = last.join(first.withColumnRenamed("source", "first_source"), F.col("source").eqNullSafe(F.col("first_source")), "left")
        b = F.coalesce("b.bin", "z.bin")
        need = F.coalesce(F.col("b.need") - (F.col("b.upto") - F.col("b.words")), F.col("z.need") - (F.col("all_words") - F.col("z.words")))
        low = work.save(found.select("source", need.alias("need"), F.shiftleft(b, shift).alias("low")), f"cuts{shift}")
    inside = _within(keyed, low, shift)
    upto = inside.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("key", "row_id")))
    # the document that crosses is taken if that comes nearer than stopping before it
    near = upto.where((F.col("upto") <= F.col("need")) | (F.col("upto") - F.col("need") < F.col("need") - (F.col("upto") - F.col("size"))))
    chosen = near.groupBy("source").agg(F.max(F.struct("key", "row_id")).alias("c"))
    # where even the first document of the last range is too much, the cut lies before that range
    cut = low.join(chosen.withColumnRenamed("source", "chosen_source"), F.col("source").eqNullSafe(F.col("chosen_source")), "left")
    return cut.select("source", F.coalesce("c.key", F.col("low") - 1).alias("cut_key"), F.coalesce("c.row_id", F.lit((1 << 62))).alias("cut_row"))


def _within(keyed: DataFrame, low: DataFrame, bits: int) -> DataFrame:
    """Rows of keyed with a word whose key shares its source's low end above the last ``bits`` bits."""
    ends = low.withColumnRenamed("source", "low_source")
    same = keyed["source"].eqNullSafe(ends["low_source"]) & (F.shiftright(keyed["key"], bits) == F.shiftright(ends["low"], bits))
    return keyed.where("size > 0").join(ends, same).select("source", "key", "row_id", "size", "need")
