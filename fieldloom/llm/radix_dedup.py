"""Exact dedup by distributed most-significant-digit radix partitioning.

A document starts in one group with all others. In each round a group is split
by the next bytes of its texts (its next digit); groups of one document are
done, and so are groups whose texts have ended. What goes on to the next round
is only the unread rest of texts in groups that are still shared. Digits grow
from round to round, so a text of n bytes takes about log n rounds. Equality is
decided by the bytes alone; no digest takes part.

Groups are counted with map-side aggregation, and rows meet their group's count
in a sort-merge join that adaptive execution can split, so a group that holds a
third of all rows is never gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import common
from fieldloom.session import COMPRESSION, Workspace

FIRST_DIGIT = 64
DIGIT_GROWTH = 8


def radix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT, growth: int = DIGIT_GROWTH) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, and row_id, unique to the row.

    Texts are equal when their bytes are; null counts as empty. The row with the
    largest doc_id of a group stays; where rows share that doc_id too, exactly
    one of them is kept. Ids may be of any type that has an order; a null one is
    below all others. An empty table gives no rows; other columns are not read.
    """
    work = Workspace(docs.sparkSession, "radix")
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), common.named(id_col).alias("doc_id"), common.named(text_col).alias("text"))
    return _split_groups(work.save(_first_level(rows), "level0"), work, first_digit, growth)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of equal texts.

    Which one is as in radix_groups: the largest id, one of those that share it,
    so rows repeated whole leave one. A null text counts as empty. An empty table
    gives no rows. Columns may have any names.
    """
    work = Workspace(docs.sparkSession, "radix")
    rows = common.numbered(docs, work)
    level = _first_level(rows.select("row_id", common.place(docs, id_col).alias("doc_id"), common.place(docs, text_col).alias("text")))
    stay = _split_groups(level, work, FIRST_DIGIT, DIGIT_GROWTH).where("kept").select("row_id")
    return common.restored(rows.join(stay, "row_id", "left_semi"), docs)


def _first_level(rows: DataFrame) -> DataFrame:
    """All rows (row_id, doc_id, text) in one group with their whole texts unread."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return rows.select("row_id", "doc_id", F.sha2(text, 256).alias("text_sha256"), F.lit(0).cast("long").alias("group"), text.alias("rest"))


def _split_groups(level: DataFrame, work: Workspace, first_digit: int, growth: int) -> DataFrame:
    """Splits the first level, a written table or one that reads one, until every group is done."""
    done: list[str] = []
    width, depth = first_digit, 0
    while True:
        digit = F.substring("rest", 1, width)
        keyed = level.select("row_id", "doc_id", "text_sha256", "group", digit.alias("digit"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
        # the row of the largest id, and of no id where none has one; a written table, so that the join below can be split at a hot group
        counted = level.select("group", digit.alias("digit"), "doc_id", "row_id").groupBy("group", "digit")
        groups = counted.agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("first_id"), F.coalesce(F.max_by("row_id", "doc_id"), F.max("row_id")).alias("first_row")).where("n > 1")
        groups = work.save(groups, f"groups{depth}")
        split = keyed.join(groups.hint("merge"), ["group", "digit"], "left")
        alone, ended = F.col("n").isNull(), F.octet_length("digit") < width
        state = split.select(
            "row_id",
            "doc_id",
            "text_sha256",
            F.coalesce("first_row", "row_id").alias("group"),
            F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.when(~(alone | ended), F.col("rest")).alias("rest"),
            F.when(alone | ended, "done").otherwise("open").alias("state"),
        )
        path = work.path(f"split{depth}")
        state.write.mode("overwrite").option("compression", COMPRESSION).partitionBy("state").parquet(path)
        done.append(path)
        work.drop(f"split{depth - 1}/state=open" if depth else "level0", f"groups{depth}")
        schema = state.schema
        level = work.spark.read.schema(schema).parquet(path).where("state = 'open'").select("row_id", "doc_id", "text_sha256", "group", "rest")
        if level.isEmpty():
            break
        width, depth = width * growth, depth + 1
    finished = None
    for path in done:
        part = work.spark.read.schema(schema).parquet(path).where("state = 'done'")
        finished = part if finished is None else finished.unionByName(part)
    return finished.select("doc_id", "keep_id", "group_size", (F.col("group") == F.col("row_id")).alias("kept"), "text_sha256", "row_id")
