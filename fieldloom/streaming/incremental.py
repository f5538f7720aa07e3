"""Structured Streaming forms: files once each, running bests and counts, stage machines and triggers.

State lives in written snapshots that foreachBatch replaces; a batch id that was
seen before is not applied twice, so a restarted query ends with the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldloom.sinks.writers import Snapshots


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """New parquet files of a folder, each read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def fold(stream: DataFrame, state: Snapshots, checkpoint: str, step: Callable[[DataFrame | None, DataFrame], DataFrame]) -> StreamingQuery:
    """Run step(state so far, batch) over every batch there is now, and keep each result as a snapshot.

    A snapshot's note names the checkpoint and the batch it holds last, so a
    batch that is delivered again is left out, and a fresh checkpoint over an
    older state starts at its first batch.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        where, _, last = (state.note() or "").rpartition("#")
        if where == checkpoint and batch_id <= int(last):
            return
        state.write(step(state.read() if state.current() is not None else None, batch), note=f"{checkpoint}#{batch_id}")

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()
    query.awaitTermination()
    return query


def running_best(key: list[str], order: Column) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A step that keeps each key's row of least order."""

    def step(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch if old is None else old.unionByName(batch)
        rest = [c for c in rows.columns if c not in key]
        return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*key, "__r.*").select(*rows.columns)

    return step


def running_sum(key: list[str], columns: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A step that adds columns up per key."""

    def step(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch.select(*key, *columns) if old is None else old.unionByName(batch.select(*key, *columns))
        return rows.groupBy(*key).agg(*[F.sum(c).alias(c) for c in columns])

    return step


def running_stage(key: str, stages: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A step that keeps the furthest stage of each key. Batches: key, stage."""

    def step(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch.select(key, "stage") if old is None else old.unionByName(batch.select(key, "stage"))
        return rows.groupBy(key).agg(F.max_by("stage", F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))).alias("stage"))

    return step


def touched(key: list[str], recompute: Callable[[DataFrame], DataFrame], source: Callable[[], DataFrame]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A step that recomputes only the keys a batch touches, from all rows of the source."""

    def step(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        dirty = batch.select(*key).distinct()
        new = recompute(source().join(dirty, key, "left_semi"))
        return new if old is None else old.join(dirty, key, "left_anti").unionByName(new)

    return step


def unseen(df: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Rows whose key the processed table lacks."""
    return df.join(processed.select(key), key, "left_anti")


def earlier_records(records: DataFrame, skipped: DataFrame, key: str) -> DataFrame:
    """Records of documents that are skipped because they were processed before."""
    return records.join(skipped.select(key), key, "left_semi")


def dirty_keys(chunks: DataFrame, key: str) -> DataFrame:
    """Keys with work waiting."""
    return chunks.where("dirty").select(key).distinct()


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts per window of event time; rows later than ``late`` are not waited for."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")
