"""Keyed state in Spark's own state store: stage machines and buffers that flush.

A key's state is a few values, whatever the stream's length; only keys that a
batch touches are read and written. The final table of a run is read back from
the state store of its checkpoint, and so survives restarts as the stream does.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldloom.session import ship_code

PROVIDER_KEY, PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def _rocksdb(spark: SparkSession):
    """The state store that keyed state needs, for the streams started within; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER_KEY)
        else:
            spark.conf.set(PROVIDER_KEY, before)


def drain(stream: DataFrame, checkpoint: str, out: str) -> None:
    """Run a stateful stream over what there is now; each batch's rows are a folder of its own below ``out``, so one that comes again replaces itself."""
    spark = stream.sparkSession
    with _rocksdb(spark):
        put = lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")
        query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()


def state_table(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """A state variable of a checkpoint: its key's and its value's columns."""
    with _rocksdb(spark):
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).select("key.*", "value.*")


class StageMachine(StatefulProcessor):
    """The furthest stage of a key, when it was first and last seen, and its places with how often each was told."""

    def __init__(self, stages: list[str]):
        self.rank = {s: i for i, s in enumerate(stages)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stage = handle.getValueState("stage", "rank int, stage string, n long, first timestamp, last timestamp")
        self.places = handle.getMapState("places", "place string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rank, stage, n, first, last = self.stage.get() if self.stage.exists() else (-1, None, 0, None, None)
        told: dict[str, int] = {}
        for batch in rows:
            n += len(batch)
            at = pd.to_datetime(batch["at"]).dropna()
            if len(at):
                first, last = (f(x for x in (y, f(at)) if x is not None) for f, y in ((min, first), (max, last)))
            for s in batch["stage"].dropna().unique():
                if self.rank.get(s, -1) > rank:
                    rank, stage = self.rank[s], s
            for place, count in batch["place"].dropna().value_counts().items():
                told[place] = told.get(place, 0) + int(count)
        self.stage.update((rank, stage, n, first, last))
        for place, count in told.items():
            before = self.places.getValue((place,))
            self.places.updateValue((place,), ((before[0] if before else 0) + count,))
        yield pd.DataFrame({"key": [key[0]], "stage": [stage], "n": [n]})

    def close(self) -> None:
        pass


def track_stages(events: DataFrame, stages: list[str]) -> DataFrame:
    """The stream of keys whose stage was told: key, stage, n. events: a stream of key (string), stage, place, at.

    A stage not among ``stages``, or null, counts as an event only; so does a
    null place. State: stage (rank, stage, n, first, last) and places (n by place).
    """
    ship_code()
    return events.groupBy("key").transformWithStateInPandas(StageMachine(stages), "key string, stage string, n long", "Update", "None")


def furthest_stages(events: DataFrame, stages: list[str]) -> DataFrame:
    """The stream of keys whose stage was told: key, rank (-1 for none), n, first, last; as track_stages() without places.

    The state is Spark's own aggregation of a key, so a batch's rows are added up
    in each task before they move, and no key costs calls into Python. events: a
    stream of key, stage, at.
    """
    rank = F.array_position(F.array(*map(F.lit, stages)), F.col("stage")).cast("int") - 1
    return events.groupBy("key").agg(F.max(F.coalesce(rank, F.lit(-1))).alias("rank"), F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max_by("at", "at").alias("last"))


def furthest_table(spark: SparkSession, checkpoint: str, stages: list[str]) -> DataFrame:
    """key, stage, n, first, last of a checkpoint of furthest_stages()."""
    with _rocksdb(spark):
        # the store names an aggregation's values by their functions, of which no two may be alike
        held = spark.read.format("statestore").load(checkpoint).select("key.*", "value.*").toDF("key", "rank", "n", "first", "last", "order")
    return held.select("key", F.get(F.array(*map(F.lit, stages)), F.col("rank")).alias("stage"), "n", "first", "last")


class Buffer(StatefulProcessor):
    """Gathers a key's texts and gives them out when there are enough, or when the key has been silent."""

    def __init__(self, most_texts: int, most_chars: int, idle_ms: int):
        self.most_texts, self.most_chars, self.idle_ms = most_texts, most_chars, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.texts = handle.getListState("texts", "text string")
        self.held = handle.getValueState("held", "n int, chars long, first timestamp, last timestamp, flushes int")

    def _out(self, key, flushed: list[tuple]) -> pd.DataFrame:
        """Flushed buffers (why, number, first, texts) of a key as rows."""
        why, flush, first, texts = (list(x) for x in zip(*flushed, strict=True))
        return pd.DataFrame({"key": [key[0]] * len(flushed), "flush": flush, "n": [len(t) for t in texts], "chars": [sum(map(len, t)) for t in texts], "first": first, "why": why, "texts": texts})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, chars, first, last, flushes = self.held.get() if self.held.exists() else (0, 0, None, None, 0)
        # the state store is asked once for the held texts and told once, however many rows there are
        texts = [t[0] for t in self.texts.get()] if n else []
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        flushed = []
        # a key's rows of one batch, in order
        for row in pd.concat(list(rows)).sort_values(["at", "seq"]).itertuples():
            at = row.at
            if n and (at - last).total_seconds() * 1000 > self.idle_ms:
                flushed.append(("idle", flushes, first, texts))
                texts, n, chars, flushes = [], 0, 0, flushes + 1
            text = row.text if isinstance(row.text, str) else ""
            texts.append(text)
            n, chars, first, last = n + 1, chars + len(text), at if n == 0 else first, at
            if n >= self.most_texts or chars >= self.most_chars:
                flushed.append(("full", flushes, first, texts))
                texts, n, chars, flushes = [], 0, 0, flushes + 1
        if n:
            self.texts.put([(t,) for t in texts])
        else:
            self.texts.clear()
        self.held.update((n, chars, first, last, flushes))
        if n:
            self.handle.registerTimer(int(last.timestamp() * 1000) + self.idle_ms + 1)
        if flushed:
            yield self._out(key, flushed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, _, first, last, flushes = self.held.get()
        if n:
            texts = [t[0] for t in self.texts.get()]
            self.texts.clear()
            self.held.update((0, 0, first, last, flushes + 1))
            yield self._out(key, [("idle", flushes, first, texts)])

    def close(self) -> None:
        pass


def flush_buffers(texts: DataFrame, most_texts: int = 8, most_chars: int = 12_000, idle: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """The stream of flushed buffers: key, flush (0, 1, ...), n, chars, first, why (full or idle), texts.

    texts: a stream of key (string), at (event time, not null), seq (breaks ties
    of time), text. A buffer goes out with the text that fills it (a null text
    counts as an empty one), or when its key has been silent for longer than
    ``idle``: told by its next text, or by an event-time timer once the watermark
    has passed. Rows that come more than ``late`` behind go. What is held at the
    end is in the state variables held and texts; see pending_buffers.
    """
    ship_code()
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    fields = "key string, flush int, n int, chars long, first timestamp, why string, texts array<string>"
    return texts.withWatermark("at", late).groupBy("key").transformWithStateInPandas(Buffer(most_texts, most_chars, idle_ms), fields, "Update", "EventTime")


def pending_buffers(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Buffers that a checkpoint still holds, as flush_buffers gives them, without their texts."""
    return state_table(spark, checkpoint, "held").where("n > 0").select("key", F.col("flushes").alias("flush"), "n", "chars", "first", F.lit("held").alias("why"))


def in_slices(rows: DataFrame, order: str, n: int) -> list[DataFrame]:
    """rows cut by quantiles of a time column into n consecutive slices; null ones go with the first."""
    at = F.col(order).cast("timestamp").cast("double")
    cuts = rows.select(at.alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 0.001)
    edges = [None, *cuts, None]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        keep = F.lit(True)
        if low is not None:
            keep = keep & (at > low)
        if high is not None:
            keep = keep & ((at <= high) | (at.isNull() if low is None else F.lit(False)))
        out.append(rows.where(keep))
    return out
