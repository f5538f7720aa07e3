"""Sharding by histogram sort.

Documents are ordered by a key, a hash of the text, so that equal texts lie
together, and splitters cut that order into shards of nearly equal bytes. They
are found by counting: each round counts the exact bytes below a set of probes,
in all partitions at once, and keeps for each splitter the two probes around its
goal, until one meets the tolerance. Only then are rows exchanged, once.

A probe falls between groups of equal texts, never within one. So that large
groups don't keep splitters from their goals, groups above the tolerance (no
more than n_shards / tolerance can be) are placed first, largest first, each in
the shard that is emptiest, and the goals are what then is missing in each
shard. Only a group larger than a whole shard is dealt out by row.
"""

from __future__ import annotations

import bisect
import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm import common
from fieldloom.session import Workspace

KEY_BITS = 62
TOLERANCE = 0.002
PROBES = 1024
#: Rows that one task numbers, about.
PART_ROWS = 1 << 20
#: Bins into which a group larger than a shard is dealt, for each shard it fills.
BINS = 8
_SUB = 1 << 24


def histogram(rows: DataFrame, cuts: list[int]) -> list[int]:
    """Bytes of the keys from each cut to the next, the first entry being those below all cuts.

    Each partition counts its own rows; at most a count per cut and partition is
    exchanged. rows: key, size.
    """
    edges = np.array(cuts, np.int64)
    schema = pa.schema([("bin", pa.int32()), ("bytes", pa.int64())])

    def count(batches):
        sizes = np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            np.add.at(sizes, np.searchsorted(edges, batch.column(0).to_numpy(), side="right"), batch.column(1).to_numpy())
        some = np.flatnonzero(sizes)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(sizes[some])], schema)

    counted = rows.select("key", "size").mapInArrow(count, "bin int, bytes long")
    found = {r[0]: r[1] for r in counted.groupBy("bin").agg(F.sum("bytes")).collect()}
    return [found.get(i, 0) for i in range(len(cuts) + 1)]


def find_splitters(rows: DataFrame, goals: list[float], tolerance: float, probes: int = PROBES) -> list[int]:
    """A key for each ascending goal such that the bytes of all smaller keys meet the goal.

    They do so within ``tolerance``, or as near as a cut between two keys can
    come. rows: key, size. The driver holds at most ``probes`` counts per goal.
    """
    # per goal, the largest key known to be at or below it and the least above it, each with the bytes below the key
    low, high = [(0, 0)] * len(goals), [(1 << KEY_BITS, None)] * len(goals)
    found: list[int | None] = [None] * len(goals)
    while None in found:
        asked: set[int] = set()
        for g in range(len(goals)):
            if found[g] is None:
                a, b = low[g][0], high[g][0]
                asked.update(range(a, b, max(1, -(-(b - a) // (probes + 1)))))
        cuts = sorted(asked)
        sizes = histogram(rows, cuts)
        below = list(itertools.accumulate(sizes[:-1]))
        for g, goal in enumerate(goals):
            if found[g] is not None:
                continue
            # bytes grow with the cut, so the goal lies between two neighbouring cuts
            at = bisect.bisect_right(below, goal)
            if at and cuts[at - 1] >= low[g][0]:
                low[g] = (cuts[at - 1], below[at - 1])
            if at < len(cuts) and cuts[at] < high[g][0]:
                high[g] = (cuts[at], below[at])
            elif high[g][1] is None:
                high[g] = (high[g][0], sum(sizes))
            best = min(low[g], high[g], key=lambda x: abs(x[1] - goal))
            if abs(best[1] - goal) <= tolerance or high[g][0] - low[g][0] <= 1:
                found[g] = best[0]
    return [x for x in found if x is not None]


def spread(sizes: list[tuple[int, object]], n: int) -> tuple[dict, list[int]]:
    """Where each of (bytes, name) goes, largest first to the emptiest of n shards, and what the shards then hold."""
    heap = [(0, k) for k in range(n)]
    at = {}
    for size, name in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, k = heapq.heappop(heap)
        at[name] = k
        heapq.heappush(heap, (load + size, k))
    return at, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def fill(loads: list[int], more: int) -> list[float]:
    """What each shard gets of ``more`` bytes so that the least full ones end equally full."""
    order = sorted(loads)
    for k in range(1, len(order) + 1):
        level = (more + sum(order[:k])) / k
        if k == len(order) or level <= order[k]:
            break
    return [max(0.0, level - x) for x in loads]


def shard_documents(docs: DataFrame, n_shards: int, tolerance: float = TOLERANCE, part_rows: int = PART_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size (bytes of the text plus 1), text_crc32, shard, slot.

    Shard totals of ``size`` differ from equal parts by at most ``tolerance`` of
    a part at either end, while equal texts share a shard. Where groups of equal
    texts are too large for that, shards are as even as placing the largest
    first makes them (at most the largest group above an equal part). A group
    above an equal part itself is spread over shards by its ids, by its rows
    where ids repeat. Slots count from 0 without gaps within each shard. Null
    texts have size 1; ids may be null, repeated or of any type. An empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "shards")
    text = F.coalesce(common.named(text_col), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        common.named(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS).alias("key"),
        F.xxhash64(common.named(id_col)).alias("tie"),
    )
    rows = work.save(rows, "rows")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    mean = total / n_shards
    # at most n_shards / tolerance groups have so many bytes
    heavy = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where(F.col("bytes") > tolerance * mean).collect()
    whole = [(r.bytes, (r.key, 0)) for r in heavy if r.bytes <= mean]
    dealt: dict[int, tuple[int, bool]] = {}
    wide = {r.key: max(2, BINS * round(r.bytes / mean)) for r in heavy if r.bytes > mean}
    for by_row in (False, True):
        left = {k: bins for k, bins in wide.items() if k not in dealt}
        if left:
            table = spark.createDataFrame([(k, bins, by_row) for k, bins in left.items()], "key long, bins int, by_row boolean")
            found = rows.join(F.broadcast(table), "key").groupBy("key", _bin()).agg(F.sum("size").alias("bytes")).collect()
            for k, bins in left.items():
                parts = [(r.bytes, (k, r.bin)) for r in found if r.key == k]
                if by_row or max(parts)[0] <= 3 * sum(p[0] for p in parts) / bins:
                    dealt[k] = (bins, by_row)
                    whole += parts
    at, loads = spread(whole, n_shards)
    goals = list(itertools.accumulate(fill(loads, total - sum(loads))))[:-1]

    groups = [(r.key, *dealt.get(r.key, (1, False)), max(1, -(-r.n // part_rows))) for r in heavy]
    heavy_rows = spark.createDataFrame(groups, "key long, bins int, by_row boolean, subs int")
    units = spark.createDataFrame([(k, b, shard, unit) for unit, ((k, b), shard) in enumerate(at.items())], "key long, bin int, heavy_shard int, unit long")
    light = rows.join(F.broadcast(heavy_rows), "key", "left_anti")
    cuts = find_splitters(light, goals, tolerance * mean / 2) if goals else []
    # both tables have at most a row per heavy group and bin
    placed = rows.join(F.broadcast(heavy_rows), "key", "left").withColumn("bin", _bin()).join(F.broadcast(units), ["key", "bin"], "left")
    shard = F.coalesce("heavy_shard", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("key"))) if cuts else F.lit(0))
    # parts that one task numbers: even ranges of the key, which is a hash; heavy groups have their own
    bits = (n // part_rows).bit_length()
    sub = F.pmod(F.xxhash64("row_id"), F.col("subs"))
    part = F.coalesce(F.col("unit") * _SUB + sub, F.lit(1 << 38) + F.shiftright("key", KEY_BITS - bits))
    placed = work.save(placed.select("row_id", "doc_id", "size", "text_crc32", "key", "tie", shard.cast("int").alias("shard"), part.alias("part")), "placed")
    bases, taken = [], dict.fromkeys(range(n_shards), 0)
    for r in sorted(placed.groupBy("shard", "part").count().collect()):
        bases.append((r[0], r[1], taken[r[0]]))
        taken[r[0]] += r[2]
    base = spark.createDataFrame(bases, "shard int, part long, base long")
    order = Window.partitionBy("shard", "part").orderBy("key", "tie", "row_id")
    slot = F.row_number().over(order) - 1 + F.col("base")
    return placed.join(base, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def _bin():
    """The bin of a heavy group's row; null for others."""
    by = F.when(F.col("by_row"), F.xxhash64("row_id")).otherwise(F.col("tie"))
    return F.pmod(by, F.col("bins")).cast("int").alias("bin")
