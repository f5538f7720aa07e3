"""Histogram sort against a placement computed in one piece, shard by shard."""

import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import sharding


def brute(groups, n_shards, tolerance):
    """(heavy key -> shard, bytes of light keys wanted in each shard): groups are (key, bytes)."""
    total = sum(b for _, b in groups)
    mean = total / n_shards
    heavy = sorted(((b, k) for k, b in groups if b > tolerance * mean), key=lambda x: (-x[0], x[1]))
    heap, at, loads = [(0, s) for s in range(n_shards)], {}, [0] * n_shards
    for size, key in heavy:
        load, s = heapq.heappop(heap)
        at[key], loads[s] = s, load + size
        heapq.heappush(heap, (load + size, s))
    # water poured over the loads until all light bytes are in
    more = total - sum(loads)
    low, high = 0.0, float(max(loads) + more + 1)
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(max(0.0, level - x) for x in loads) < more else (low, level)
    return at, [max(0.0, high - x) for x in loads], mean


@pytest.mark.parametrize(("seed", "n_shards", "copies"), [(1, 4, 1), (2, 8, 12), (3, 5, 30), (4, 16, 3)])
def test_every_shard_is_where_one_piece_would_put_it(spark, seed, n_shards, copies):
    rng = random.Random(seed)
    texts = [None, "", *(f"text {i} " + "x" * rng.randint(0, 300) for i in range(300))]
    table = [(i, t) for i, t in enumerate(t for t in texts for _ in range(rng.choice([1, 1, 1, copies])))]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    key = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 64 - sharding.KEY_BITS)
    keys = {r[0]: r[1] for r in df.select("doc_id", key).collect()}
    sizes = {i: len((t or "").encode()) + 1 for i, t in table}
    groups = {}
    for i, _ in table:
        groups[keys[i]] = groups.get(keys[i], 0) + sizes[i]
    tolerance = 0.05
    at, wanted, mean = brute(sorted(groups.items()), n_shards, tolerance)
    assert all(b <= mean for b in groups.values())
    got = {r["doc_id"]: (r["shard"], r["slot"], r["size"]) for r in sharding.shard_documents(df, n_shards, tolerance, part_rows=50).collect()}
    assert {i: s for i, (_, _, s) in got.items()} == sizes
    assert all(got[i][0] == at[keys[i]] for i, _ in table if keys[i] in at)
    light = sorted((keys[i], got[i][0]) for i, _ in table if keys[i] not in at)
    # light keys lie in the shards in their order, and the bytes below each cut meet the goal as near as a cut can
    assert [s for _, s in light] == sorted(s for _, s in light)
    ordered = sorted((k, b) for k, b in groups.items() if k not in at)
    edges = [0, *itertools.accumulate(b for _, b in ordered)]
    for shard, goal in enumerate(itertools.accumulate(wanted[:-1])):
        below = sum(groups[k] for k in {k for k, s in light if s <= shard})
        assert abs(below - goal) <= max(tolerance * mean / 2, min(abs(e - goal) for e in edges)) + 1e-6
    for shard in range(n_shards):
        assert sorted(s for sh, s, _ in got.values() if sh == shard) == list(range(sum(sh == shard for sh, _, _ in got.values())))
