"""Exact top-k search by exhaustive term-at-a-time accumulation.

A term is a vector dimension, its posting list the values that candidates have
there. For each query, every term with a non-zero weight scatters weight times
posting values into a dense array of scores, one per candidate of a tile; a
partition selection keeps what can be among the k best, and tiles are merged.

Candidates are packed into block files in the shared folder, in the narrowest
type that holds them. A task holds a stripe of queries and their best so far,
and streams all blocks past them. So what is shuffled is the queries alone, and
a task's memory is a stripe and a block, whatever the size of the table; what is
computed and read is queries times candidates, as in any exhaustive search.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm import common
from fieldloom.session import Workspace

#: Queries that a task holds at a time, at most, and the least that are worth a task.
QUERY_STRIPE, LEAST_STRIPE = 4096, 64
CANDIDATE_BLOCK = 16_384
#: Candidates whose scores are held at a time, so that they stay in cache.
TILE = 4096
#: Number types of a block, narrowest first; f8 holds whole numbers beyond 2 ** 53.
KINDS = ("<i2", "<i4", "<i8", "<f8")
_HEAD = "<BIQ"


def _kind_of(tops: np.ndarray, whole_floats: bool) -> np.ndarray:
    """Per vector the place in KINDS of the narrowest type for its largest absolute component."""
    wide = 2.0**53 if whole_floats else np.inf
    return np.digitize(tops, [2.0**15, 2.0**31, wide])


class Blocks:
    """Vectors gathered by length and number type; full ones are given out as (dims, kind, ids, values)."""

    def __init__(self, size: int):
        self.size, self.held = size, {}

    def add(self, ids: np.ndarray, vectors: pa.ListArray):
        offsets = vectors.offsets.to_numpy()
        flat = vectors.values.to_numpy(zero_copy_only=False)
        lengths = np.diff(offsets)
        for dims in np.unique(lengths):
            at = np.flatnonzero(lengths == dims)
            values = flat[offsets[at][:, None] + np.arange(dims)]
            tops = np.maximum(np.abs(values.max(axis=1, initial=0).astype(float)), np.abs(values.min(axis=1, initial=0).astype(float)))
            kinds = _kind_of(tops, flat.dtype.kind == "f")
            for kind in np.unique(kinds):
                mine = kinds == kind
                yield from self._put(int(dims), int(kind), ids[at[mine]], values[mine].astype(KINDS[kind]))

    def _put(self, dims: int, kind: int, ids: np.ndarray, values: np.ndarray):
        parts = self.held.setdefault((dims, kind), [])
        parts.append((ids, values))
        if sum(len(i) for i, _ in parts) >= self.size:
            ids, values = (np.concatenate(x) for x in zip(*parts, strict=True))
            whole = len(ids) - len(ids) % self.size
            for a in range(0, whole, self.size):
                yield dims, kind, ids[a : a + self.size], values[a : a + self.size]
            self.held[dims, kind] = [(ids[whole:], values[whole:])] if whole < len(ids) else []

    def rest(self):
        for (dims, kind), parts in self.held.items():
            if parts:
                yield dims, kind, *(np.concatenate(x) for x in zip(*parts, strict=True))


def _packed(kind: int, ids: np.ndarray, values: np.ndarray) -> bytes:
    return struct.pack(_HEAD, kind, values.shape[1], len(ids)) + ids.astype("<i8").tobytes() + np.ascontiguousarray(values.T).tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """ids and postings (dims x candidates)."""
    kind, dims, n = struct.unpack_from(_HEAD, data)
    at = struct.calcsize(_HEAD)
    return np.frombuffer(data, "<i8", n, at), np.frombuffer(data, KINDS[kind], n * dims, at + 8 * n).reshape(dims, n)


def _top(values: np.ndarray) -> int:
    return max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))


def _as(values: np.ndarray, kind) -> np.ndarray:
    """values in a number type, or as Python's integers, which have no bound."""
    if kind is object:
        return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)
    return np.ascontiguousarray(values.astype(kind))


def accumulate(query_values: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Scores of one query: its terms one at a time over the postings (dims x candidates)."""
    scores = np.zeros(postings.shape[1], postings.dtype)
    for term in np.flatnonzero(query_values):
        scores += query_values[term] * postings[term]
    return scores


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score descending, id ascending), in that order."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores > least)
        ties = np.flatnonzero(scores == least)
        ties = ties[np.argsort(ids[ties], kind="stable")[: k - len(places)]]
        places = np.concatenate([places, ties])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places].astype(np.int64)))]


class Stripe:
    """Queries of one length and number type, and the best of what has gone past them."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int):
        self.ids, self.values, self.k, self.top = ids, values, k, _top(values)
        self.best_ids = [np.empty(0, np.int64)] * len(ids)
        self.best_scores = [np.empty(0, np.int64)] * len(ids)

    def pass_by(self, ids: np.ndarray, postings: np.ndarray) -> None:
        # the narrowest numbers that no sum can leave
        reach = self.top * _top(postings) * max(1, len(postings))
        kind = np.int32 if reach < 2**31 else np.int64 if reach < 2**63 else object
        queries = _as(self.values, kind)
        for a in range(0, len(ids), TILE):
            tile, tile_ids = _as(postings[:, a : a + TILE], kind), ids[a : a + TILE]
            for j, own in enumerate(self.ids):
                scores = accumulate(queries[j], tile)
                best = self.best_scores[j]
                fit = tile_ids != own
                if len(best) == self.k:
                    fit &= (scores >= best[-1]).astype(bool)
                at = np.flatnonzero(fit)
                if len(at):
                    at = at[select(scores[at], tile_ids[at], self.k)]
                    more = scores[at] if kind is object else scores[at].astype(np.int64)
                    all_ids, all_scores = np.concatenate([self.best_ids[j], tile_ids[at]]), np.concatenate([best, more])
                    keep = select(all_scores, all_ids, self.k)
                    self.best_ids[j], self.best_scores[j] = all_ids[keep], all_scores[keep]


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", values_col: str = "values", stripe: int = QUERY_STRIPE, block: int = CANDIDATE_BLOCK) -> DataFrame:
    """Per query its k best candidates: query_id, rank, vec_id, score.

    Both frames hold arrays of whole numbers, of an integer type or as doubles;
    ids must be of an integer type (TypeError otherwise). The score is the inner
    product, exact whatever its size; one beyond 64 bits is ranked by its value
    and shown as the nearest number of 64 bits. Ties go to the smaller id, then
    to equal rows. A candidate with the query's id is the query's own row and
    left out. Query rows that share an id count once, with the least of their
    vectors; candidate rows that share an id all compete. Vectors meet only
    vectors of their own length; empty ones score 0. Rows with a null id, a null
    vector or a null, infinite or NaN value take no part. A query without
    candidates gives no row, and neither does an empty table.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "topk")
    for df in (vectors, queries):
        if not isinstance(df.select(common.named(id_col)).schema[0].dataType, T.IntegralType):
            raise TypeError(f"{id_col} must be of an integer type")

    def pick(df: DataFrame) -> DataFrame:
        kind = df.select(common.named(values_col)).schema[0].dataType
        number = "bigint" if isinstance(kind.elementType, T.IntegralType) else "double"
        rows = df.select(common.named(id_col).cast("long").alias("vec_id"), common.named(values_col).cast(f"array<{number}>").alias("values"))
        bad = F.exists("values", lambda x: x.isNull() | (F.lit(False) if number == "bigint" else F.isnan(x) | (F.abs(x) == float("inf"))))
        return rows.where(F.col("vec_id").isNotNull() & F.col("values").isNotNull() & ~bad)

    folder = work.uri("blocks")
    told = pa.schema([("uri", pa.string()), ("dims", pa.int32())])

    def pack(batches):
        blocks = Blocks(block)

        def put(dims, kind, ids, values):
            # a name of its own, told by the row: files of a lost attempt are in no manifest
            uri = f"{folder}/block-{uuid.uuid4().hex}"
            common.write_file(uri, _packed(kind, ids, values))
            return pa.record_batch([pa.array([uri]), pa.array([dims], pa.int32())], told)

        for batch in batches:
            for full in blocks.add(batch.column(0).to_numpy(), batch.column(1)):
                yield put(*full)
        for full in blocks.rest():
            yield put(*full)

    work.save(pick(vectors).mapInArrow(pack, "uri string, dims int"), "manifest")
    manifest = work.uri("manifest")
    asked = work.save(pick(queries).groupBy("vec_id").agg(F.min("values").alias("values")), "queries")
    n_asked = asked.count()
    stripes = max(1, -(-n_asked // stripe), min(n_asked // LEAST_STRIPE, 2 * spark.sparkContext.defaultParallelism))
    found = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches):
        waiting: list[Stripe] = []
        held = Blocks(stripe)
        for batch in batches:
            for _, _, ids, values in held.add(batch.column(0).to_numpy(), batch.column(1)):
                yield from finish([Stripe(ids, values, k)])
        waiting = [Stripe(ids, values, k) for _, _, ids, values in held.rest()]
        if waiting:
            yield from finish(waiting)

    def finish(waiting: list[Stripe]):
        fs, path = pafs.FileSystem.from_uri(manifest)
        files = pads.dataset(path, filesystem=fs, format="parquet")
        lengths = {s.values.shape[1] for s in waiting}
        for listed in files.to_batches(columns=["uri", "dims"]):
            for uri, dims in zip(*(x.to_pylist() for x in listed.columns), strict=True):
                if dims in lengths:
                    ids, postings = _unpacked(common.read_file(uri))
                    for s in waiting:
                        if s.values.shape[1] == dims:
                            s.pass_by(ids, postings)
        for s in waiting:
            n = [len(x) for x in s.best_ids]
            scores = [max(-(2**63), min(2**63 - 1, int(x))) for x in np.concatenate(s.best_scores)]
            rank = np.concatenate([np.arange(1, m + 1) for m in n])
            yield pa.record_batch([pa.array(np.repeat(s.ids, n)), pa.array(rank, pa.int32()), pa.array(np.concatenate(s.best_ids)), pa.array(scores, pa.int64())], found)

    return asked.repartition(stripes, "vec_id").mapInArrow(search, "query_id long, rank int, vec_id long, score long")


def quantise(embedding: str = "embedding", scale: int = 64):
    """floor(scale * x) of every component, x as double, as whole numbers in doubles, exact whatever their size.

    Null where the vector is null, or where scale * x of a component is null or not finite.
    """
    x = F.transform(common.named(embedding).cast("array<double>"), lambda v: v * F.lit(float(scale)))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    # from 2 ** 53 on, every double is a whole number
    return F.when(~bad, F.transform(x, lambda v: F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)))
