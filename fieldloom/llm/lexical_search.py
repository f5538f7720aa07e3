"""Ranked lexical search by WAND over document shards.

Documents are packed, as they lie, into shards that hold the postings of the
terms asked for; nothing is shuffled but counts. A task takes its shards one
after the other past all queries of a block. Within a shard a query's terms
stand at their next documents, in that order; their largest impacts are summed
until they pass the least score that still counts, and the term there is the
pivot: no document before its own can be among the best, so all terms move
there at once. A document that the first term and the pivot share is scored.
The least score that counts comes from the query's heap, which goes from shard
to shard of the task; the tasks' heaps are merged at the end.

Queries are asked in blocks of bounded size, so what workers are sent is bounded
too, whatever the number of queries.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm import common
from fieldloom.session import Workspace

#: Bounds of a shard; of a block of queries (terms, each query's counted on its own).
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1_000_000
BLOCK_TERMS = 400_000
#: Heaps of so many tasks meet in a first merge.
MERGE_FAN = 64


def _byte_table() -> bytes:
    """Letters and digits, A-Z as a-z, and all bytes of other scripts stay; the rest becomes a blank."""
    kept = {c: c for c in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]} | {c: c + 32 for c in range(0x41, 0x5B)}
    return bytes(kept.get(c, 0x20) for c in range(256))


TABLE = _byte_table()


def terms_in(text: str | None) -> list[bytes]:
    """The terms of a whole text in order."""
    return common.utf8(text or "").translate(TABLE).split()


def impacts(weights: np.ndarray, tfs: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    """weight * (1000000000 tf div (1000 tf + 8 m)), in whole numbers."""
    return weights * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * slopes))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Postings:
    """Postings of one shard by term: places of documents in ascending order and their impacts."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, docs: np.ndarray, scores: np.ndarray):
        self.at = {t: i for i, t in enumerate(terms.tolist())}
        ends = np.cumsum(counts)
        starts = ends - counts
        self.tops = np.maximum.reduceat(scores, starts).tolist() if len(terms) else []
        self.lists: list = [None] * len(terms)
        self.bounds = list(zip(starts.tolist(), ends.tolist(), strict=True))
        self.docs, self.scores = docs, scores

    def of(self, term: int) -> tuple[list[int], list[int], int] | None:
        i = self.at.get(term)
        if i is None or self.tops[i] == 0:
            return None
        if self.lists[i] is None:
            a, b = self.bounds[i]
            self.lists[i] = (self.docs[a:b].tolist(), self.scores[a:b].tolist(), self.tops[i])
        return self.lists[i]


def wand(query: list[int], postings: Postings, k: int, beaten: int = 0) -> list[tuple[int, int]]:
    """(score, place) of the shard's k best documents scoring above ``beaten``, best first, ties by place.

    Documents are met in ascending order, so an equal score never displaces one.
    """
    held = [p for p in map(postings.of, query) if p is not None]
    docs, scores, tops = ([p[i] for p in held] for i in range(3))
    at = [0] * len(held)
    standing = sorted((d[0], i) for i, d in enumerate(docs))
    heap: list[tuple[int, int]] = []
    while standing:
        reach = 0
        for n, (pivot, i) in enumerate(standing):  # noqa: B007  n and pivot are read below
            reach += tops[i]
            if reach > beaten:
                break
        else:
            break
        moved = []
        if standing[0][0] == pivot:
            score = gone = 0
            for doc, i in standing:
                if doc != pivot:
                    break
                score += scores[i][at[i]]
                gone += 1
                at[i] += 1
                if at[i] < len(docs[i]):
                    moved.append((docs[i][at[i]], i))
            if score > beaten:
                (heapq.heappush if len(heap) < k else heapq.heapreplace)(heap, (score, -pivot))
                if len(heap) == k:
                    beaten = heap[0][0]
        else:
            gone = n
            for doc, i in standing[:n]:
                if doc < pivot:
                    at[i] = bisect_left(docs[i], pivot, at[i])
                if at[i] < len(docs[i]):
                    moved.append((docs[i][at[i]], i))
        standing = moved + standing[gone:]
        standing.sort()
    return [(s, -p) for s, p in sorted(heap, reverse=True)]


def _query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = queries.select(common.named(id_col).cast("long").alias("item"), common.named(text_col).alias("text"))

    def split(batches):
        for batch in batches:
            for item, text in zip(common.column(batch, "item"), common.column(batch, "text"), strict=True):
                if found := list(set(terms_in(text))):
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["item", "term"])

    return rows.mapInArrow(split, "item long, term binary").distinct()


def _blocks(asked: DataFrame, bound: int) -> tuple[DataFrame, int]:
    """asked with a block number, and how many: none above twice the bound, but for a query that is so alone."""
    n = max(1, -(-asked.count() // bound))
    while True:
        dealt = asked.withColumn("block", F.pmod(F.xxhash64("item", F.lit(n)), F.lit(n)))
        sizes = dealt.groupBy("block").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("item", F.lit(-(2**63)))).alias("items"))
        if sizes.where((F.col("n") > 2 * bound) & (F.col("items") > 1)).isEmpty():
            return dealt, n
        n *= 2


class _Shard:
    """Documents gathered until a shard is full; full() gives it as a row and starts anew."""

    def __init__(self):
        self.ids, self.lens, self.terms, self.tfs, self.docs = [], [], [], [], []

    def add(self, doc_id: int | None, n: int, counts: Counter) -> bool:
        self.docs += [len(self.ids)] * len(counts)
        self.terms += counts.keys()
        self.tfs += counts.values()
        self.ids.append(doc_id)
        self.lens.append(n)
        return len(self.ids) >= SHARD_DOCS or len(self.terms) >= SHARD_POSTINGS

    def full(self) -> pa.RecordBatch:
        # places in the order of ids, null last, so that ties go by place
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        terms, tfs, docs = np.array(self.terms, np.int64), np.array(self.tfs, np.int64), place[np.array(self.docs, np.int64)]
        by = np.lexsort((docs, terms))
        kinds, counts = np.unique(terms, return_counts=True)
        whole = [
            pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64())), pa.array([[self.lens[i] for i in order]], pa.list_(pa.int64())),
            pa.array([kinds.tolist()], pa.list_(pa.int32())), pa.array([counts.tolist()], pa.list_(pa.int32())),
            pa.array([docs[by].astype("<i4").tobytes()], pa.binary()), pa.array([tfs[by].astype("<i4").tobytes()], pa.binary()),
        ]
        self.__init__()
        return pa.RecordBatch.from_arrays(whole, names=_SHARD_NAMES)


_SHARD_NAMES = ["ids", "lens", "terms", "dfs", "docs", "tfs"]
_SHARD_SCHEMA = "ids array<long>, lens array<long>, terms array<int>, dfs array<int>, docs binary, tfs binary"


def wand_search(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Per query its k best documents with a score above 0: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII,
    A-Z as a-z, over whole texts; a null text has none. A document without a
    term counts nowhere. All statistics are over all documents with a term.
    Scores are whole numbers; equal ones go by ascending id, a null id last.

    Rows of docs that share an id all compete. Rows of queries that share an id
    are one query of all their terms; a null id is one of its own. Ids must be
    of an integer type (TypeError otherwise). Queries without a term or without
    a document give no rows, and so do empty tables. Other columns go.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "wand")
    for df, name in ((docs, id_col), (queries, query_id)):
        if not isinstance(df.select(common.named(name)).schema[0].dataType, T.IntegralType):
            raise TypeError(f"{name} must be of an integer type")
    rows = docs.select(common.named(id_col).cast("long").alias("id"), common.named(text_col).alias("text"))
    asked = work.save(_query_terms(queries, query_id, query_text), "asked")
    asked, n_blocks = _blocks(asked, block_terms)
    parts = [_search_block(work, rows, asked.where(F.col("block") == b), k, f"block{b}") for b in range(n_blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _search_block(work: Workspace, rows: DataFrame, asked: DataFrame, k: int, name: str) -> DataFrame:
    """The results of one block of queries, whose terms are few enough to be sent to every worker."""
    by_item: dict[int | None, list[bytes]] = {}
    for item, term in asked.select("item", "term").toLocalIterator():
        by_item.setdefault(item, []).append(bytes(term))
    vocabulary = {t: i for i, t in enumerate(sorted({t for ts in by_item.values() for t in ts}))}
    items = sorted(by_item, key=lambda x: (x is None, x or 0))
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, get = _Shard(), sent.value.get
        for batch in batches:
            for doc_id, text in zip(common.column(batch, "id"), common.column(batch, "text"), strict=True):
                if words := terms_in(text):
                    counts = Counter(map(get, words))
                    counts.pop(None, None)
                    if shard.add(doc_id, len(words), counts):
                        yield shard.full()
        if shard.ids:
            yield shard.full()

    shards = work.save(rows.mapInArrow(common.tidy(index), _SHARD_SCHEMA), f"{name}_shards")
    n_docs, length = shards.agg(F.sum(F.size("lens")), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    pairs = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p")).groupBy("p.terms").agg(F.sum("p.dfs").alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    # one row a term of the block
    for term, df in pairs.toLocalIterator():
        weights[term] = weight(n_docs, df)
    told = context.broadcast((weights, [[vocabulary[t] for t in by_item[i]] for i in items]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = told.value
        best: list[list[tuple[int, bool, int]]] = [[] for _ in queries]
        for batch in batches:
            for ids, lens, terms, dfs, places, tfs in zip(*(common.column(batch, c) for c in _SHARD_NAMES), strict=True):
                terms, dfs = np.array(terms, np.int64), np.array(dfs, np.int64)
                slopes = np.array([10 + 90 * n * n_docs // length for n in lens], np.int64)
                places = np.frombuffer(places, "<i4").astype(np.int64)
                postings = Postings(terms, dfs, places, impacts(np.repeat(weights[terms], dfs), np.frombuffer(tfs, "<i4").astype(np.int64), slopes[places]))
                for i, query in enumerate(queries):
                    # an equal score can still count, by a lesser id
                    beaten = -best[i][-1][0] - 1 if len(best[i]) == k else 0
                    if fresh := wand(query, postings, k, beaten):
                        best[i] = sorted(best[i] + [(-s, ids[p] is None, ids[p] or 0) for s, p in fresh])[:k]
        at = [i for i, own in enumerate(best) for _ in own]
        flat = [x for own in best for x in own]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([None if none else d for _, none, d in flat], pa.int64()), pa.array([-s for s, _, _ in flat], pa.int64())], names=["query", "doc_id", "score"])

    heaps = work.save(shards.mapInArrow(common.tidy(search), "query int, doc_id long, score long").withColumn("fan", F.pmod(F.spark_partition_id(), F.lit(MERGE_FAN))), f"{name}_heaps")
    merged = _best(heaps, k, "query", "fan").drop("rank")
    ranked = _best(merged, k, "query")
    names = rows.sparkSession.createDataFrame(list(enumerate(items)), "query int, item_id long")
    return ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")


def _best(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
