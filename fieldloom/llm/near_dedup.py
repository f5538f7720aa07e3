"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Every shingle (five words) of a text sends out a Poisson process of arrivals
whose rate is the shingle's weight; each arrival falls on one of K registers,
and a register keeps the shingle that came first. Two texts agree on a register
with the probability Jaccard similarity of their weighted shingles. A shingle's
process ends as soon as its next arrival is later than every register's first.
Links are told by the Jaccard similarity of shingle sets, so here each distinct
shingle weighs 1, however often it occurs: the probability Jaccard similarity is
then that very number, and candidates and links go by one measure.

Registers are cut into bands, and texts that share a band are candidates. Of
the candidates, every link is found that joins different classes:

1. In each bucket all texts are compared with the bucket's least text (a star,
   so a bucket of any size costs one comparison per member).
2. Where a bucket still holds several classes, its texts, with those of buckets
   that overlap it, form a family. Families are compared in blocks of bounded
   size, members outside the largest class against all others, by an inverted
   index over their shingles; only links between different classes come out.

Links are exact: the Jaccard similarity of the sets of 64-bit shingle ids.
Joins whose sides grow with the corpus ask for a sort-merge join at every size,
so that a small input runs the same plan as a large one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import common
from fieldloom.llm.components import components
from fieldloom.session import Workspace

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 24, 6
BLOCK = 192


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str], memo: common.Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit id of each run of ``width`` words; of the whole text if it is shorter; none of an empty one."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total = (total ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * i + 1)
    return mix64(total)


class Shingler:
    """Shingle ids of texts: lower case, words between blanks."""

    def __init__(self):
        self.memo = common.Memo(300_000)

    def shingles(self, texts: list[str], width: int) -> list[np.ndarray]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        words = [t.lower().split() for t in texts]
        self.memo.learn({w for ws in words for w in ws}, lambda new: [digest(common.utf8(w)) for w in new])
        return [shingle_hashes(word_hashes(ws, self.memo), width) for ws in words]


def prob_min_hash(sets: list[np.ndarray], weights: list[np.ndarray], k: int) -> np.ndarray:
    """Signatures (len(sets) x k) of weighted element sets; an empty set's registers are 0."""
    first = np.full(len(sets) * k, np.inf)
    signature = np.zeros(len(sets) * k, np.uint64)
    element = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    weight = np.concatenate(weights) if weights else np.empty(0)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    time, turn = np.zeros(len(element)), 0
    while len(element):
        draw = mix64(element + np.uint64((2 * turn + 1) * 0x9E3779B97F4A7C15 % 2**64))
        u = ((draw >> np.uint64(11)).astype(np.float64) + 1.0) / 2.0**53
        time = time - np.log(u) / weight
        place = (mix64(draw ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(k)).astype(np.int64) + owner * k
        before = first[place]
        np.minimum.at(first, place, time)
        won = (time == first[place]) & (time < before)
        signature[place[won]] = element[won]
        alive = time < first.reshape(-1, k).max(axis=1)[owner]
        element, weight, owner, time = element[alive], weight[alive], owner[alive], time[alive]
        turn += 1
    return signature.reshape(-1, k)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band (len(signatures) x bands), different between bands."""
    parts = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(rows):
        key = mix64((key ^ parts[:, :, i]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i))
    return key.astype(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct values."""
    if not len(a) or not len(b):
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def block_links(queries: list[tuple[int, int, np.ndarray]], others: list[tuple[int, int, np.ndarray]], least: float) -> list[tuple[int, int]]:
    """Links (node, node) of similarity ``least`` or more between (node, class, set) of the two sides.

    Links within a class are left out, as are those between classes that an
    earlier link of the result has joined.
    """
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while c in parent:
            c = parent[c]
        return c

    sizes = np.array([len(s) for _, _, s in others], np.int64)
    flat = np.concatenate([s for _, _, s in others]) if others else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(others)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    links = []
    for node, label, mine in queries:
        if not len(mine):
            continue
        start, stop = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
        n = stop - start
        at = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(others))
        near = np.flatnonzero(shared >= least * (len(mine) + sizes - shared))
        for j in near:
            other, other_label, _ = others[j]
            if other != node and root(label) != root(other_label):
                parent[root(label)] = root(other_label)
                links.append((node, other))
    return links


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, similarity: float = SIMILARITY, bands: int = BANDS, band_rows: int = BAND_ROWS, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, class_id (least doc_id of its class), class_size, kept (one row of the class), row_id, text_key (SHA-256).

    Equal texts are of one class; so are texts joined by links of ``similarity``
    or more. A text of fewer words than a shingle has one shingle, its words; a
    null or empty text has none and equals only other empty texts. The row kept
    has the class's least doc_id, a null one being below all. Ids may be of any
    type that has an order; rows that share one stay apart by row_id. An empty
    table gives no rows; other columns are not read.
    """
    work = Workspace(docs.sparkSession, "near")
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), common.named(id_col).alias("doc_id"), F.coalesce(common.named(text_col), F.lit("")).alias("text"))
    return _classes(work.save(rows, "texts_read"), width, similarity, bands, band_rows, block, work)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, similarity: float = SIMILARITY, bands: int = BANDS, band_rows: int = BAND_ROWS, block: int = BLOCK) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each near-duplicate class.

    Nulls, empty texts, ties and repeated rows are as in near_classes. An empty
    table gives no rows. Columns may have any names.
    """
    work = Workspace(docs.sparkSession, "near")
    base = common.numbered(docs, work)
    rows = base.select("row_id", common.place(docs, id_col).alias("doc_id"), F.coalesce(common.place(docs, text_col), F.lit("")).alias("text"))
    stay = _classes(rows, width, similarity, bands, band_rows, block, work).where("kept").select("row_id")
    return common.restored(base.join(stay, "row_id", "left_semi"), docs)


def _classes(read: DataFrame, width: int, similarity: float, bands: int, band_rows: int, block: int, work: Workspace) -> DataFrame:
    """near_classes over a written table of row_id, doc_id, text (not null)."""
    k = bands * band_rows

    def sign(batches):
        shingler = common.per_process("shingler", Shingler)
        for batch in batches:
            texts = common.column(batch, "text")
            for a, b in common.slices(texts):
                sets = [np.unique(s) for s in shingler.shingles(texts[a:b], width)]
                keys = band_keys(prob_min_hash(sets, [np.ones(len(s)) for s in sets], k), bands, band_rows)
                shown = [list(x) if len(s) else [] for x, s in zip(keys, sets, strict=True)]
                digests = [hashlib.sha256(common.utf8(t)).digest() for t in texts[a:b]]
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(digests, pa.binary()), pa.array(shown, pa.list_(pa.int64()))], names=["row_id", "doc_id", "text_key", "bands"])

    kind = read.schema["doc_id"].dataType.simpleString()
    rows = work.save(read.select("row_id", "doc_id", "text").mapInArrow(common.tidy(sign), f"row_id long, doc_id {kind}, text_key binary, bands array<long>"), "rows")

    # one text stands for all its copies
    first = F.min(F.struct("doc_id", "row_id"))
    texts = work.save(rows.groupBy("text_key").agg(F.min("row_id").alias("rep"), first.alias("first"), F.count(F.lit(1)).alias("n")), "texts")
    reps = texts.select(F.col("rep").alias("row_id"))
    banded = work.save(rows.select("row_id", "bands").join(reps.hint("merge"), "row_id").select(F.col("row_id").alias("rep"), F.explode("bands").alias("key")), "banded")
    buckets = work.save(banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "pivot"), "buckets")
    shared = work.save(banded.join(buckets.hint("merge"), "key"), "shared")

    # 1. stars
    stars = work.save(shared.where("rep <> pivot").select("rep", "pivot").distinct(), "stars")
    wanted = stars.select("rep").union(stars.select("pivot")).distinct()
    sets = work.save(_shingle_sets(read.select(F.col("row_id").alias("rep"), "text").join(wanted.hint("merge"), "rep"), width), "sets")
    links = work.save(_verified(stars, sets, similarity), "star_links")
    roots = components(links, work, "stars")

    # 2. families of buckets with several classes
    label = lambda df: df.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("label", F.coalesce("root", "rep")).drop("root")
    labelled = label(shared)
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    joined = work.save(shared.join(open_keys, "key").where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), "open")
    families = components(joined, work, "families").select(F.col("node").alias("rep"), F.col("root").alias("family"))
    more = work.save(_family_links(label(families), sets, similarity, block, work), "family_links")

    classes = components(links.unionByName(more), work, "classes").select(F.col("node").alias("rep"), "root")
    placed = work.save(texts.join(classes, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "placed")
    whole = placed.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("class_size"), F.min("first.doc_id").alias("class_id"))
    by_text = work.save(placed.select("text_key", "root").join(whole, "root"), "by_text")
    work.keep_only("numbered", "rows", "by_text")
    out = rows.select("row_id", "doc_id", "text_key").join(by_text.hint("merge"), "text_key")
    return out.select("doc_id", "class_id", "class_size", (F.col("keep.row_id") == F.col("row_id")).alias("kept"), "row_id", "text_key")


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """rep with its sorted distinct 64-bit shingle ids, as bytes."""
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.binary())])

    def make(batches):
        shingler = common.per_process("shingler", Shingler)
        for batch in batches:
            ids, values = common.column(batch, "rep"), common.column(batch, "text")
            for a, b in common.slices(values):
                found = [np.unique(s).tobytes() for s in shingler.shingles(values[a:b], width)]
                yield pa.record_batch([pa.array(ids[a:b], pa.int64()), pa.array(found, pa.binary())], schema)

    return texts.select("rep", "text").mapInArrow(common.tidy(make), "rep long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (rep, pivot) of similarity ``least`` or more, as (a, b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches):
        for batch in batches:
            a, b = [], []
            for rep, pivot, mine, other in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("rep", "pivot", "mine", "other")), strict=True):
                # sets of very different size cannot be alike enough
                if min(len(mine), len(other)) >= least * max(len(mine), len(other)) and jaccard(np.frombuffer(mine, np.uint64), np.frombuffer(other, np.uint64)) >= least:
                    a.append(rep)
                    b.append(pivot)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema)

    both = pairs.join(sets.select("rep", F.col("shingles").alias("mine")).hint("merge"), "rep").join(sets.select(F.col("rep").alias("pivot"), F.col("shingles").alias("other")).hint("merge"), "pivot")
    return both.select("rep", "pivot", "mine", "other").mapInArrow(common.tidy(check), "a long, b long")


def _family_links(members: DataFrame, sets: DataFrame, least: float, block: int, work: Workspace) -> DataFrame:
    """Links between classes within families. members: rep, family, label."""
    members = work.save(members.select("rep", "family", "label"), "members")
    sizes = members.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.sum("n").alias("members"), (F.sum("n") - F.max("n")).alias("asking"))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    rows = members.join(largest, "family").join(sets, "rep").withColumn("asks", F.col("label") != F.col("largest"))
    hashed = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), blocks(n)).cast("int")
    ask = rows.where("asks").select("family", F.lit(True).alias("query"), hashed(1, "asking").alias("q"), F.explode(F.sequence(F.lit(0), blocks("members") - 1)).alias("o"), "rep", "label", "shingles")
    answer = rows.select("family", F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0), blocks("asking") - 1)).alias("q"), hashed(2, "members").alias("o"), "rep", "label", "shingles")
    dealt = ask.unionByName(answer).repartition("family", "q", "o").sortWithinPartitions("family", "q", "o")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        key, queries, others = None, [], []
        found: list[tuple[int, int]] = []
        for batch in batches:
            for family, query, q, o, rep, label, data in zip(*(common.column(batch, c) for c in ("family", "query", "q", "o", "rep", "label", "shingles")), strict=True):
                if key != (family, q, o):
                    found += block_links(queries, others, least)
                    key, queries, others = (family, q, o), [], []
                (queries if query else others).append((rep, label, np.frombuffer(data, np.uint64)))
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema)
                found = []
        found = block_links(queries, others, least)
        if found:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema)

    return dealt.mapInArrow(common.tidy(compare), "a long, b long")


def recall_at(similarity: float, bands: int = BANDS, band_rows: int = BAND_ROWS) -> float:
    """Chance that two texts of this similarity share a band."""
    return 1.0 - math.pow(1.0 - similarity**band_rows, bands)
