"""Language-model scoring with a log-frequency Bloom filter.

The filter holds n-gram counts on a logarithmic scale: an n-gram whose count has
level q is entered q times, as (n-gram, 1) to (n-gram, q). A count is read back
by probing levels 1, 2, ... until one is absent, so an error can only raise it,
mostly by one level, with the filter's small error rate. Pair and triple counts
read this way, those seen once too, give the smoothed probabilities

    P1(w)       = (c(w) + a) / (N + a (V + 1))
    P2(w | v)   = (1 - PAIR) P1(w) + PAIR c(v w) / c(v)
    P3(w | u v) = (c(u v w) + TRIPLE P2(w | v)) / (c(u v) + TRIPLE)

where a text is preceded by an end. Each sums to 1 over all words and one unseen
word, as far as counts are exact; P2 is P1 after a word that was never seen. The
first token of a text goes by P2. Counts of words are exact.

A filter of all n-grams grows with the corpus, so no worker is sent all of it. It
is stored: a table of segments of bounded size, one for each range of the
n-gram's hash, which holds all there is of the model (fit_lm, LmModel.load). Texts
are scored by probing it, those it never saw as well, in any later process:

1. Fitting, a task reads its part of the training texts in blocks of bounded
   bytes and sends each block's distinct words, pairs and triples, as sorted
   hashes with counts, to ranges. A range sums the counts, enters them into its
   segment and stores that; no count of an n-gram outlives it.
2. Scoring, texts become files of blocks, told by a written table, and every block
   asks each range for its own distinct n-grams. A worker is sent the segments of the ranges that it
   serves and answers with the levels that probing finds.
3. A block's answers meet the block, and its documents are scored.

What is sent grows in proportion to the corpus: at most a row for each n-gram,
fewer where a block has many n-grams of a range. No key is hot, since a block
sends an n-gram once. A task that is run again reads the same blocks. Words are told apart by 64-bit hashes, n-grams by 47 bits.
"""

from __future__ import annotations

import math
import struct
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import common
from fieldloom.llm.near_dedup import mix64
from fieldloom.session import Workspace

#: Bytes of text that a block holds, about; a longer text is a block of its own.
BLOCK_BYTES = 8_000_000
#: N-grams of all blocks that one task sums, about.
RANGE_ENTRIES = 2_000_000
ADD, PAIR, TRIPLE = 0.1, 0.25, 10.0
#: Counts are kept to within this factor.
BASE, MAX_LEVEL = 1.25, 160
HASHES, BITS_PER_ENTRY = 5, 8.0
END = b""
WORDS, GRAMS = 0, 1
#: Shares of the blocks that ask one after the other.
ROUNDS = 2
#: Fewer keys than this are sent as they are: a frame would cost more than it saves.
PLAIN_KEYS = 64
_HEAD = "<BBIQ"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: str) -> list[bytes]:
    """Words between U+0020 and U+0009 to U+000D, A to Z in lower case, as UTF-8; then the end."""
    words = common.utf8(text).lower().split()
    words.append(END)
    return words


def thresholds() -> np.ndarray:
    """The least count of each level from 1 on: 1, 2, 3, 4, 5, 7, 9, ..., growing by BASE."""
    found = [1]
    while len(found) < MAX_LEVEL:
        found.append(max(found[-1] + 1, math.ceil(found[-1] * BASE)))
    return np.array([min(x, 2**62) for x in found], np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """How many thresholds each count meets."""
    return np.searchsorted(thresholds(), counts, side="right").astype(np.int64)


def level_counts() -> np.ndarray:
    """The count each level stands for: none at level 0, else the mean of the whole numbers it covers."""
    least = thresholds()
    return np.concatenate([[0.0], (least[:-1] + least[1:] - 1) / 2, [float(least[-1])]])


def _seeds(keys: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    one = mix64(keys + np.uint64(q * int(_STEP) % 2**64))
    return one, mix64(one) | np.uint64(1)


def bits_of(level: np.ndarray, bits_per_entry: float = BITS_PER_ENTRY) -> int:
    """Bits of a filter for keys of these levels; in a very small one, hash functions would coincide."""
    return max(1 << 16, int(level.sum() * bits_per_entry))


def build(keys: np.ndarray, level: np.ndarray, m: int) -> np.ndarray:
    """A filter of m bits, as bytes, with keys entered at levels 1 to level."""
    bits = np.zeros(m, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        one, two = _seeds(keys[level >= q], q)
        for h in range(HASHES):
            bits[((one + np.uint64(h) * two) % np.uint64(m)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def probe(bits: np.ndarray, m: int, keys: np.ndarray) -> np.ndarray:
    """The level of each key in a filter of m bits: how many levels are present, counted until one is absent."""
    level = np.zeros(len(keys), np.uint8)
    at = np.arange(len(keys))
    for q in range(1, MAX_LEVEL + 1):
        one, two = _seeds(keys[at], q)
        for h in range(HASHES):
            place = (one + np.uint64(h) * two) % np.uint64(m)
            there = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
            at, one, two = at[there], one[there], two[there]
        if not len(at):
            break
        level[at] = q
    return level


def range_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The hash range, 0 to n - 1, of 64-bit keys; it grows with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def squeeze(keys: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Sorted distinct keys and their counts, if there are any, compressed; low bits that no key uses are left out."""
    import zstandard

    shift = 17 if not np.any(keys & np.uint64(0x1FFFF)) else 0
    keys = keys >> np.uint64(shift)
    steps = np.diff(keys)
    narrow = not len(steps) or int(steps.max()) < 2**32
    small = counts is None or int(counts.max()) < 2**8
    body = steps.astype("<u4" if narrow else "<u8").tobytes() + (b"" if counts is None else counts.astype("<u1" if small else "<u8").tobytes())
    plain = len(keys) < PLAIN_KEYS
    return struct.pack(_HEAD, narrow + 2 * small + 4 * plain, shift, len(keys), int(keys[0])) + (body if plain else zstandard.ZstdCompressor(level=1).compress(body))


def expand(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """keys and counts of squeeze(); no counts if it had none."""
    import zstandard

    flags, shift, n, first = struct.unpack_from(_HEAD, data)
    body = data[struct.calcsize(_HEAD) :]
    body = body if flags & 4 else zstandard.ZstdDecompressor().decompress(body)
    steps = np.frombuffer(body, "<u4" if flags & 1 else "<u8", n - 1)
    keys = np.empty(n, np.uint64)
    keys[0] = first
    keys[1:] = np.uint64(first) + np.cumsum(steps, dtype=np.uint64)
    return keys << np.uint64(shift), np.frombuffer(body, "<u1" if flags & 2 else "<u8", offset=steps.nbytes).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not int(np.bitwise_or.reduce(keys)) & 0x1FFFF and (not len(counts) or int(counts.max()) < 1 << 17):
        # counts fit below the keys, and plain numbers sort faster than an order of them
        both = keys | counts.view(np.uint64)
        both.sort()
        keys, counts = both & ~np.uint64(0x1FFFF), (both & np.uint64(0x1FFFF)).view(np.int64)
        del both
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return keys[starts], np.add.reduceat(counts, starts)


class LocalIds(dict):
    """Numbers keys in order of appearance."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Block:
    """The tokens of a block's documents as numbers of its own vocabulary, an end before the first."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, train: np.ndarray, end: int):
        self.tokens, self.lengths, self.hashes, self.train, self.end = tokens, lengths, hashes, train, end
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    @classmethod
    def of(cls, texts: list[str], train: list[bool]) -> Block:
        import xxhash

        ids, parts = LocalIds(), []
        number = ids.__getitem__
        for text in texts:
            words = tokens_of(text)
            parts.append(np.fromiter(map(number, words), np.int32, len(words)))
        digest = xxhash.xxh3_64_intdigest
        hashes = np.fromiter((digest(w) for w in ids), np.uint64, len(ids))
        return cls(np.concatenate(parts), np.array([len(p) for p in parts], np.int64), hashes, np.array(train, bool), ids[END])

    def before(self) -> np.ndarray:
        """The token before each; a text's first follows an end."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = self.end
        return before

    def pair_keys(self) -> np.ndarray:
        """A key for each token with the one before it: odd 47-bit numbers, shifted to the top."""
        key = mix64(self.hashes[self.before()] * _STEP + mix64(self.hashes[self.tokens]))
        return (key & ~np.uint64(0x3FFFF)) | np.uint64(0x20000)

    def triple_keys(self, pairs: np.ndarray) -> np.ndarray:
        """A key for each token with the two before it, even numbers; 0 for a text's first."""
        key = np.zeros_like(pairs)
        key[1:] = mix64(pairs[:-1] * _STEP + mix64(self.hashes[self.tokens[1:]])) & ~np.uint64(0x3FFFF)
        key[self.starts] = 0
        return key

    def gram_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct n-gram keys, and how often each occurs; as grams(), without the places, which cost a slower sort."""
        pairs = self.pair_keys()
        triples = self.triple_keys(pairs)
        return np.unique(np.concatenate([pairs, triples[triples != 0]]), return_counts=True)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct n-gram keys, and the place in them of each token's pair and of its triple (-1: none)."""
        pairs = self.pair_keys()
        triples = self.triple_keys(pairs)
        keys, at = np.unique(np.concatenate([pairs, triples]), return_inverse=True)
        none = int(len(keys) > 0 and keys[0] == 0)
        at = at - none
        return keys[none:], at[: len(pairs)], at[len(pairs) :]

    def data(self) -> bytes:
        import zstandard

        head = struct.pack("<IIII", len(self.lengths), len(self.hashes), len(self.tokens), self.end)
        body = b"".join(x.tobytes() for x in (self.lengths.astype("<i8"), self.hashes.astype("<u8"), self.train.astype("<u1"), self.tokens.astype("<i4")))
        return head + zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def read(cls, data: bytes) -> Block:
        import zstandard

        n, v, t, end = struct.unpack_from("<IIII", data)
        body = zstandard.ZstdDecompressor().decompress(data[16:])
        cut = np.cumsum([0, 8 * n, 8 * v, n, 4 * t])
        lengths, hashes, train, tokens = (np.frombuffer(body[a:b], kind) for a, b, kind in zip(cut, cut[1:], ("<i8", "<u8", "<u1", "<i4"), strict=False))
        return cls(tokens, lengths, hashes, train.astype(bool), end)


def _cells(keys: np.ndarray, n_ranges: int):
    """(range, start, stop) of every range that sorted keys have part in."""
    ranges = range_of(keys, n_ranges)
    starts = np.flatnonzero(np.diff(ranges, prepend=-1))
    return zip(ranges[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)


def _packed(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpacked(cells: list[tuple[int, bytes]], kind: str, n: int) -> np.ndarray:
    """The values of all cells (range, data) in the order of ranges; as many as the block has keys."""
    import zstandard

    out = np.concatenate([np.empty(0, kind), *(np.frombuffer(zstandard.ZstdDecompressor().decompress(d), kind) for _, d in sorted(cells))])
    if len(out) != n:
        raise RuntimeError("a block's answers do not match its file")
    return out


def _blocks(batches, block_bytes: int):
    """(ids, texts, flags) of blocks of batches (id, text, flag), each of about so many bytes or of one longer text."""
    ids, texts, flags, held = [], [], [], 0
    for batch in batches:
        column, values, marks = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        first = 0
        for i, text in enumerate(values):
            texts.append(text)
            flags.append(marks[i])
            held += len(text) + 8
            if held >= block_bytes:
                ids.append(column.slice(first, i + 1 - first))
                yield ids, texts, flags
                ids, texts, flags, held, first = [], [], [], 0, i + 1
        if first < len(values):
            ids.append(column.slice(first))
    if texts:
        yield ids, texts, flags


@dataclass
class LmModel:
    """The stored filter: segments (kind, range, ranges, m, entries, total, distinct, data), and what they hold in all."""

    segments: DataFrame
    n_ranges: int
    n_tokens: int
    n_words: int

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LmModel:
        """The model that fit_lm stored at path, with nothing else than that table."""
        segments = spark.read.parquet(path)
        n_ranges, n_tokens, n_words = segments.agg(F.coalesce(F.max("ranges"), F.lit(1)), F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
        return cls(segments, n_ranges, n_tokens, n_words)

    def error_rate(self) -> float:
        """Share of n-grams never seen that the filter takes for seen."""
        entries, bits = self.segments.where(F.col("kind") == GRAMS).agg(F.sum("entries"), F.sum("m")).first()
        return (1.0 - math.exp(-HASHES * entries / bits)) ** HASHES if bits else 0.0


def fit_lm(docs: DataFrame, path: str, text_col: str = "text", block_bytes: int = BLOCK_BYTES, range_entries: int = RANGE_ENTRIES, bits_per_entry: float = BITS_PER_ENTRY, work: Workspace | None = None) -> LmModel:
    """Learn from every row of docs and store the filter as a table at path.

    A null text counts as empty and is one token, its end; repeated rows each
    count. An empty table gives a model that has seen nothing.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "lm_fit")
    rows = docs.select(F.lit(0).alias("id"), F.coalesce(common.named(text_col), F.lit("")).alias("text"), F.lit(True).alias("flag"))
    n_docs, n_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # a word of text takes six bytes or so, and gives a pair and a triple
    n_ranges = max(1, -(-(n_bytes // 3 + 2 * n_docs) // range_entries))
    sent = pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("data", pa.binary())])

    def count(batches):
        for _, texts, flags in _blocks(batches, block_bytes):
            block = Block.of(texts, flags)
            order = np.argsort(block.hashes)
            words = np.bincount(block.tokens, minlength=len(block.hashes))
            keys, grams = block.gram_counts()
            for kind, some, n in ((WORDS, block.hashes[order], words[order]), (GRAMS, keys, grams)):
                cells = list(_cells(some, n_ranges))
                yield pa.record_batch([pa.array([kind] * len(cells), pa.int32()), pa.array([r for r, _, _ in cells], pa.int32()), pa.array([squeeze(some[a:b], n[a:b]) for _, a, b in cells], pa.binary())], sent)

    kinds = "kind int, range int, ranges int, m long, entries long, total long, distinct long, data binary"
    names = [x.split()[0] for x in kinds.split(", ")]

    def enter(batches):
        held: dict[tuple[int, int], list[bytes]] = {}
        for batch in batches:
            for kind, at, data in zip(*(common.column(batch, c) for c in ("kind", "range", "data")), strict=True):
                held.setdefault((at, kind), []).append(data)
        for at, kind in list(held):
            each = [expand(data) for data in held.pop((at, kind))]
            keys, n = np.concatenate([k for k, _ in each]), np.concatenate([c for _, c in each])
            del each
            keys, n = summed(keys, n)
            if kind == WORDS:
                row = (kind, at, n_ranges, 0, 0, int(n.sum()), len(keys), squeeze(keys, n))
            else:
                level = levels(n)
                m = bits_of(level, bits_per_entry)
                row = (kind, at, n_ranges, m, int(level.sum()), 0, 0, build(keys, level, m).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [*[pa.int32()] * 3, *[pa.int64()] * 4, pa.binary()], strict=True)], names=names)

    cells = rows.mapInArrow(common.tidy(count), "kind int, range int, data binary")
    work.save_and_clean(cells.repartitionById(n_ranges, F.col("range")).mapInArrow(common.tidy(enter), kinds), "segments", path)
    return LmModel.load(spark, path)


def score_lm(docs: DataFrame, model: LmModel, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, range_entries: int = RANGE_ENTRIES, work: Workspace | None = None) -> DataFrame:
    """Per row: doc_id, held_out (a mark that is carried along), n_tokens, n_known, train_tokens, base_score, score, by a stored model."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "lm_score")
    folder = work.uri("texts")
    rows = docs.select(common.named(id_col).alias("doc_id"), F.coalesce(common.named(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    n_docs, n_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # a range is asked in so many parts that one is bounded, whatever was learned from
    per_range = max(1, -(-(n_bytes // 3 + 2 * n_docs) // range_entries // model.n_ranges))
    n_parts = model.n_ranges * per_range

    def pack(batches):
        for ids, texts, flags in _blocks(batches, block_bytes):
            block = Block.of(texts, [not x for x in flags])
            table = pa.table([pa.chunked_array(ids)], names=["doc_id"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            # a name of its own, told by the row that is committed: files of a lost attempt are in no manifest
            name = uuid.uuid4().hex
            common.write_file(f"{folder}/{name}", block.data())
            common.write_file(f"{folder}/{name}.ids", sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["block"])

    blocks = work.save(rows.mapInArrow(common.tidy(pack), "block string"), "blocks")
    n_blocks = max(1, blocks.count())
    asking = pa.schema([("kind", pa.int32()), ("block", pa.string()), ("part", pa.int32()), ("data", pa.binary())])

    def ask(batches):
        for batch in batches:
            for name in common.column(batch, "block"):
                block = Block.read(common.read_file(f"{folder}/{name}"))
                for kind, some in ((WORDS, np.sort(block.hashes)), (GRAMS, block.gram_counts()[0])):
                    cells = list(_cells(some, n_parts))
                    yield pa.record_batch([pa.array([kind] * len(cells), pa.int32()), pa.array([name] * len(cells)), pa.array([r for r, _, _ in cells], pa.int32()), pa.array([squeeze(some[a:b]) for _, a, b in cells], pa.binary())], asking)

    dealt = blocks.withColumn("turn", F.pmod(F.xxhash64("block"), F.lit(ROUNDS))).repartition(n_blocks, "block")
    cells = lambda turn: dealt.where(F.col("turn") == turn).select("block").mapInArrow(common.tidy(ask), "kind int, block string, part int, data binary").withColumn("m", F.lit(None).cast("long"))
    parts = F.explode(F.sequence(F.col("range") * per_range, (F.col("range") + 1) * per_range - 1)).alias("part")
    segments = model.segments.select("kind", F.lit(None).cast("string").alias("block"), parts, "data", "m")

    def answer(batches):
        asked: dict[tuple[int, int], list[tuple[str, bytes]]] = {}
        learned: dict[tuple[int, int], tuple[bytes, int]] = {}
        for batch in batches:
            for kind, block, at, data, m in zip(*(common.column(batch, c) for c in ("kind", "block", "part", "data", "m")), strict=True):
                if block is None:
                    learned[at, kind] = data, m
                else:
                    asked.setdefault((at, kind), []).append((block, data))
        for at, kind in list(asked):
            mine = asked.pop((at, kind))
            each = [expand(data)[0] for _, data in mine]
            # a key that several blocks ask is probed for each: that costs less than to sort them out
            keys = np.concatenate(each)
            data, m = learned.pop((at, kind), (None, 0))
            if data is None:
                n = np.zeros(len(keys), np.int64 if kind == WORDS else np.uint8)
            elif kind == WORDS:
                known, counts = expand(data)
                spot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                n = np.where(known[spot] == keys, counts[spot], 0)
            else:
                n = probe(np.frombuffer(data, np.uint8), m, keys)
            answers, done = [], 0
            for k in each:
                answers.append(_packed(n[done : done + len(k)]))
                done += len(k)
            yield pa.record_batch([pa.array([kind] * len(mine), pa.int32()), pa.array([b for b, _ in mine]), pa.array([at] * len(mine), pa.int32()), pa.array(answers, pa.binary())], asking)

    # what is asked is on disk for one share of the blocks at a time
    told = []
    for turn in range(ROUNDS):
        both = cells(turn).unionByName(segments).repartitionById(n_parts, F.col("part"))
        told.append(work.save_and_clean(both.mapInArrow(common.tidy(answer), "kind int, block string, part int, data binary"), f"answers{turn}"))
    answers = reduce(DataFrame.unionByName, told)
    n_train = model.n_tokens
    floor = n_train + ADD * (model.n_words + 1)

    def score(batches):
        waiting: dict[str, tuple[list, list]] = {}
        for batch in batches:
            for block, kind, at, data in zip(*(common.column(batch, c) for c in ("block", "kind", "part", "data")), strict=True):
                waiting.setdefault(block, ([], []))[kind].append((at, data))
        for name in list(waiting):
            words, grams = waiting.pop(name)
            block = Block.read(common.read_file(f"{folder}/{name}"))
            ids = pa.ipc.open_stream(common.read_file(f"{folder}/{name}.ids")).read_all().column(0)
            exact = np.empty(len(block.hashes), np.int64)
            exact[np.argsort(block.hashes)] = _unpacked(words, "<i8", len(block.hashes))
            keys, pair, triple = block.grams()
            count = level_counts()[_unpacked(grams, "u1", len(keys))]
            base = np.log10((exact + ADD) / floor)
            p = smoothed(exact, count, block.tokens, block.before(), pair, triple, floor)
            known = (exact > 0)[block.tokens].astype(np.int64)
            sums = [np.add.reduceat(x, block.starts) for x in (known, base[block.tokens], np.log10(p))]
            n = len(block.lengths)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids.chunks), pa.array(~block.train), pa.array(block.lengths), pa.array(sums[0]), pa.array([n_train] * n, pa.int64()), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return answers.repartition(n_blocks, "block").mapInArrow(common.tidy(score), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, range_entries: int = RANGE_ENTRIES, bits_per_entry: float = BITS_PER_ENTRY) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from every row where held_out is false (null counts as
    false) and is stored; all rows are scored by it. A null text counts as empty
    and is one token, its end. Ids may be of any type, null or repeated; repeated
    rows give repeated results, and each counts in training. With nothing to
    learn from, all counts are 0. An empty table gives no rows; other columns
    are not read.
    """
    work = Workspace(docs.sparkSession, "lm")
    learned = docs.where(~F.coalesce(held_out, F.lit(False)))
    model = fit_lm(learned, work.path("segments"), text_col, block_bytes, range_entries, bits_per_entry, work)
    scored = score_lm(docs, model, held_out, id_col, text_col, block_bytes, range_entries, work)
    # the answers are written, so nothing reads the filter any more
    work.drop("segments")
    return scored


def smoothed(word: np.ndarray, gram: np.ndarray, tokens: np.ndarray, before: np.ndarray, pair: np.ndarray, triple: np.ndarray, floor: float) -> np.ndarray:
    """Probability of each token: word and gram are counts, tokens and before places in word, pair and triple in gram."""
    p1 = ((word + ADD) / floor)[tokens]
    # a count read too high must not pass that of its context
    history = np.maximum(word[before], gram[pair])
    share = np.where(word[before] > 0, PAIR, 0.0)
    p2 = (1.0 - share) * p1 + share * gram[pair] / np.maximum(history, 1.0)
    has = triple >= 0
    context = np.zeros(len(tokens))
    context[1:] = gram[pair[:-1]]
    seen = np.where(has, gram[triple], 0.0)
    context = np.where(has, np.maximum(context, seen), 0.0)
    return (seen + TRIPLE * p2) / (context + TRIPLE)
