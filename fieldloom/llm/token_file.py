"""Token ids in fixed-width bit-packed shard files.

Each id takes the least number of bits that holds every id of the vocabulary.
A shard file is

    payload      ids in blocks of ``block_tokens``, each block packed on its own
    block_at     uint64[n_blocks]     byte offset of each block
    doc_ids      int64[n_docs]        ids of the documents, in file order
    doc_known    uint8[n_docs]        0 where the document's id is null
    doc_at       uint64[n_docs + 1]   token offset of each document, then the total
    footer       FOOTER

so a document, or any range of tokens, is read by fetching whole blocks and
unpacking them with numpy. Shards are range-partitioned by document id: file
order is ascending id order across the whole table.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm import common
from fieldloom.session import Workspace

MAGIC = b"FLTB"
FOOTER = "<4sHHIQQQ"  # magic, version, bits, block_tokens, n_tokens, n_docs, payload bytes
FOOTER_BYTES = struct.calcsize(FOOTER)
VERSION = 1
BLOCK_TOKENS = 65_536
DOCS_PER_SHARD = 32_768


def bits_for(n_ids: int) -> int:
    """The least width that holds ids 0 to n_ids - 1."""
    return max(1, int(n_ids - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids as a little-endian bit string of ``bits`` bits each, padded to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The n ids of a packed bit string, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little")
    return (flat.reshape(n, bits).astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))).astype(np.uint32)


class ShardWriter:
    """Streams documents into one shard; close() makes it visible under its name in one move."""

    def __init__(self, uri: str, bits: int, block_tokens: int = BLOCK_TOKENS):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)
        self.bits, self.block_tokens = bits, block_tokens
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_tokens = self.written = 0
        self.block_at: list[int] = []
        self.doc_ids: list[int | None] = []
        self.doc_at: list[int] = [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_tokens += len(ids)
        self.doc_ids.append(doc_id)
        self.doc_at.append(self.n_tokens)
        if self.n_waiting >= 16 * self.block_tokens:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        whole = len(ids) if last else len(ids) - len(ids) % self.block_tokens
        for at in range(0, whole, self.block_tokens):
            data = pack(ids[at : min(whole, at + self.block_tokens)], self.bits)
            self.block_at.append(self.written)
            self.out.write(data)
            self.written += len(data)
        self.waiting = [ids[whole:]]
        self.n_waiting = len(ids) - whole

    def close(self) -> int:
        """Finish the file and return its bytes."""
        self._flush(True)
        known = np.array([x is not None for x in self.doc_ids], np.uint8)
        for array in (np.array(self.block_at, "<u8"), np.array([x or 0 for x in self.doc_ids], "<i8"), known, np.array(self.doc_at, "<u8")):
            self.out.write(array.tobytes())
        self.out.write(struct.pack(FOOTER, MAGIC, VERSION, self.bits, self.block_tokens, self.n_tokens, len(self.doc_ids), self.written))
        self.out.close()
        common.show(self.fs, self.part, self.path)
        return self.written


class ShardReader:
    """Random access to one shard file."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        magic, version, self.bits, self.block_tokens, self.n_tokens, self.n_docs, payload = struct.unpack(FOOTER, self.file.read_at(FOOTER_BYTES, end - FOOTER_BYTES))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{uri} is no token shard of version {VERSION}")
        index = self.file.read_at(end - FOOTER_BYTES - payload, payload)
        n_blocks = -(-self.n_tokens // self.block_tokens)
        self.block_at = np.append(np.frombuffer(index, "<u8", n_blocks), np.uint64(payload))
        at = 8 * n_blocks
        self.doc_ids = np.frombuffer(index, "<i8", self.n_docs, at)
        self.doc_known = np.frombuffer(index, np.uint8, self.n_docs, at + 8 * self.n_docs)
        self.doc_at = np.frombuffer(index, "<u8", self.n_docs + 1, at + 9 * self.n_docs).astype(np.int64)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Token ids start to stop of the shard."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block_tokens, (stop - 1) // self.block_tokens
        at = int(self.block_at[first])
        data = self.file.read_at(int(self.block_at[last + 1]) - at, at)
        parts = []
        for block in range(first, last + 1):
            n = min(self.block_tokens, self.n_tokens - block * self.block_tokens)
            parts.append(unpack(data[int(self.block_at[block]) - at : int(self.block_at[block + 1]) - at], self.bits, n))
        base = first * self.block_tokens
        return np.concatenate(parts)[start - base : stop - base]

    def document(self, k: int) -> np.ndarray:
        """Token ids of the k-th document of the shard."""
        return self.tokens(int(self.doc_at[k]), int(self.doc_at[k + 1]))

    def documents(self, span: int = 64) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, token offset, ids) of every document, reading about ``span`` blocks at a time."""
        k = 0
        while k < self.n_docs:
            stop = k + 1
            while stop < self.n_docs and self.doc_at[stop + 1] - self.doc_at[k] <= span * self.block_tokens:
                stop += 1
            base = int(self.doc_at[k])
            ids = self.tokens(base, int(self.doc_at[stop]))
            for j in range(k, stop):
                a, b = int(self.doc_at[j]), int(self.doc_at[j + 1])
                yield (int(self.doc_ids[j]) if self.doc_known[j] else None), a, ids[a - base : b - base]
            k = stop


class ByteLevelEncoder:
    """A byte-level tokenizer file of the tokenizers library, memoised by word.

    No pre-token crosses an edge of common.COARSE, so words are encoded apart.
    New words with their leading space reach the library many at a time, as one
    text: a token that starts with a space starts a word, so their ids are cut
    there. Texts with special strings or disputed blanks go to the library whole.
    """

    #: New words that make one text for the library.
    TOGETHER = 256

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.memo = common.Memo()
        vocabulary = self.lib.get_vocab()
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        # the byte-level alphabet writes a space as U+0120
        self.leads[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        led = [k for k, w in enumerate(words) if len(w) > 1 and w[0] == " " and not w[1].isspace()]
        chunks = [led[a : a + self.TOGETHER] for a in range(0, len(led), self.TOGETHER)]
        out: list[bytes | None] = [None] * len(words)
        for chunk, found in zip(chunks, self.lib.encode_batch_fast(["".join([words[k] for k in c]) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            at = np.flatnonzero(self.leads[ids]).tolist()
            if len(at) == len(chunk) and at[0] == 0:
                data = ids.tobytes()
                at.append(len(ids))
                for k, a, b in zip(chunk, at, at[1:], strict=False):
                    out[k] = data[4 * a : 4 * b]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self.encode_whole([words[k] for k in rest]), strict=True):
            out[k] = x
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        words: list[list[str] | None] = []
        new: set[str] = set()
        for text in texts:
            whole = common.UNSURE_BLANKS.search(text) or any(s in text for s in self.special)
            words.append(None if whole else common.COARSE.findall(text))
            new.update(words[-1] or ())
        self.memo.learn(new, self.encode_words)
        get = self.memo.__getitem__
        return [b"".join(map(get, w)) if w is not None else self.encode_whole([t])[0] for w, t in zip(words, texts, strict=True)]


def write_token_shards(docs: DataFrame, out_uri: str, tokenizer_path: str, n_ids: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Encode documents and write their ids to shard files below out_uri, in ascending id order.

    Returns the manifest: shard, uri, n_docs, n_tokens, n_bytes. Ids must be of
    an integer type (TypeError otherwise), as the files hold them. A null text
    counts as empty and gets its end id alone; null ids come first; rows that
    share an id are ordered by their ids' bytes. An empty table has no shard.
    Other columns are not read. A retried task writes the same file again and
    moves it into place, so lost executors leave no half file behind.
    """
    work = Workspace(docs.sparkSession, "tokens")
    ids = common.named(id_col)
    if not isinstance(docs.select(ids).schema[0].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of an integer type")
    rows = docs.select(ids.cast("long").alias("doc_id"), F.coalesce(common.named(text_col), F.lit("")).alias("text"))
    n = docs.count()
    n_shards = max(1, -(-n // docs_per_shard))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n_shards for k in range(1, n_shards)], 100 * n_shards)).first()[0] if n_shards > 1 else []
    bounds, bits = np.array(cuts or [], np.int64), bits_for(n_ids)
    packed = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("ids", pa.binary())])
    made = pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])

    def encode(batches):
        encoder = common.per_process(f"tokens:{tokenizer_path}", lambda: ByteLevelEncoder(tokenizer_path))
        for batch in batches:
            ids, texts = common.column(batch, "doc_id"), common.column(batch, "text")
            for a, b in common.slices(texts):
                arrays = [np.append(np.frombuffer(x, "<u4"), np.uint32(end_id)) for x in encoder.encode(texts[a:b])]
                at = [0 if d is None else int(np.searchsorted(bounds, d)) for d in ids[a:b]]
                yield pa.record_batch([pa.array(at, pa.int32()), pa.array(ids[a:b], pa.int64()), pa.array([len(x) for x in arrays], pa.int32()), pa.array([pack(x, bits) for x in arrays], pa.binary())], packed)

    def write(batches):
        writer = shard = None
        for batch in batches:
            for at, doc, n, data in zip(*(common.column(batch, c) for c in ("shard", "doc_id", "n", "ids")), strict=True):
                if writer is None:
                    shard, uri = at, f"{out_uri}/shard-{at:08d}.fltb"
                    writer = ShardWriter(uri, bits)
                writer.add(doc, unpack(data, bits, n))
        if writer is not None:
            size = writer.close()
            yield pa.record_batch([[shard], [uri], [len(writer.doc_ids)], [writer.n_tokens], [size]], made)

    encoded = rows.mapInArrow(common.tidy(encode), "shard int, doc_id long, n int, ids binary")
    placed = encoded.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    return work.save(placed.mapInArrow(common.tidy(write), "shard int, uri string, n_docs long, n_tokens long, n_bytes long"), "manifest")


def read_token_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start (ids before it), n_tokens, ids_crc32, shard.

    The manifest has a row per shard, so its running totals are small.
    """
    base, at = [], 0
    for m in manifest.orderBy("shard").collect():
        base.append((m.shard, m.uri, at))
        at += m.n_tokens
    files = spark.createDataFrame(base, "shard int, uri string, base long").repartition(max(1, len(base)))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32())])

    def read(batches):
        for batch in batches:
            for shard, uri, base in zip(*(common.column(batch, c) for c in ("shard", "uri", "base")), strict=True):
                rows: list[tuple] = []
                for doc, start, ids in ShardReader(uri).documents():
                    rows.append((doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard))
                    if len(rows) == 10_000:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), out, strict=True)], out)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), out, strict=True)], out)

    return files.mapInArrow(common.tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
