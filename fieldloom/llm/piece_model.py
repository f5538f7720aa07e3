"""Byte-level BPE encoding and decoding through a serialised sentencepiece model.

A rank file lists byte strings with merge ranks. Every byte maps to one
printable character, so each string becomes a sentencepiece piece whose score
is minus its rank; with identity normalisation the library then merges exactly
the adjacent pair of lowest rank, leftmost first, as rank-based BPE does. No
model is trained: the file is written field by field from the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import common

#: Piece types and the model type, fixed by sentencepiece's model format.
NORMAL, UNKNOWN, BPE_MODEL = 1, 2, 2


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, at their ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    found = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in found] != list(range(len(found))):
        raise ValueError(f"{path}: ranks have gaps")
    return [token for _, token in found]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes_field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; one unknown piece follows them."""
    letters = byte_alphabet()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        out += _bytes_field(1, _bytes_field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _int_field(3, NORMAL))
    unknown = _bytes_field(1, b"\xe2\x81\x87unk") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _int_field(3, UNKNOWN)
    out += _bytes_field(1, unknown)
    # trainer_spec: model_type, vocab_size, unk_id, and no begin, end or padding piece
    none = (1 << 64) - 1
    out += _bytes_field(2, _int_field(3, BPE_MODEL) + _int_field(4, len(tokens) + 1) + _int_field(40, len(tokens)) + b"".join(_int_field(n, none) for n in (41, 42, 43)) + _bytes_field(45, b"\xe2\x81\x87unk"))
    # normalizer_spec: identity; no dummy prefix, no blank removal, no blank escape
    out += _bytes_field(3, _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0))
    return bytes(out)


class PieceCodec:
    """Encodes and decodes with a rank file and a pre-token pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        from sentencepiece import SentencePieceProcessor

        self.tokens = read_ranks(ranks_path)
        self.rank = {token: i for i, token in enumerate(self.tokens)}
        self.model = SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.pattern = regex.compile(pattern)
        #: The coarse cut fits this pattern alone.
        self.coarse_fits = r"\s+(?!\S)|\s+" in pattern and r" ?\p{L}+" in pattern
        self.letters = str.maketrans({i: c for i, c in enumerate(byte_alphabet())})
        self.memo = common.Memo()
        self.decimal = [str(i) for i in range(len(self.tokens))]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word: its pre-tokens one by one, a whole pre-token of the vocabulary first."""
        cut = [[common.utf8(p) for p in self.pattern.findall(w)] for w in words]
        rest = list({p for pieces in cut for p in pieces if p not in self.rank})
        merged = dict(zip(rest, self.model.encode([p.decode("latin-1").translate(self.letters) for p in rest], num_threads=1), strict=True)) if rest else {}
        return [tuple(i for p in pieces for i in ((self.rank[p],) if p in self.rank else merged[p])) for pieces in cut]

    def encode(self, texts: list[str]) -> list[list[int]]:
        words, new = [], set()
        for text in texts:
            words.append(common.COARSE.findall(text) if self.coarse_fits and not common.UNSURE_BLANKS.search(text) else None)
            new.update(words[-1] or ())
        self.memo.learn(new, self.encode_words)
        get, out = self.memo.__getitem__, []
        for w, text in zip(words, texts, strict=True):
            if w is None:
                out.append(list(self.encode_words([text])[0]))
            else:
                ids: list[int] = []
                for word in w:
                    ids += get(word)
                out.append(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _codec(ranks_path: str, pattern: str) -> PieceCodec:
    return common.per_process(f"pieces:{ranks_path}:{pattern}", lambda: PieceCodec(ranks_path, pattern))


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """docs with the ids of each whole text as array<int> in out_col, which replaces a column of that name.

    A null text counts as empty and has no ids, like an empty one; other columns
    and repeated rows are passed on; an empty table stays empty.
    """

    @F.pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        codec = _codec(ranks_path, pattern)
        values = ["" if t is None else t for t in texts]
        return pd.Series([x for a, b in common.slices(values) for x in codec.encode(values[a:b])], index=texts.index, dtype=object)

    return docs.withColumn(out_col, ids(common.named(text_col)))


def bpe_decode(tokens: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """tokens with the bytes that ids_col stands for in out_col, which replaces a column of that name.

    Null ids stay null, no ids give no bytes; other columns and repeated rows
    are passed on; an empty table stays empty.
    """

    @F.pandas_udf("binary")
    def data(ids):
        import pandas as pd

        codec = _codec(ranks_path, pattern)
        return pd.Series([None if x is None else codec.decode(list(x)) for x in ids], index=ids.index, dtype=object)

    return tokens.withColumn(out_col, data(common.named(ids_col)))


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, of ids that are encoded and decoded again in one pass.

    A null text counts as empty; ids are not looked at, may be of any type and
    repeated, and repeated rows give repeated results; an empty table gives none.
    """

    def digest(batches):
        codec = _codec(ranks_path, pattern)
        for batch in batches:
            texts = ["" if t is None else t for t in common.column(batch, "text")]
            for a, b in common.slices(texts):
                all_ids = codec.encode(texts[a:b])
                shown = [hashlib.sha256(",".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest() for ids in all_ids]
                back = [hashlib.sha256(codec.decode(ids)).hexdigest() for ids in all_ids]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([len(x) for x in all_ids], pa.int64()), shown, back], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(common.named(id_col).alias("doc_id"), common.named(text_col).alias("text"))
    return rows.mapInArrow(common.tidy(digest), f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
