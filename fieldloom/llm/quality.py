"""A quality classifier: a factorisation machine over words, structure and metadata.

A text becomes a sparse vector: its words and its runs of symbols, hashed, with
the logarithm of their counts, scaled to length one; measures of its structure
(length, shares of kinds of characters, repetition of words and of lines) and of
its metadata (the stated number of characters against the real one), each as one
of a measure's bins. Beside a weight, every feature has a short vector; the
inner products of these vectors weigh all pairs of features that a text has. Half
the difference of the squared sum and the sum of squares gives all pairs at once,
in time linear in the features.

The fit sees a bounded sample of labelled rows, in one task; it is deterministic.
What workers are sent to score with is FEATURES x (1 + RANK) numbers.
"""

from __future__ import annotations

import math
import operator
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import common
from fieldloom.session import Workspace

#: Labelled rows that the fit sees at most.
FIT_ROWS = 8000
#: Buckets of words and symbols, bins of a measure, all features.
WORD_BUCKETS, BINS = 1 << 16, 24
RANK, EPOCHS, BATCH_DOCS = 8, 8, 32
RATE, SHRINK, SPREAD = 0.1, 1e-5, 0.02
MEASURES = (
    "words", "characters a word", "letters", "capitals", "digits", "symbols", "beyond ASCII", "blanks", "distinct words", "most frequent word",
    "word again at once", "symbol runs a word", "distinct symbol runs", "most frequent symbol run", "longest symbol run", "lines", "repeated lines", "words a line", "stated size", "stated against real size",
)
FEATURES = WORD_BUCKETS + len(MEASURES) * BINS
#: Weight of all measures together against that of all words.
MEASURE_VALUE = 1.0 / math.sqrt(len(MEASURES))


def _tables() -> tuple[bytes, bytes, bytes]:
    kinds, words, symbols = bytearray(256), bytearray(b" " * 256), bytearray(b" " * 256)
    for c in range(256):
        x = chr(c)
        kinds[c] = ord("o" if c >= 0x80 else "u" if x.isupper() else "l" if x.islower() else "d" if x.isdigit() else "b" if c <= 0x20 else "s")
        if c >= 0x80 or x.isalnum():
            words[c] = c + 32 if 0x41 <= c <= 0x5A else c
        elif c > 0x20:
            symbols[c] = c
    return bytes(kinds), bytes(words), bytes(symbols)


KINDS, WORDS, SYMBOLS = _tables()


def _share_bin(part: float, whole: float) -> int:
    """A bin of a share; fine near 0, where shares of junk differ most."""
    return min(BINS - 1, int(BINS * math.sqrt(min(1.0, part / whole)))) if whole else 0


def _size_bin(n: float) -> int:
    return min(BINS - 1, int(math.log2(1 + n)))


def _ratio_bin(a: float, b: float) -> int:
    return min(BINS - 2, max(0, int(BINS / 2 + 4 * math.log2((1 + a) / (1 + b)))))


def _most(counts: Counter) -> int:
    return max(counts.values(), default=0)


def measures_of(data: bytes, n_chars: int | None, words: list[bytes], word_counts: Counter, symbols: list[bytes], symbol_counts: Counter) -> list[int]:
    """A bin for each of MEASURES, in their order."""
    kinds, size, n = data.translate(KINDS), len(data), len(words)
    capitals = kinds.count(b"u")
    letters = capitals + kinds.count(b"l")
    chars = len(data.decode("utf-8", "surrogatepass")) if b"o" in kinds else size
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        _size_bin(n),
        min(BINS - 1, round(2 * size / n)) if n else 0,
        _share_bin(letters, size),
        _share_bin(capitals, letters),
        _share_bin(kinds.count(b"d"), size),
        _share_bin(kinds.count(b"s"), size),
        _share_bin(kinds.count(b"o"), size),
        _share_bin(kinds.count(b"b"), size),
        _share_bin(len(word_counts), n),
        _share_bin(_most(word_counts), n),
        _share_bin(sum(map(operator.eq, words, words[1:])), n),
        _share_bin(len(symbols), n),
        _size_bin(len(symbol_counts)),
        _share_bin(_most(symbol_counts), len(symbols)),
        _size_bin(max(map(len, symbol_counts), default=0)),
        _size_bin(len(lines)),
        _share_bin(len(lines) - len(set(lines)), len(lines)),
        _size_bin(n / len(lines)) if lines else 0,
        0 if n_chars is None else _size_bin(max(0, n_chars)),
        BINS - 1 if n_chars is None else _ratio_bin(max(0, n_chars), chars),
    ]


def features_of(text: str | None, n_chars: int | None, memo: common.Memo | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places and values of a whole text's features; a null text is an empty one."""
    data = common.utf8(text or "")
    words, symbols = data.translate(WORDS).split(), data.translate(SYMBOLS).split()
    word_counts, symbol_counts = Counter(words), Counter(symbols)
    memo = common.Memo() if memo is None else memo
    # runs of words and of symbols have no byte in common
    names, counts = [*word_counts, *symbol_counts], np.fromiter([*word_counts.values(), *symbol_counts.values()], float)
    memo.learn(names, lambda new: [zlib.crc32(x) % WORD_BUCKETS for x in new])
    places, at = np.unique(np.fromiter(map(memo.__getitem__, names), np.int64, len(names)), return_inverse=True)
    values = np.log1p(np.bincount(at, counts, len(places)))
    if len(values):
        values /= math.sqrt((values * values).sum())
    bins = measures_of(data, n_chars, words, word_counts, symbols, symbol_counts)
    own = np.array([WORD_BUCKETS + i * BINS + b for i, b in enumerate(bins)], np.int64)
    return np.concatenate([places, own]), np.concatenate([values, np.full(len(own), MEASURE_VALUE)])


class Machine:
    """bias + sum of w x + all pairs' <v, v'> x x', and its fit by AdaGrad on the logistic loss."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def margins(self, places: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One margin for each run of features that begins at starts; no run is empty."""
        return self._passes(places, values, starts)[0]

    def _passes(self, places, values, starts):
        vx = self.v[places] * values[:, None]
        sums = np.add.reduceat(vx, starts)
        pairs = 0.5 * ((sums * sums).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
        return self.bias + np.add.reduceat(self.w[places] * values, starts) + pairs, vx, sums

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rank: int = RANK, seed: int = 1) -> Machine:
        rng = np.random.default_rng(seed)
        rate = min(max(float(labels.mean()), 1e-3), 1 - 1e-3)
        machine = cls(math.log(rate / (1 - rate)), np.zeros(FEATURES), rng.normal(0, SPREAD, (FEATURES, rank)))
        seen_w, seen_v, seen_b = np.full(FEATURES, 1e-3), np.full((FEATURES, rank), 1e-3), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for a in range(0, len(rows), BATCH_DOCS):
                batch = order[a : a + BATCH_DOCS]
                places, values = (np.concatenate([rows[i][j] for i in batch]) for j in range(2))
                sizes = np.array([len(rows[i][0]) for i in batch])
                starts = np.cumsum(sizes) - sizes
                margin, vx, sums = machine._passes(places, values, starts)
                error = _sigmoid(margin) - labels[batch]
                pull = np.repeat(error, sizes) * values
                touched, at = np.unique(places, return_inverse=True)
                step_w = np.bincount(at, pull) + SHRINK * machine.w[touched]
                by_pair = pull[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
                step_v = np.stack([np.bincount(at, by_pair[:, f]) for f in range(rank)], axis=1) + SHRINK * machine.v[touched]
                seen_w[touched] += step_w * step_w
                seen_v[touched] += step_v * step_v
                seen_b += error.sum() ** 2
                machine.w[touched] -= RATE * step_w / np.sqrt(seen_w[touched])
                machine.v[touched] -= RATE * step_v / np.sqrt(seen_v[touched])
                machine.bias -= RATE * error.sum() / math.sqrt(seen_b)
        return machine


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Machine | None:
    """The machine fitted to labelled documents; None where there are none.

    Labels (0 or 1, or between) of one id are averaged; null ids and null labels
    go. Of the ids that have both a label and a document, the ``fit_rows`` of
    least hash are learned from (a documented bound of the fit); of documents
    that share an id, the one of least text. Columns may have any other names
    besides; size_col may be None.
    """
    work = Workspace(docs.sparkSession, "quality")
    rows = _plain(docs, id_col, text_col, size_col)
    marks = labels.select(common.named(id_col).alias("id"), common.named(label_col).cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    marks = marks.groupBy("id").agg(F.avg("label").alias("label")).join(rows.select("id").distinct(), "id", "left_semi")
    chosen = work.save(marks.withColumn("turn", F.xxhash64("id")).orderBy("turn", "id").limit(fit_rows), "chosen")
    # at most fit_rows rows of three numbers
    texts = rows.join(F.broadcast(chosen), "id").groupBy("id", "turn", "label").agg(F.min(F.struct("text", "size")).alias("row"))

    def learn(batches):
        found, labels_seen, memo = [], [], common.Memo()
        for batch in batches:
            for text, size, label in zip(*(common.column(batch, c) for c in ("text", "size", "label")), strict=True):
                places, values = features_of(text, size, memo)
                found.append((places.astype(np.int32), values.astype(np.float32)))
                labels_seen.append(min(1.0, max(0.0, label)))
        if found:
            machine = Machine.fit(found, np.array(labels_seen))
            yield pa.RecordBatch.from_arrays([pa.array([machine.bias]), pa.array([machine.w.astype("<f4").tobytes()], pa.binary()), pa.array([machine.v.astype("<f4").tobytes()], pa.binary())], names=["bias", "w", "v"])

    ordered = texts.select("turn", "id", "label", "row.text", "row.size").repartition(1).sortWithinPartitions("turn", "id").select("text", "size", "label")
    fitted = ordered.mapInArrow(common.tidy(learn), "bias double, w binary, v binary").first()
    work.clear()
    if fitted is None:
        return None
    return Machine(fitted[0], np.frombuffer(fitted[1], "<f4"), np.frombuffer(fitted[2], "<f4").reshape(FEATURES, -1))


def _plain(docs: DataFrame, id_col: str, text_col: str, size_col: str | None) -> DataFrame:
    size = F.lit(None) if size_col is None else common.named(size_col)
    return docs.select(common.named(id_col).alias("id"), common.named(text_col).alias("text"), size.cast("long").alias("size"))


def score_quality(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", keep: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, the ``keep`` columns, score (0 to 1, higher is better), predicted (1 from 0.5 on).

    Whole texts count; a null text scores as an empty one, and a null size as
    unknown. Without a machine every score is 0.5. Repeated rows score alike, an
    empty table gives no rows, other columns go.
    """
    # FEATURES x (1 + RANK) numbers whatever the data
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    name = f"quality:{uuid.uuid4()}"
    rows = docs.select(common.named(text_col).alias("__text"), (F.lit(None) if size_col is None else common.named(size_col)).cast("long").alias("__size"), common.named(id_col).alias("doc_id"), *map(common.named, keep or []))

    def scores(texts: list, sizes: list) -> np.ndarray:
        machine = sent.value
        if machine is None:
            return np.full(len(texts), 0.5)
        memo = common.per_process(name, common.Memo)
        found = [features_of(t, n, memo) for t, n in zip(texts, sizes, strict=True)]
        places, values = (np.concatenate([x[j] for x in found]) for j in range(2))
        counts = np.array([len(x[0]) for x in found])
        return _sigmoid(machine.margins(places, values, np.cumsum(counts) - counts))

    def run(batches):
        for batch in batches:
            texts, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = np.concatenate([scores(texts[a:b], sizes[a:b]) for a, b in common.slices(texts)]) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(found, pa.float64()), pa.array(found >= 0.5).cast(pa.int32())], names=[*batch.schema.names[2:], "score", "predicted"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[2:]]
    return rows.mapInArrow(common.tidy(run), ", ".join([*fields, "score double", "predicted int"]))
