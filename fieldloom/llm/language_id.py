"""Language ID by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. A language is a probability
for each piece; the probability of a word is the sum over all its segmentations
into pieces of the product of their probabilities, which a forward pass over
the word's bytes computes. A text's is the product over its words. Piece
probabilities are fitted by expectation maximisation: a forward-backward pass
gives each piece's expected count over all segmentations.

Words are runs of letters and their marks in lower case, of any length; digits
and signs of any script part them. Passes are vectorised over words of equal
length and memoised by word. Where a product of a word's length could leave the
range of floating-point numbers, the pass adds logarithms instead.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import common
from fieldloom.session import Workspace

UNKNOWN = "und"
#: A text is in none of the languages learned if the best one explains it worse than evenly drawn pieces, by this much, in nats a byte.
LEAST_GAIN = -0.3
#: Training is bounded: at most this many labelled rows, those of least hashed id, are learned from.
FIT_ROWS = 12_000
EM_ROUNDS = 3
#: Parts of the table of distinct training words, for as many tasks.
FIT_PARTS = 24
#: Added to the expected count of every piece.
PRIOR = 0.02
_KEEP = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
#: Logarithm of the least number that a plain product may reach.
LEAST_LOG = -650.0


class Pieces:
    """The vocabulary as byte strings: a leading blank marks a word's start; every byte is a piece."""

    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_path)
        found = {bytes([b]): b for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                piece = model.id_to_piece(i).replace("▁", " ").encode()
                found.setdefault(piece, len(found))
        self.ids = found
        self.starts = {p[:k] for p in found for k in range(1, len(p) + 1)}
        self.longest = max(map(len, found))
        self.size = len(found)

    def edges(self, words: list[bytes]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, stop, word places, piece ids) of every match, by stop and then start; words are of one length."""
        get, out = self.ids.get, []
        length = len(words[0])
        for stop in range(1, length + 1):
            for start in range(max(0, stop - self.longest), stop):
                ids = [get(w[start:stop], -1) for w in words]
                ids = np.array(ids, np.int32)
                at = np.flatnonzero(ids >= 0)
                if len(at):
                    out.append((start, stop, at, ids[at]))
        return out


    def matches(self, word: bytes, start: int) -> list[tuple[int, int]]:
        """(stop, piece id) of every piece that the word has at start."""
        out, get = [], self.ids.get
        for stop in range(start + 1, min(len(word), start + self.longest) + 1):
            part = word[start:stop]
            if part not in self.starts:
                break
            if (found := get(part)) is not None:
                out.append((stop, found))
        return out


def _letter_runs():
    import regex

    return regex.compile(r"[\p{L}\p{M}]*\p{L}[\p{L}\p{M}]*")


def tokens_of(text: str) -> list[bytes]:
    """A text in lower case as UTF-8, parted at ASCII characters that are no letters."""
    return common.utf8(text.lower()).translate(_KEEP).split()


def words_in(token: bytes) -> list[bytes]:
    """The letter runs of a token."""
    if token.isascii():
        return [token]
    runs = common.per_process_child("letter_runs", _letter_runs)
    return [common.utf8(w) for w in runs.findall(token.decode("utf-8", "surrogatepass"))]


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def forward(edges: list, length: int, n: int, probs: np.ndarray) -> np.ndarray:
    """alpha[position, word, language]: summed probability of all segmentations up to a position."""
    alpha = np.zeros((length + 1, n, probs.shape[1]))
    alpha[0] = 1.0
    for start, stop, at, ids in edges:
        alpha[stop, at] += alpha[start, at] * probs[ids]
    return alpha


def backward(edges: list, length: int, n: int, probs: np.ndarray) -> np.ndarray:
    beta = np.zeros((length + 1, n, probs.shape[1]))
    beta[length] = 1.0
    for start, stop, at, ids in reversed(edges):
        beta[start, at] += probs[ids] * beta[stop, at]
    return beta


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Logarithm of the sum over the first axis, of logarithms."""
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


def log_forward(pieces: Pieces, word: bytes, log_probs: np.ndarray) -> np.ndarray:
    """The word's log probability per language, in logarithms throughout.

    Positions behind the longest piece are forgotten, so a word of any length
    takes memory for that many only.
    """
    waiting: dict[int, list[np.ndarray]] = {}
    alpha = np.zeros(log_probs.shape[1])
    for start in range(len(word)):
        if start:
            alpha = _log_sum(np.stack(waiting.pop(start)))
        for stop, piece in pieces.matches(word, start):
            waiting.setdefault(stop, []).append(alpha + log_probs[piece])
    return _log_sum(np.stack(waiting.pop(len(word)))) if len(word) else alpha


def log_expectations(pieces: Pieces, word: bytes, log_probs: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Piece ids and their expected numbers over all segmentations of a word, in one language (log_probs: per piece)."""
    edges = [(start, stop, piece) for start in range(len(word)) for stop, piece in pieces.matches(word, start)]
    alpha, beta = np.full(len(word) + 1, -np.inf), np.full(len(word) + 1, -np.inf)
    alpha[0] = beta[-1] = 0.0
    for start, stop, piece in edges:
        alpha[stop] = np.logaddexp(alpha[stop], alpha[start] + log_probs[piece])
    for start, stop, piece in reversed(edges):
        beta[start] = np.logaddexp(beta[start], log_probs[piece] + beta[stop])
    starts, stops, ids = (np.array(x) for x in zip(*edges, strict=True))
    return ids.tolist(), np.exp(alpha[starts] + log_probs[ids] + beta[stops] - alpha[-1])


def by_length(words: list[bytes], most: int = 4096):
    """Index lists of words of equal length, at most ``most`` at a time."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for length, places in groups.items():
        for a in range(0, len(places), most):
            yield length, places[a : a + most]


def plain_length(log_probs: np.ndarray) -> int:
    """The length in bytes up to which no product of piece probabilities can leave the range of numbers."""
    return max(1, int(LEAST_LOG / min(-1e-9, float(log_probs.min(initial=0.0)))))


class Scorer:
    """Log probabilities of tokens in every language."""

    def __init__(self, pieces: Pieces, log_probs: np.ndarray):
        self.pieces, self.log_probs, self.probs = pieces, log_probs, np.exp(log_probs)
        self.plain = plain_length(log_probs)
        self.memo = common.Memo(300_000)

    def score_words(self, words: list[bytes]) -> np.ndarray:
        """Of whole words, each with a blank before it that marks its start."""
        marked = [b" " + w for w in words]
        out = np.empty((len(words), self.probs.shape[1]))
        for length, places in by_length(marked):
            if length <= self.plain:
                # every byte is a piece, so no sum is 0
                out[places] = np.log(forward(self.pieces.edges([marked[i] for i in places]), length, len(places), self.probs)[length])
            else:
                for i in places:
                    out[i] = log_forward(self.pieces, marked[i], self.log_probs)
        return out

    def score_tokens(self, tokens: list[bytes]) -> list[np.ndarray]:
        cut = [words_in(t) for t in tokens]
        flat = list({w for ws in cut for w in ws})
        known = dict(zip(flat, self.score_words(flat), strict=True)) if flat else {}
        none = np.zeros(self.probs.shape[1])
        return [known[ws[0]] if len(ws) == 1 else sum((known[w] for w in ws), none) for ws in cut]

    def score(self, texts: list[str]) -> list[tuple[np.ndarray, int] | None]:
        """Summed log probabilities per language, and the bytes they are of; None for a text without a letter."""
        tokens = [tokens_of(t) if has_letter(t) else [] for t in texts]
        self.memo.learn({w for ws in tokens for w in ws}, self.score_tokens)
        get = self.memo.__getitem__
        return [(np.sum(list(map(get, ws)), axis=0), sum(map(len, ws))) if ws else None for ws in tokens]


def fit_language_model(labelled: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, rounds: int = EM_ROUNDS) -> dict:
    """Piece log probabilities and priors of every language of labelled rows.

    Rows without a text or language are left out. At most ``fit_rows`` rows are
    learned from, those of least hashed id (a documented bound on the fit; its
    word counts are distributed, and only pieces x languages reach the driver).
    Returns {"langs", "log_probs" (pieces x languages), "log_prior"}.
    """
    work = Workspace(labelled.sparkSession, "language")
    rows = labelled.select(common.named(lang_col).alias("lang"), common.named(text_col).alias("text"), F.xxhash64(common.named(id_col)).alias("turn")).where("text IS NOT NULL AND lang IS NOT NULL")
    cut = rows.select("turn").orderBy("turn").limit(fit_rows).agg(F.max("turn")).first()[0]
    if cut is None:
        return {"langs": [], "log_probs": np.zeros((0, 0)), "log_prior": np.zeros(0)}
    counted = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        held: dict[tuple[str, bytes], int] = {}
        for batch in batches:
            for lang, text in zip(common.column(batch, "lang"), common.column(batch, "text"), strict=True):
                for token in tokens_of(text):
                    held[lang, token] = held.get((lang, token), 0) + 1
                if len(held) > 400_000:
                    yield emit(held)
                    held = {}
        yield emit(held)

    def emit(held):
        return pa.record_batch([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.binary()), pa.array(held.values(), pa.int64())], counted)

    picked = rows.where(F.col("turn") <= cut)
    per_lang = {r[0]: r[1] for r in picked.groupBy("lang").count().collect()}
    langs = sorted(per_lang)
    words = work.save(picked.select("lang", "text").mapInArrow(common.tidy(count), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(FIT_PARTS), "words")
    pieces = Pieces(model_path)
    log_probs = np.full((pieces.size, len(langs)), -np.log(pieces.size))
    for _ in range(rounds):
        expected = _expected_counts(words, model_path, langs, log_probs)
        grown = expected + PRIOR
        log_probs = np.log(grown) - np.log(grown.sum(axis=0))
    total = sum(per_lang.values())
    return {"langs": langs, "log_probs": log_probs, "log_prior": np.log([per_lang[x] / total for x in langs])}


def _expected_counts(words: DataFrame, model_path: str, langs: list[str], log_probs: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces x languages) over all segmentations of all words."""
    schema = pa.schema([("lang", pa.int32()), ("piece", pa.int32()), ("n", pa.float64())])
    probs = np.exp(log_probs)

    plain = plain_length(log_probs)

    def expect(batches):
        pieces = common.per_process(f"pieces:{model_path}", lambda: Pieces(model_path))
        held = np.zeros((len(langs), pieces.size))
        waiting: dict[str, tuple[list[bytes], list[int]]] = {}
        n_waiting = 0
        for batch in batches:
            for lang, token, n in zip(*(common.column(batch, c) for c in ("lang", "word", "n")), strict=True):
                words, counts = waiting.setdefault(lang, ([], []))
                for word in words_in(token):
                    words.append(b" " + word)
                    counts.append(n)
            n_waiting += batch.num_rows
            if n_waiting > 40_000:
                flush(pieces, held, waiting)
                waiting, n_waiting = {}, 0
        flush(pieces, held, waiting)
        lang, piece = np.nonzero(held)
        yield pa.record_batch([pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(held[lang, piece])], schema)

    def flush(pieces, held, waiting):
        # many words at once, so that passes over words of one length are worth their while
        for lang, (words, counts) in waiting.items():
            add(pieces, held[langs.index(lang)], words, np.array(counts, float), probs[:, [langs.index(lang)]])

    def add(pieces, into, words, n, p):
        for length, places in by_length(words):
            if length > plain:
                for i in places:
                    ids, share = log_expectations(pieces, words[i], np.log(p[:, 0]))
                    np.add.at(into, ids, share * n[i])
                continue
            edges = pieces.edges([words[i] for i in places])
            alpha, beta = forward(edges, length, len(places), p), backward(edges, length, len(places), p)
            scale = n[places] / alpha[length, :, 0]
            for start, stop, at, ids in edges:
                np.add.at(into, ids, alpha[start, at, 0] * p[ids, 0] * beta[stop, at, 0] * scale[at])

    found = words.mapInArrow(common.tidy(expect), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((log_probs.shape[0], len(langs)))
    out[found["piece"], found["lang"]] = found["n"]
    return out


def _predictor(docs: DataFrame, model: dict, model_path: str):
    """A function from texts to (language, posterior, gain) triples, for Python workers.

    The gain is how much better the language explains the text's letters than a
    model in which all pieces are equally likely, in nats a byte.
    """
    langs, prior = list(model["langs"]), np.asarray(model["log_prior"])
    log_probs = np.asarray(model["log_probs"], np.float32)
    # pieces x languages numbers, so its size does not grow with the data
    sent = docs.sparkSession.sparkContext.broadcast(np.hstack([log_probs, np.full((len(log_probs), 1), -math.log(max(1, len(log_probs))), np.float32)]))
    name = f"scorer:{uuid.uuid4()}"

    def predict(texts: list[str | None]) -> list[tuple[str, float, float]]:
        if not langs:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        scorer = common.per_process(name, lambda: Scorer(Pieces(model_path), sent.value.astype(float)))
        texts, out = ["" if t is None else t for t in texts], []
        for a, b in common.slices(texts):
            for found in scorer.score(texts[a:b]):
                if found is None:
                    out.append((UNKNOWN, 0.0, 0.0))
                else:
                    own, even = found[0][:-1], found[0][-1]
                    x = own + prior
                    best = int(x.argmax())
                    out.append((langs[best], float(1.0 / np.exp(x - x[best]).sum()), float((own[best] - even) / found[1])))
        return out

    return predict


def predict_language(docs: DataFrame, model: dict, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, the ``keep`` columns, lang_pred, score.

    score is the posterior of the language among those learned, from 0 to 1. A
    null text or one without a letter is "und" with score 0, as is every text if
    nothing was learned. The whole text counts. Ids may be of any type; repeated
    rows give repeated results; an empty table gives none.
    """
    predict = _predictor(docs, model, model_path)
    rows = docs.select(common.named(text_col).alias("__text"), common.named(id_col).alias("doc_id"), *map(common.named, keep or []))

    def run(batches):
        for batch in batches:
            found = predict(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([n for n, _, _ in found], pa.string()), pa.array([s for _, s, _ in found], pa.float64())], names=[*batch.schema.names[1:], "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]]
    return rows.mapInArrow(common.tidy(run), ", ".join([*fields, "lang_pred string", "score double"]))


def accept_known_language(docs: DataFrame, model: dict, model_path: str, least_score: float = 0.0, least_gain: float = LEAST_GAIN, text_col: str = "text") -> DataFrame:
    """The rows of docs in a learned language, all columns as they are.

    A text goes if it is null or has no letter, if its language's posterior is
    below ``least_score``, or if that language explains its letters worse than
    evenly drawn pieces do, by more than ``-least_gain`` nats a byte, as is so
    for scripts in none of the languages learned. Short texts that several of
    them share stay. With nothing learned, all rows go. Repeated rows are
    treated alike; an empty table gives no rows. Columns may have any names.
    """
    predict, at = _predictor(docs, model, model_path), docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches):
        for batch in batches:
            found = predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= least_score and gain >= least_gain for n, s, gain in found], pa.bool_()))

    return plain.mapInArrow(common.tidy(run), plain.schema).toDF(*docs.columns)


def holdout(id_col: str, every: int) -> Column:
    """crc32 of the id as text, modulo ``every``; a null id's is that of an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % every
