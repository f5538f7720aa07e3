"""Token counts with a whole-token shortcut.

Offline, once per vocabulary, every string that the vocabulary holds as a whole
word is encoded alone; those that come back as their own single id form the
proven table. A pre-token in it counts as one token; only the others are merged
by the library. Pre-tokens of this tokenizer never hold a blank, so counts add
up over blank-separated words, which are memoised.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import common
from fieldloom.llm.piece_model import byte_alphabet


class WordCounter:
    """Counts for a word-BPE file of the tokenizers library whose split pattern drops blanks."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if steps[0]["type"] != "Split" or not steps[0]["invert"] or steps[0]["behavior"] != "Removed":
            raise ValueError(f"{path} does not split by matches of a pattern")
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.whole = self.prove(spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or "")
        self.memo = common.Memo()
        self.merged = common.Memo(200_000)

    def prove(self, vocab: dict[str, int], suffix: str) -> frozenset[str]:
        """Vocabulary strings, as text, that are one pre-token and encode alone as their own id."""
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        texts, ids = [], []
        for piece, i in vocab.items():
            if piece.endswith(suffix) and piece not in self.special:
                try:
                    texts.append(bytes(byte[c] for c in piece.removesuffix(suffix)).decode())
                    ids.append(i)
                except (UnicodeDecodeError, KeyError):
                    continue
        alone = self.lib.encode_batch_fast(texts, add_special_tokens=False)
        return frozenset(t for t, i, e in zip(texts, ids, alone, strict=True) if e.ids == [i] and self.pattern.findall(t) == [t])

    def library(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def count_words(self, words: list[str]) -> list[int]:
        normal = self.lib.normalizer.normalize_str
        cut = [self.pattern.findall(w.lower() if w.isascii() else normal(w)) for w in words]
        whole, merged = self.whole, self.merged
        merged.learn({p for ps in cut for p in ps if p not in whole}, self.library)
        return [sum(1 if p in whole else merged[p] for p in ps) for ps in cut]

    def count(self, texts: list[str]) -> list[int]:
        words, new = [], set()
        for text in texts:
            odd = common.UNSURE_BLANKS.search(text) or any(s in text for s in self.special)
            words.append(None if odd else text.split())
            new.update(words[-1] or ())
        self.memo.learn(new, self.count_words)
        get = self.memo.__getitem__
        return [self.library([t])[0] if w is None else sum(map(get, w)) for w, t in zip(words, texts, strict=True)]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty; special strings inside a text count as the
    library counts them; ids may be of any type, null or repeated; repeated rows
    give repeated results; an empty table gives none; other columns are not read.
    """

    def count(batches):
        counter = common.per_process(f"counts:{tokenizer_path}", lambda: WordCounter(tokenizer_path))
        for batch in batches:
            texts = ["" if t is None else t for t in common.column(batch, "text")]
            for a, b in common.slices(texts):
                n = counter.count(texts[a:b])
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([len(common.utf8(t)) for t in texts[a:b]], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(common.named(id_col).alias("doc_id"), common.named(text_col).alias("text"))
    return rows.mapInArrow(common.tidy(count), f"doc_id {rows.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
