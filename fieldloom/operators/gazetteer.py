"""Whole gazetteers looked for in texts: every occurrence of every name, with offsets.

Names become a trie of words (or of characters) whose states have failure links
(Aho-Corasick), so a text is read once, whatever the number of names and their
words. Names are dealt by hash into parts of bounded size, each of which is an
automaton that workers are sent; texts pass by each part without a shuffle. A
gazetteer of any size is so handled; one below the bound costs one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words or characters of the names of one automaton, which bounds what a worker is sent.
SYMBOLS = 400_000
WORD = re.compile(r"[^\W_]+")


class Automaton:
    """All patterns (sequences of symbols) at once."""

    def __init__(self, patterns: Iterable[Sequence]):
        self.next: list[dict] = [{}]
        self.fail, self.pattern, self.depth = [0], [-1], [0]
        for i, symbols in enumerate(patterns):
            state = 0
            for symbol in symbols:
                to = self.next[state].get(symbol)
                if to is None:
                    to = self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.pattern.append(-1)
                    self.depth.append(self.depth[state] + 1)
                state = to
            if state and self.pattern[state] < 0:
                self.pattern[state] = i
        # the nearest state on the way of failure links, itself included, at which a pattern ends
        self.ends = [0] * len(self.next)
        order = [0]
        for state in order:
            for symbol, to in self.next[state].items():
                order.append(to)
                if state:
                    back = self.fail[state]
                    while back and symbol not in self.next[back]:
                        back = self.fail[back]
                    self.fail[to] = self.next[back].get(symbol, 0)
                self.ends[to] = to if self.pattern[to] >= 0 else self.ends[self.fail[to]]

    def find(self, symbols: Sequence) -> Iterator[tuple[int, int, int]]:
        """(pattern, place of its first symbol, place after its last) of every occurrence, by end, long ones first."""
        state, following, fail = 0, self.next, self.fail
        for at, symbol in enumerate(symbols, 1):
            while state and symbol not in following[state]:
                state = fail[state]
            state = following[state].get(symbol, 0)
            hit = self.ends[state]
            while hit:
                yield self.pattern[hit], at - self.depth[hit], at
                hit = self.ends[fail[hit]]


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return [w.lower() for w in WORD.findall(text)]


def _normal(df: DataFrame, name: str, unit: str) -> DataFrame:
    """name, key (its normal form), size of every distinct name that has one."""

    def run(batches):
        for batch in batches:
            rows = [(n, words_of(n) if unit == "word" else n.lower()) for n in batch.column(0).to_pylist()]
            rows = [(n, " ".join(k) if unit == "word" else k, len(k)) for n, k in rows if k]
            names, keys, sizes = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys, pa.string()), pa.array(sizes, pa.int64())], names=["name", "key", "size"])

    asked = df.select(F.col(name).cast("string").alias("name")).where("name IS NOT NULL").distinct()
    return asked.mapInArrow(run, "name string, key string, size long")


def _parts(keys: DataFrame, bound: int) -> list[list[str]] | Iterator[list[str]]:
    """Keys in parts of at most twice the bound, but for a key that is longer by itself."""
    n = max(1, -(-(keys.agg(F.sum("size")).first()[0] or 0) // bound))
    while True:
        dealt = keys.withColumn("part", F.pmod(F.xxhash64("key", F.lit(n)), F.lit(n)))
        sizes = dealt.groupBy("part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        if sizes.where((F.col("size") > 2 * bound) & (F.col("n") > 1)).isEmpty():
            return (sorted(r[0] for r in dealt.where(F.col("part") == i).select("key").toLocalIterator()) for i in range(n))
        n *= 2


def occurrences(names: DataFrame, name: str, texts: DataFrame, id_col: str, text_col: str, unit: str = "word", bound: int = SYMBOLS) -> DataFrame:
    """id, key, start, stop: every occurrence of every name in every text, those within others too.

    With unit "word", a name is its runs of letters and digits in lower case
    (key, joined by blanks), and occurs where a text has these runs in a row,
    whatever stands between; with "character", it is the name itself in lower
    case, found anywhere. start and stop count characters of the text as it is
    (for "character", of the text in lower case). Names that are null or have no
    symbol, and null texts, give nothing; names of one normal form count once;
    repeated rows of texts repeat.
    """
    spark = texts.sparkSession
    keys = _normal(names, name, unit).groupBy("key").agg(F.first("size").alias("size"))
    kind = texts.schema[id_col].dataType.simpleString()
    found = [_pass_by(texts.select(id_col, text_col), part, unit, kind) for part in _parts(keys, bound)]
    out = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"id {kind}, key string, start int, stop int")
    return out.withColumnRenamed("id", id_col)


def _pass_by(texts: DataFrame, part: list[str], unit: str, kind: str) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast((part, Automaton(k.split(" ") if unit == "word" else k for k in part)))

    def run(batches):
        keys, automaton = sent.value
        for batch in batches:
            at, places = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                if unit == "word":
                    spans = [m.span() for m in WORD.finditer(text)]
                    found = [(p, spans[a][0], spans[b - 1][1]) for p, a, b in automaton.find([text[a:b].lower() for a, b in spans])]
                else:
                    found = list(automaton.find(text.lower()))
                places += found
                at += [i] * len(found)
                if len(at) >= 50_000:
                    yield emit(batch, at, places)
                    at, places = [], []
            yield emit(batch, at, places)

    def emit(batch, at, places):
        keys = sent.value[0]
        columns = list(zip(*places, strict=True)) if places else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int64())), pa.array([keys[p] for p in columns[0]], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())],
            names=["id", "key", "start", "stop"],
        )

    return texts.mapInArrow(run, f"id {kind}, key string, start int, stop int")


def mentions(names: DataFrame, name: str, texts: DataFrame, id_col: str, text_col: str, unit: str = "word", bound: int = SYMBOLS) -> DataFrame:
    """(id, name) where a text holds a name, of any number of words; names as they were given."""
    hits = occurrences(names, name, texts, id_col, text_col, unit, bound).select(id_col, "key").distinct()
    return hits.join(_normal(names, name, unit).select("name", "key"), "key").select(id_col, "name").distinct()


def area_lookup(asked: DataFrame, query: str, areas: DataFrame, area: str, order: list[str], fields: list[str], bound: int = SYMBOLS) -> DataFrame:
    """query, match (exact or part), fields: of the area of the query's name, else of the first that holds it or that it holds.

    Names are compared in lower case, without blanks around them; blank queries
    and areas match nothing. Of several areas the first in ``order`` counts.
    Queries without a match give no row.
    """
    q = asked.select(F.lower(F.trim(F.col(query).cast("string"))).alias("q")).where("q <> ''").distinct()
    a = areas.select(F.lower(F.trim(F.col(area).cast("string"))).alias("a"), F.struct(*order).alias("o"), F.struct(*fields).alias("f")).where("a <> ''")
    best = a.groupBy("a").agg(F.min_by("f", "o").alias("f"), F.min("o").alias("o"))
    within = occurrences(q, "q", best, "a", "a", "character", bound).select(F.col("key").alias("q"), "a")
    around = occurrences(best, "a", q, "q", "q", "character", bound).select("q", F.col("key").alias("a"))
    pairs = within.unionByName(around).distinct().join(best, "a")
    rank = F.struct((F.col("q") != F.col("a")).alias("partly"), F.col("o"))
    found = pairs.groupBy("q").agg(F.min_by(F.struct(F.when(F.col("q") == F.col("a"), "exact").otherwise("part").alias("match"), "f"), rank).alias("m"))
    return found.select(F.col("q").alias("query"), "m.match", "m.f.*")
