"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; an empty table passes through all of them. All but the last return the
columns they were given, whatever their names. Stages are lazy or
write their own tables; run() writes each stage's result to the shared folder
and reads it back, so that a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm.language_id import accept_known_language, fit_language_model
from fieldloom.llm.mixing import mix_documents
from fieldloom.llm.near_dedup import near_dedup
from fieldloom.llm.piece_model import bpe_round_trip
from fieldloom.llm.radix_dedup import exact_dedup
from fieldloom.llm.registry import MIX, PIECES, RANKS
from fieldloom.session import Workspace, read_table

def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; the model learns from the labelled ones among them.

    Null texts, texts without a letter and texts in none of the languages go;
    short texts stay. Without a labelled document all go.
    """
    path = public_tokenizers.path(PIECES)
    return accept_known_language(docs, fit_language_model(docs, path), path)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest id; null ids and null texts are as in exact_dedup."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least id; texts without a word equal only each other."""
    return near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, none, one or two times; null sources are one source."""
    return mix_documents(docs, **MIX)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text they decode to, a row for each row; a null text counts as empty."""
    return bpe_round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("bpe", encode_pieces),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table."""
    work = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
