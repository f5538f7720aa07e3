"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.conversation_repair import audit_conversations
from fieldloom.llm.language_id import fit_language_model, holdout, predict_language
from fieldloom.llm.lexical_search import wand_search
from fieldloom.llm.lm_score import score_documents
from fieldloom.llm.mixing import pareto_mix
from fieldloom.llm.near_dedup import near_classes
from fieldloom.llm.piece_model import bpe_round_trip
from fieldloom.llm.quality import fit_quality, score_quality
from fieldloom.llm.radix_dedup import radix_groups
from fieldloom.llm.sharding import shard_documents
from fieldloom.llm.token_counts import token_counts
from fieldloom.llm.token_file import read_token_shards, write_token_shards
from fieldloom.llm.vector_topk import exact_topk, quantise
from fieldloom.session import Workspace, read_table

#: Fixed values of the query contracts.
BYTE_BPE, BYTE_BPE_IDS, END_ID = "byte_bpe_50k.json", 50_257, 2
RANKS = "byte_bpe_multi_50k.tiktoken"
LM_FOLDS, LANG_FOLDS, LANG_HELD = 10, 4, 2
PIECES = "piece_bpe_32k.model"
WORD_BPE, TOKEN_LIMIT = "word_bpe_49k.json", 2048
MIX = {"weights": [3, 1, 2], "share": 1.5, "most": 2.0, "seed": "mix", "length_power": 0.5}
SHARDS = 16
TOP_K, QUERY_EVERY = 20, 20
HITS = 10
QUALITY_FOLDS, QUALITY_HELD = 3, 1


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    uri = Workspace(spark, "token_files").uri("shards")
    manifest = write_token_shards(docs, uri, public_tokenizers.path(BYTE_BPE), BYTE_BPE_IDS, END_ID)
    return read_token_shards(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_groups(read_table(spark, sf_dir, "documents")).drop("row_id")


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), holdout("doc_id", LM_FOLDS) == 0)


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(read_table(spark, sf_dir, "documents"), **MIX).select("doc_id", "size", "source_size", "target", "taken")


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_documents(read_table(spark, sf_dir, "documents"), SHARDS)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (holdout("doc_id", LANG_FOLDS) == LANG_HELD).alias("held_out"))
    path = public_tokenizers.path(PIECES)
    model = fit_language_model(docs.where("NOT held_out"), path)
    return predict_language(docs, model, path, keep=["held_out"])


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), TOKEN_LIMIT)


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", quantise("embedding").alias("values"))
    return exact_topk(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0), TOP_K)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", (holdout("doc_id", QUALITY_FOLDS) == QUALITY_HELD).alias("held_out"))
    model = fit_quality(docs.where("NOT held_out"), read_table(spark, sf_dir, "labels"))
    return score_quality(docs, model, keep=["held_out"])


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_conversations(read_table(spark, sf_dir, "conversations"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), HITS)


QUERIES = {
    f.__name__: f
    for f in (op1_token_file, op2_radix_dedup, op3_piece_codec, op4_lm_score, op5_pareto_mix, op6_histogram_shards, op7_near_classes, op8_language_id, op9_token_counts, op10_exact_topk, op11_quality, op12_conversation_repair, op13_lexical_search)
}

ORACLE_SQL: dict[str, str] = {
    "op2_radix_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op10_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE a.vec_id % 20 = 0),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op12_conversation_repair": """
        WITH RECURSIVE told AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS chars
            FROM conversations),
        fates AS (
            SELECT conv_id, turn, role, text,
                   xor(4294967295::BIGINT, list_reduce(
                       list_prepend(4294967295::BIGINT, list_transform(chars, lambda c: ascii(c)::BIGINT)),
                       lambda crc, byte: list_reduce(
                           [xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                           lambda x, zero: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS fate
            FROM told),
        harmed AS (
            SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM fates WHERE fate <> 0),
        numbered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text[1:64], sha256(text), copy) AS k FROM harmed),
        faults AS (
            SELECT *, role[1:1] AS initial,
                   CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1
                        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2
                        WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault,
                   lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY k) || role[1:1] AS pair
            FROM numbered),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
                   count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                   count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM faults GROUP BY conv_id),
        -- least cost of what follows turn k - 1, from: nothing yet, system, user, whole exchange
        costs AS (
            SELECT conv_id, n + 1 AS k, 0 AS nil, 6 AS sys, 3 AS usr, 0 AS pair FROM counts
            UNION ALL
            SELECT conv_id, k, least(nil, 3 + least(usr, 3 + pair)), least(sys, 3 + least(usr, 3 + pair)), least(usr, 3 + pair), least(pair, 3 + usr)
            FROM (
                SELECT f.conv_id, f.k, more,
                       least(4 + c.nil, far + more + least(3 + c.usr, CASE initial WHEN 's' THEN c.sys WHEN 'u' THEN c.usr ELSE 999 END)) AS nil,
                       least(4 + c.sys, far + more + least(3 + c.usr, CASE initial WHEN 'u' THEN c.usr ELSE 999 END)) AS sys,
                       least(4 + c.usr, far + more + least(3 + c.pair, CASE initial WHEN 'a' THEN c.pair ELSE 999 END)) AS usr,
                       least(4 + c.pair, far + more + least(3 + c.usr, CASE initial WHEN 'u' THEN c.usr ELSE 999 END)) AS pair
                FROM costs c JOIN (
                    SELECT *, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS more, CASE WHEN fault IN (1, 2) THEN 99999 ELSE 0 END AS far FROM faults
                ) f ON f.conv_id = c.conv_id AND f.k = c.k - 1)),
        states AS (
            SELECT c.conv_id, c.k, s.state, [c.nil, c.sys, c.usr, c.pair][s.state] AS now,
                   [c.usr, c.usr, c.pair, c.usr][s.state] AS put, [3, 3, 4, 3][s.state] AS put_state,
                   CASE WHEN s.state = 3 THEN 'assistant' ELSE 'user' END AS put_role
            FROM costs c, (SELECT unnest([1, 2, 3, 4]) AS state) s),
        moves AS (
            SELECT b.*, a.role, a.text, a.fault, d.now AS dropped, t.now AS rerole,
                   CASE WHEN a.fault NOT IN (1, 2) THEN
                       CASE WHEN a.initial = 's' AND b.state = 1 THEN 2 WHEN a.initial = 'u' AND b.state <> 3 THEN 3 WHEN a.initial = 'a' AND b.state = 3 THEN 4 END
                   END AS keep_state
            FROM states b
            LEFT JOIN faults a ON a.conv_id = b.conv_id AND a.k = b.k
            LEFT JOIN states d ON d.conv_id = b.conv_id AND d.k = b.k + 1 AND d.state = b.state
            LEFT JOIN states t ON t.conv_id = b.conv_id AND t.k = b.k + 1 AND t.state = b.put_state),
        best AS (
            SELECT m.*, CASE WHEN m.now = 4 + m.dropped THEN 'D' WHEN m.now = 3 + m.put THEN 'I'
                             WHEN m.now = kept.now + CASE WHEN m.fault = 3 THEN 3 ELSE 0 END THEN 'K' WHEN m.role IS NOT NULL THEN 'R' END AS edit
            FROM moves m LEFT JOIN states kept ON kept.conv_id = m.conv_id AND kept.k = m.k + 1 AND kept.state = m.keep_state),
        walk AS (
            SELECT conv_id, 1::BIGINT AS k, 1 AS state, '' AS audit, [] :: VARCHAR[] AS lines FROM counts
            UNION ALL
            SELECT w.conv_id, CASE WHEN edit = 'I' THEN w.k ELSE w.k + 1 END,
                   CASE edit WHEN 'D' THEN w.state WHEN 'K' THEN keep_state ELSE put_state END, w.audit || edit,
                   CASE edit WHEN 'D' THEN w.lines WHEN 'K' THEN list_append(w.lines, b.role || ':' || b.text)
                             WHEN 'R' THEN list_append(w.lines, b.put_role || ':' || b.text) ELSE list_append(w.lines, b.put_role || ':') END
            FROM walk w JOIN best b ON b.conv_id = w.conv_id AND b.k = w.k AND b.state = w.state
            WHERE edit IS NOT NULL),
        ended AS (
            SELECT w.conv_id, w.audit, w.lines, c.nil AS cost
            FROM walk w JOIN counts n ON n.conv_id = w.conv_id AND w.k = n.n + 1 AND w.state IN (1, 4)
            JOIN costs c ON c.conv_id = w.conv_id AND c.k = 1)
        SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
               coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts USING (conv_id) LEFT JOIN ended USING (conv_id)
    """,
    "op13_lexical_search": """
        WITH words AS (
            SELECT row_number() OVER () AS row, doc_id,
                   list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
                                  lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms
            FROM documents),
        sized AS (SELECT row, doc_id, terms, len(terms)::HUGEINT AS n FROM words WHERE len(terms) > 0),
        whole AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS len FROM sized),
        slopes AS (SELECT row, doc_id, 10 + (90 * n * docs) // len AS m FROM sized, whole),
        tfs AS (SELECT row, term, count(*)::HUGEINT AS tf FROM (SELECT row, unnest(terms) AS term FROM sized) GROUP BY row, term),
        weights AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::HUGEINT AS w FROM tfs, whole GROUP BY term, docs),
        asked AS (
            SELECT DISTINCT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
                                            lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term
            FROM benchmark),
        scores AS (
            SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN slopes USING (row)
            GROUP BY item_id, row, doc_id),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
}
