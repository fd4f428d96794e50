"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import language_id
from tideline.llm.common import table
from tideline.llm.exact_dedup import exact_dedup
from tideline.llm.image_copies import draw, find_copies
from tideline.llm.order_minhash import near_classes
from tideline.llm.packing import pack
from tideline.llm.perspectives import rotate
from tideline.llm.piece_codec import encode_decode
from tideline.llm.pii import find_pii
from tideline.llm.substring_dedup import remove_repeats
from tideline.llm.token_counts import count_tokens

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    return seen.withColumn("mask", spans)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_keep")


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE), with_ids=False)


def op6_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cropped and darker copies of every twentieth row's picture, sought among the pictures of all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return find_copies(draw(vectors.filter("vec_id % 20 = 0"), edited=True), draw(vectors, edited=False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "scores")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_perspective_rotation": op1_perspective_rotation,
    "op2_token_counts": op2_token_counts,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_piece_codec": op5_piece_codec,
    "op6_image_copies": op6_image_copies,
    "op7_language_id": op7_language_id,
    "op8_order_minhash": op8_order_minhash,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op1_perspective_rotation": """
        WITH t AS (
            SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '<\\|') AS speaker, CAST(floor(turn / 64) AS BIGINT) AS block,
                   replace(coalesce(text, ''), '<|', '<\\|') || '<|end|>' || chr(10) AS said
            FROM conversations
        ), b AS (
            SELECT *, CAST((row_number() OVER (PARTITION BY conv_id, block ORDER BY turn, speaker, said) - 1) // 1024 AS BIGINT) AS part FROM t
        ), p AS (
            SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
        ), r AS (
            SELECT p.conv_id, p.perspective, b.block, b.part, b.turn, b.speaker, b.said, b.speaker = p.perspective AS mine,
                   CASE WHEN b.speaker = p.perspective THEN '<|assistant|>' WHEN b.speaker = 'system' THEN '<|system|>'
                        ELSE '<|user name=' || b.speaker || '|>' END || chr(10) AS head
            FROM p JOIN b ON b.conv_id IS NOT DISTINCT FROM p.conv_id
        ), o AS (
            SELECT *, sum(length(head) + length(said)) OVER (
                PARTITION BY conv_id, perspective, block, part ORDER BY turn, speaker, said
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
            FROM r
        )
        SELECT conv_id, perspective, block, part, count(*) AS n_turns,
               string_agg(head || said, '' ORDER BY turn, speaker, said) AS rendered,
               coalesce(string_agg(CASE WHEN mine THEN CAST(CAST(stop - length(said) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR) END, ','
                        ORDER BY turn, speaker, said), '') AS mask,
               CAST(sum(CASE WHEN mine THEN length(said) ELSE 0 END) AS BIGINT) AS n_masked
        FROM o GROUP BY conv_id, perspective, block, part
    """,
    "op4_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
}
