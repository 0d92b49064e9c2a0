"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import digest_chats, format_chats
from .common import table
from .conversation_repair import damaged, repair_report, repair_sql
from .hnsw_index import build_index, search_index
from .mpeg_audio import audio_features
from .quality_classifier import quality_scores
from .sentencepiece_fst import encoded, read_model
from .simhash_dedup import hex_print, near_duplicates
from .source_divergence import divergence, divergence_sql
from .source_mixing import mixing_report, mixing_sql
from .suffix_dedup import repeat_report
from .url_filters import verdicts, verdicts_sql
from .vector_packing import packed
from .warc_archive import archived_pages

#: The public tokenizer whose model operator 9 compiles; read by the driver.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Operator 8's rules by its contract. Its SQL, like the operator's own default, has the two rules of net with each other's action.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digest_chats(format_chats(rows.unionByName(planted)))


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_report(table(spark, sf_dir, "documents"))


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search_index(build_index(rows), rows.filter("vec_id % 100 = 0"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"), words=4, limit=4)
    return rows.select("doc_id", hex_print().alias("fingerprint"), "component_id")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "pages"), URL_RULES).drop("group")


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model: str = TOKENIZER) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), read_model(model))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_source_mixing, op3_chat_format, op4_hnsw, op5_simhash, op6_mpeg_audio, op7_quality, op8_url_filters, op9_sentencepiece, op10_suffix_dedup, op11_source_divergence, op12_vector_packing, op13_conversation_repair)}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Of the digest's hex digits, five at a time, four base32 digits.
_DIGEST = f"list_aggregate(list_transform(range(0, 32), lambda i: substr('{_BASE32}', 1 + ((('0x' || substr(sha1(html), 1 + i // 4 * 5, 5))::BIGINT >> (15 - i % 4 * 5)) & 31), 1)), 'string_agg', '')"

OP1_SQL = f"""
WITH rows_ AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_DIGEST} AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM rows_)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to FROM g
"""

OP3_SQL = r"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
made AS (SELECT *, regexp_replace(text, '(<\\*s>|<\\*/s>|<\\*<SYS>>|<\\*</SYS>>|\[\\*INST\]|\[\\*/INST\]|\[\\*ANS\]|\[\\*ROLE |\[\\*/ROLE\])', 'x\1', 'g') AS longer FROM rows_)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
sum(length(longer) + CASE role WHEN 'user' THEN 18 WHEN 'system' THEN 20 WHEN 'assistant' THEN 14 ELSE 20 + length(role) END)::BIGINT AS formatted_chars
FROM made GROUP BY conv_id
"""

SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op2_source_mixing": mixing_sql(), "op3_chat_format": OP3_SQL, "op8_url_filters": verdicts_sql(), "op11_source_divergence": divergence_sql(), "op13_conversation_repair": repair_sql()}
