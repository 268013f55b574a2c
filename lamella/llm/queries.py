"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamella.llm.chat import digests
from lamella.llm.common import table
from lamella.llm.exact_dedup import exact_groups
from lamella.llm.fingerprint import edited_likeness
from lamella.llm.html_text import main_texts
from lamella.llm.langid import languages_of
from lamella.llm.mixing import Mixture, draws_sql
from lamella.llm.pieces import Sampler
from lamella.llm.quality import quality_of
from lamella.llm.simhash import near_groups
from lamella.llm.toxicity import toxicity_of

Query = Callable[[SparkSession, str], DataFrame]


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third margin is the digest of the first line, which the SQL fixes: ``documents`` has no topic."""
    return Mixture().draws(table(spark, sf_dir, "documents"), topics=None)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The vocabulary file of the sampler.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op6_sentencepiece(spark: SparkSession, sf_dir: str, path: str = PIECES) -> DataFrame:
    return Sampler(path).encode(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages_of(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"'{said}' AS text")
    return digests(turns.unionByName(more))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality": op5_quality,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_language_id": op7_language_id,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_fingerprints": op10_fingerprints,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_source_mixing": draws_sql(),
    "op8_exact_dedup": f"""
        WITH x AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, {_LOWER} AS t FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               text_sha256
        FROM x
    """,
    "op9_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL
            SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i)
        ), e AS (
            SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS size FROM t
        )
        SELECT conv_id,
               count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(size) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
}
