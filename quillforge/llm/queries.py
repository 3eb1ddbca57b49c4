"""The queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_formatting import ORACLE_SQL as CHAT_SQL
from .chat_formatting import REPLY, link_tool_calls, turns_as_calls
from .classifiers import quality, toxicity
from .common import hex_digest, prepare, table
from .decontamination import leaks
from .html_extraction import extract_pages
from .jaccard_join import jaccard_join
from .media import media_columns, media_digests
from .mixing import ORACLE_SQL as MIXING_SQL
from .mixing import mix_sources
from .packing import pack_tokens
from .simhash import simhash_dedup
from .spelling import spelling_variants
from .window_dedup import window_dedup


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard_join(table(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(table(spark, sf_dir, "documents"))


def op3_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    kept = window_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", hex_digest(F.encode("text", "UTF-8")).alias("kept_sha256"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = link_tool_calls(turns_as_calls(table(spark, sf_dir, "conversations")), REPLY)
    return lines.select("conv_id", "position", "turn", "kind", "call_id", "linked", "valid", F.array_join("errors", "; ").alias("errors"), "json")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(media_columns(table(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_token_packing, op3_window_dedup, op4_quality, op5_chat_formatting, op6_html_extraction, op7_media_columns, op8_decontamination, op9_jaccard_join, op10_mixing, op11_simhash_dedup, op12_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_formatting": CHAT_SQL, "op10_mixing": MIXING_SQL}
