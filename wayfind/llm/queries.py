"""Queries of this subpackage and the SQL that repeats them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html_text, line_dedup, lm_score, media, mixing, near_dedup, repair, runs, toxicity, url_filter, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_mixing": mixing.op5_mixing,
    "op6_chat_format": chat.op6_chat_format,
    "op7_media_columns": media.op7_media_columns,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_html_text": html_text.op9_html_text,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
    "op11_embedding_near_dedup": vectors.op11_embedding_near_dedup,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_conversation_repair": repair.op13_conversation_repair,
}
SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op4_url_filter": url_filter.SQL,
    "op5_mixing": mixing.SQL,
    "op6_chat_format": chat.SQL,
    "op7_media_columns": media.SQL,
    "op10_minhash_near_dedup": near_dedup.SQL,
    "op11_embedding_near_dedup": vectors.SQL,
    "op13_conversation_repair": repair.SQL,
}
