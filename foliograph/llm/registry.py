"""Queries of the thirteen operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliograph.llm import chat, decontamination, embeddings, mixing, packing, paragraphs, quality, ranking, secrets, simhash, substrings, toxicity, trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.query,
        "op2_embedding_dedup": embeddings.query,
        "op3_secret_scan": secrets.query,
        "op4_substring_dedup": substrings.query,
        "op5_toxicity": toxicity.query,
        "op6_paragraph_dedup": paragraphs.query,
        "op7_packing": packing.query,
        "op8_quality_rules": quality.query,
        "op9_mixing": mixing.query,
        "op10_chat_format": chat.query,
        "op11_ranked_search": ranking.query,
        "op12_conversation_trie": trie.query,
        "op13_decontamination": decontamination.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": mixing.sql(), "op11_ranked_search": ranking.sql(), "op12_conversation_trie": trie.sql(), "op13_decontamination": decontamination.sql()}
