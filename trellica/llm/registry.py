"""Queries and oracle SQL of this subpackage, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trellica.llm import centroids, chat_format, decontaminate, embedding_dedup, lexical_search, line_dedup, lm_score, mixing, ngram_join, quality, sharding, topk_search, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_quality": quality.op4_quality,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_sharding": sharding.op10_sharding,
    "op11_topk_search": topk_search.op11_topk_search,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_centroids": centroids.op13_centroids,
}

ORACLES: dict[str, str] = {
    "op3_decontamination": decontaminate.ORACLE,
    "op5_embedding_dedup": embedding_dedup.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op8_ngram_join": ngram_join.ORACLE,
    "op9_chat_format": chat_format.ORACLE,
    "op10_sharding": sharding.ORACLE,
    "op11_topk_search": topk_search.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
