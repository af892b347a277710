"""The queries of this subpackage by name, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hourloom.llm import (
    bpe,
    conversation_repair,
    embedding_dedup,
    exact_dedup,
    hard_negatives,
    language_id,
    line_dedup,
    mixing,
    near_dedup,
    pieces,
    sharding,
    toxicity,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_language_id": language_id.op5_language_id,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op8_sharding": sharding.op8_sharding,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_pieces": pieces.op12_pieces,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
