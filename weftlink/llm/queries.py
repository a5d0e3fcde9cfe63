"""The subpackage's queries and their SQL, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftlink.llm import neardup, packing, pieces, quality, search, sharding, substrings, suffixes, token_counts, tokenfile


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality.op1,
        "op2_best_fit_packing": packing.op2,
        "op3_token_counts": token_counts.op3,
        "op4_token_id_output": tokenfile.op4,
        "op5_minhash_near_dedup": neardup.op5,
        "op6_bm25_search": search.op6,
        "op7_substring_dedup": substrings.op7,
        "op8_suffix_array_dedup": suffixes.op8,
        "op9_sentencepiece": pieces.op9,
        "op10_sharding": sharding.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.OP1_SQL, "op5_minhash_near_dedup": neardup.OP5_SQL, "op7_substring_dedup": substrings.OP7_SQL}
