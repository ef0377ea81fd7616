"""Queries of this subpackage and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontamination, fill_middle, html, line_dedup, media, mixing, near_dedup, sharding, spelling, suffix_dedup, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_sharding": sharding.op2_sharding,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_html_extraction": html.op5_html_extraction,
    "op6_media": media.op6_media,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mixing": mixing.op10_mixing,
    "op11_spelling": spelling.op11_spelling,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op3_near_dedup": near_dedup.ORACLE_SQL,
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
    "op11_spelling": spelling.ORACLE_SQL,
    "op13_fill_middle": fill_middle.ORACLE_SQL,
}
