"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chat, decontaminate, infill, language, lines, packing, pii, quality, sharding, simhash, token_files, viterbi

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_token_counts": viterbi.op2_token_counts,
    "op3_simhash": simhash.op3_simhash,
    "op4_language": language.op4_language,
    "op5_pack": packing.op5_pack,
    "op6_quality": quality.op6_quality,
    "op7_kd_shards": sharding.op7_kd_shards,
    "op8_pii": pii.op8_pii,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_chat_format": chat.op10_chat_format,
    "op11_infill": infill.op11_infill,
    "op12_alignment": alignment.op12_alignment,
    "op13_token_files": token_files.op13_token_files,
}
ORACLES: dict[str, str] = {"op9_line_dedup": lines.OP9_SQL, "op10_chat_format": chat.OP10_SQL, "op11_infill": infill.OP11_SQL}
