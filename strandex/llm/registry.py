"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from strandex.llm import chat, decontaminate, exact, html, licence, lines, mixing, quality, sharding, simhash


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_licence": licence.op2_licence,
        "op3_exact": exact.op3_exact,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_lines": lines.op5_lines,
        "op6_preferences": chat.op6_preferences,
        "op7_shard": sharding.op7_shard,
        "op8_mix": mixing.op8_mix,
        "op9_quality": quality.op9_quality,
        "op10_extract": html.op10_extract,
    }


def oracle_sql() -> dict:
    return {
        "op3_exact": exact.SQL,
        "op6_preferences": chat.SQL,
        "op8_mix": mixing.SQL,
    }
