"""The opN queries and their SQL."""

from __future__ import annotations

from inkwell.llm import bpe, line_dedup, mixing, quality_model, quality_rules, simhash, toxicity, url_model, warc, winnow


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1,
        "op2_winnowing": winnow.op2,
        "op3_mixing": mixing.op3,
        "op4_warc": warc.op4,
        "op5_simhash": simhash.op5,
        "op6_line_dedup": line_dedup.op6,
        "op7_quality": quality_model.op7,
        "op8_url_filter": url_model.op8,
        "op9_toxicity": toxicity.op9,
        "op10_bpe": bpe.op10,
    }


def oracle_sql() -> dict:
    return {
        "op1_quality_rules": quality_rules.SQL,
        "op3_mixing": mixing.SQL,
        "op4_warc": warc.SQL,
        "op6_line_dedup": line_dedup.SQL,
    }
