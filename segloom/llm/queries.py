"""The queries of the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import conversation_repair, decontaminate, lexical_search, license_scan, line_dedup, lm_scoring, piece_coding, quality_model, quality_rules, secret_scan, simhash, source_mix, token_counts


def queries() -> dict:
    found = [
        simhash.op1_simhash, lm_scoring.op2_lm_scoring, secret_scan.op3_secret_scan, piece_coding.op4_piece_coding, token_counts.op5_token_counts,
        quality_rules.op6_quality_rules, line_dedup.op7_line_dedup, quality_model.op8_quality_model, license_scan.op9_license_scan, decontaminate.op10_decontaminate,
        conversation_repair.op11_conversation_repair, source_mix.op12_source_mix, lexical_search.op13_lexical_search,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": line_dedup.OP7_SQL, "op13_lexical_search": lexical_search.OP13_SQL}
