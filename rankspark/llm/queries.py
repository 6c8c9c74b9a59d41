"""The registered queries of this subpackage and their DuckDB twins (none where SQL cannot express the operator)."""

from __future__ import annotations

from rankspark.llm import (chat_format, decontaminate, fill_middle, fingerprint, jaccard_join, language_id, lexical_search, line_dedup, lm_score, mixing,
                           personal_data, substring_dedup, url_filter)

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_fingerprint": fingerprint.op3_fingerprint,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_mixing": mixing.op7_mixing,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_personal_data": personal_data.op13_personal_data,
}

ORACLE = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op6_chat_format": chat_format.OP6_SQL,
    "op9_jaccard_join": jaccard_join.OP9_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
    "op11_fill_middle": fill_middle.OP11_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
}
