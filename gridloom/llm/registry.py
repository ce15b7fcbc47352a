"""The queries of this subpackage and their SQL."""

from . import chat, embedding_dedup, html_extract, language_model, line_dedup, mixing, packing, quality, simhash, token_counts

QUERIES = {
    "op1_embedding_near_dedup": embedding_dedup.op1_embedding_near_dedup,
    "op2_html_extraction": html_extract.op2_html_extraction,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_lm_scoring": language_model.op8_lm_scoring,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}

SQL = {
    "op3_chat_formatting": chat.OP3_SQL,
    "op6_mixing": mixing.OP6_SQL,
}
