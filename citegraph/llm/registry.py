"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from citegraph.llm import audit, credentials, decontaminate, html, neardup, packing, ppm, quality, sharding, tokens, toxicity, urls, whiten

QUERIES = {
    "op1_near_dedup": neardup.op1_near_dedup,
    "op2_html_extraction": html.op2_html_extraction,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_toxicity_crf": toxicity.op6_toxicity_crf,
    "op7_extendible_hashing": sharding.op7_extendible_hashing,
    "op8_url_filters": urls.op8_url_filters,
    "op9_lm_scoring": ppm.op9_lm_scoring,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_embedding_whitening": whiten.op11_embedding_whitening,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_secret_scan": credentials.op13_secret_scan,
}

ORACLE_SQL = {
    "op4_quality_rules": quality.OP4_SQL,
    "op7_extendible_hashing": sharding.OP7_SQL,
    "op12_filter_audit": audit.OP12_SQL,
}
