"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from tidewater.llm import bpe, exact_dedup, fill_middle, importance, licenses, line_dedup, near_dup, packing, pii, quality_fm, quality_rules, token_files, url_filters

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_bpe_round_trip": bpe.op3_bpe_round_trip,
    "op4_ngram_join": near_dup.op4_ngram_join,
    "op5_personal_data": pii.op5_personal_data,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_quality_classifier": quality_fm.op7_quality_classifier,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
}

ORACLE_SQL = {
    "op4_ngram_join": near_dup.ORACLE_SQL,
    "op10_quality_rules": quality_rules.ORACLE_SQL,
    "op6_url_filters": url_filters.ORACLE_SQL,
    "op8_exact_dedup": exact_dedup.ORACLE_SQL,
    "op9_license_scan": licenses.ORACLE_SQL,
    "op11_importance_resampling": importance.ORACLE_SQL,
    "op12_line_dedup": line_dedup.ORACLE_SQL,
    "op13_fill_in_middle": fill_middle.ORACLE_SQL,
}
