"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, fill_in_middle, language_id, license_scan, lm_scoring, ngram_jaccard, packing, piece_coding, quality_rules, sharding, spelling_variants, substring_dedup, vector_topk

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_ngram_jaccard": ngram_jaccard.op5_ngram_jaccard,
    "op6_packing": packing.op6_packing,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_vector_topk": vector_topk.op8_vector_topk,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_piece_coding": piece_coding.op10_piece_coding,
    "op11_quality_rules": quality_rules.op11_quality_rules,
    "op12_spelling_variants": spelling_variants.op12_spelling_variants,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}

ORACLE_SQL = {
    "op4_license_scan": license_scan.OP4_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op5_ngram_jaccard": ngram_jaccard.OP5_SQL,
    "op7_substring_dedup": substring_dedup.OP7_SQL,
    "op8_vector_topk": vector_topk.OP8_SQL,
    "op9_lm_scoring": lm_scoring.OP9_SQL,
    "op12_spelling_variants": spelling_variants.OP12_SQL,
    "op13_fill_in_middle": fill_in_middle.OP13_SQL,
}
