"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, licenses, lm_score, near_join, passages, pii, quality, sharding

QUERIES = {
    "op1_ngram_jaccard_join": near_join.op1_ngram_jaccard_join,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_lm_scoring": lm_score.op3_lm_scoring,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_pii": pii.op5_pii,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_bpe_encode_decode": bpe.op7_bpe_encode_decode,
    "op8_substring_dedup": passages.op8_substring_dedup,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_sharding": sharding.op10_sharding,
}

ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": decontaminate.OP2_SQL,
    "op4_license_scan": licenses.OP4_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
}
