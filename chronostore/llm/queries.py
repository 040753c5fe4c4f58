"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, exact_dedup, line_dedup, lm, packing, pii, quality, secrets, simhash, token_files

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_lm_scores": lm.op2_lm_scores,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_token_files": token_files.op5_token_files,
    "op6_benchmark_decontamination": decontam.op6_benchmark_decontamination,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_pii": pii.op8_pii,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLES = {"op3_secret_scan": secrets.ORACLE_SQL, "op6_benchmark_decontamination": decontam.ORACLE_SQL, "op10_exact_dedup": exact_dedup.ORACLE_SQL}
