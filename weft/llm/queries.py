"""The corpus queries and, where SQL can say them, their DuckDB twins."""

import corpus_pipeline
from weft.llm import backtracking_bpe, bpe, decontaminate, divergence, exact_dedup, language, line_dedup, lm_score, periodic, quality, secrets, simhash, suffix_dedup

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_simhash": simhash.op5_simhash,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_language_id": language.op8_language_id,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_backtracking_bpe": backtracking_bpe.op12_backtracking_bpe,
    "op13_source_divergence": divergence.op13_source_divergence,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_suffix_dedup": suffix_dedup.OP1_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op9_secret_scan": secrets.OP9_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
