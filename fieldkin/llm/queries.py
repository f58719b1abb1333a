"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from fieldkin.llm import divergence, exact, language, lines, mixing, negatives, quality, repeats, secrets, simhash, toxicity, warc, winnowing

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_substring_dedup": repeats.op3_substring_dedup,
    "op4_warc_archive": warc.op4_warc_archive,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_benchmark_decontamination": winnowing.op8_benchmark_decontamination,
    "op9_exact_dedup": exact.op9_exact_dedup,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_quality_classifier": quality.op13_quality_classifier,
}

ORACLE_SQL = {
    "op2_line_dedup": lines.OP2_SQL,
    "op4_warc_archive": warc.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op7_secret_scan": secrets.OP7_SQL,
    "op9_exact_dedup": exact.OP9_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
}
