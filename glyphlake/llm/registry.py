"""Every query of this folder, and SQL for those that SQL expresses."""

from __future__ import annotations

from glyphlake.llm import bpe, contamination, html, licences, linededup, lm, neardup, quality, repeats, toxicity

QUERIES = {
    "op1_licence_scan": licences.op1_licence_scan,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_suffix_array_dedup": repeats.op3_suffix_array_dedup,
    "op4_benchmark_decontamination": contamination.op4_benchmark_decontamination,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_minhash_near_dedup": neardup.op6_minhash_near_dedup,
    "op7_html_extraction": html.op7_html_extraction,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_lm_scoring": lm.op10_lm_scoring,
}
ORACLE_SQL: dict[str, str] = {
    "op1_licence_scan": licences.SQL,
    "op2_line_dedup": linededup.SQL,
}
