"""The corpus operators as queries over the whole test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from nearfield.llm import context_mixing, decontaminate, flac, html_extract, language_id, quality, secret_scan, simhash, source_mix, substring_dedup

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_language_id": language_id.op2_language_id,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_source_mix": source_mix.op6_source_mix,
    "op7_simhash": simhash.op7_simhash,
    "op8_flac": flac.op8_flac,
    "op9_quality": quality.op9_quality,
    "op10_context_mixing": context_mixing.op10_context_mixing,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op4_secret_scan": secret_scan.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op6_source_mix": source_mix.ORACLE,
}
