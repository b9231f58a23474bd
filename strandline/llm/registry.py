"""Queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from strandline.llm import bpe, decontaminate, language_id, license_scan, oracles, quality, simhash, substring_dedup, suffix_dedup, token_counts, token_files

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_license_scan": license_scan.query,
    "op3_quality_rules": quality.query,
    "op4_bpe_round_trip": bpe.query,
    "op5_simhash": simhash.query,
    "op6_token_files": token_files.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_token_counts": token_counts.query,
    "op10_decontaminate": decontaminate.query,
}

ORACLES: dict[str, str] = {"op8_substring_dedup": oracles.SUBSTRING_DEDUP, "op10_decontaminate": oracles.DECONTAMINATE}
