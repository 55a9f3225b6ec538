"""Registered queries of the operators, by name, with their DuckDB SQL where SQL expresses them."""

from __future__ import annotations

import corpus_pipeline
from fleetstate.llm import chat, decontaminate, filter_audit, fingerprint, jaccard, langid, license_scan, merkle, packing, ppm, substrings, toxicity, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op3_lm_score": ppm.op3_lm_score,
    "op2_chat_format": chat.op2_chat_format,
    "op1_license_scan": license_scan.op1_license_scan,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op6_fingerprints": fingerprint.op6_fingerprints,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_language_id": langid.op9_language_id,
    "op10_packing": packing.op10_packing,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_warc": warc.op12_warc,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLE: dict[str, str] = {
    "op2_chat_format": chat.OP2_SQL,
    "op1_license_scan": license_scan.OP1_SQL,
    "op7_decontamination": decontaminate.OP7_SQL,
    "op5_jaccard_join": jaccard.OP5_SQL,
    "op4_substring_dedup": substrings.OP4_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_warc": warc.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
