"""The queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from dossierflow.llm import bpe_codec, chat_format, decontamination, delta_lloyd, fingerprints, language_id, line_dedup, minhash_dedup, secret_scan, substring_dedup, suffix_dedup, toxicity, whitening

QUERIES = {
    "op1_benchmark_decontamination": decontamination.query,
    "op2_minhash_dedup": minhash_dedup.query,
    "op3_bpe_codec": bpe_codec.query,
    "op4_toxicity": toxicity.query,
    "op5_secret_scan": secret_scan.query,
    "op6_document_fingerprints": fingerprints.query,
    "op9_line_dedup": line_dedup.query,
    "op7_language_id": language_id.query,
    "op8_substring_dedup": substring_dedup.query,
    "op10_chat_format": chat_format.query,
    "op11_embedding_whitening": whitening.query,
    "op12_suffix_dedup": suffix_dedup.query,
    "op13_delta_lloyd": delta_lloyd.query,
}

ORACLES = {
    "op10_chat_format": chat_format.ORACLE,
    "op12_suffix_dedup": suffix_dedup.ORACLE,
    "op13_delta_lloyd": delta_lloyd.ORACLE,
}
