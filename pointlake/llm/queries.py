"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pointlake.llm import audit, chat, decontaminate, digest, langid, licenses, linededup, neardup, ngrams, pieces, pii, quality, whiten

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_pii_surrogates": pii.op3_pii_surrogates,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_language_id": langid.op6_language_id,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_document_fingerprints": digest.op8_document_fingerprints,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_minhash_near_dedup": neardup.op10_minhash_near_dedup,
    "op11_embedding_whitening": whiten.op11_embedding_whitening,
    "op12_lm_scoring": ngrams.op12_lm_scoring,
    "op13_filter_audit": audit.op13_filter_audit,
}
SQL = {
    "op1_benchmark_decontamination": decontaminate.OP1_SQL,
    "op2_chat_formatting": chat.OP2_SQL,
    "op4_license_scan": licenses.OP4_SQL,
    "op9_line_dedup": linededup.OP9_SQL,
    "op10_minhash_near_dedup": neardup.OP10_SQL,
    "op13_filter_audit": audit.OP13_SQL,
}
