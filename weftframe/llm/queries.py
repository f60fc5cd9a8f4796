"""Queries over the corpus tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, embeddings, jaccard, language_id, language_model, packing, quality, substring, token_counts, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_lm_scoring": language_model.op3_lm_scoring,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_quality": quality.op5_quality,
    "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
    "op7_embedding_caps": embeddings.op7_embedding_caps,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_language_id": language_id.op9_language_id,
    "op10_packing": packing.op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.OP1_SQL,
    "op2_substring_dedup": substring.OP2_SQL,
    "op6_ngram_jaccard": jaccard.OP6_SQL,
    "op7_embedding_caps": embeddings.OP7_SQL,
}
