"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from skein.llm import bpe, chat, decontam, jaccard, langid, lm, media, pii, substring, toxicity

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_chat_format": chat.op2_chat_format,
    "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
    "op4_language_id": langid.op4_language_id,
    "op5_pii": pii.op5_pii,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_media": media.op8_media,
    "op9_bpe": bpe.op9_bpe,
    "op10_lm_score": lm.op10_lm_score,
}
ORACLE_SQL: dict[str, str] = {"op2_chat_format": chat.SQL}
