"""The corpus operators' registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import binary_output, chat, fingerprint, jaccard, language, manifest, media, mixing, packing, phrases, scoring, tokens, urls

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_url_filter": urls.op2_url_filter,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_language_id": language.op4_language_id,
    "op5_packing": packing.op5_packing,
    "op6_binary_output": binary_output.op6_binary_output,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_chat_format": chat.op8_chat_format,
    "op9_fingerprint": fingerprint.op9_fingerprint,
    "op10_audio_fingerprint": media.op10_audio_fingerprint,
    "op11_collocations": phrases.op11_collocations,
    "op12_lm_scores": scoring.op12_lm_scores,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {"op2_url_filter": urls.OP2_SQL, "op7_jaccard_join": jaccard.OP7_SQL, "op8_chat_format": chat.OP8_SQL, "op11_collocations": phrases.OP11_SQL, "op13_merkle_manifest": manifest.OP13_SQL}
