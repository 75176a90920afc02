"""The registered queries of this subpackage and the SQL that DuckDB checks them with."""

from __future__ import annotations

from cadentia.llm import chat, decontam, exact, kneser, langid, merkle, minhash, mixing, pii, repair, suffix, tokens, warc

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_language_id": langid.op2_language_id,
    "op3_decontaminate": decontam.op3_decontaminate,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_suffix_dedup": suffix.op5_suffix_dedup,
    "op6_warc": warc.op6_warc,
    "op7_pii": pii.op7_pii,
    "op8_mixing": mixing.op8_mixing,
    "op9_exact_dedup": exact.op9_exact_dedup,
    "op10_near_dedup": minhash.op10_near_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_language_model": kneser.op13_language_model,
}

ORACLE_SQL = {
    "op1_chat_format": chat.SQL,
    "op6_warc": warc.SQL,
    "op8_mixing": mixing.SQL,
    "op9_exact_dedup": exact.SQL,
    "op10_near_dedup": minhash.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_conversation_repair": repair.SQL,
}
