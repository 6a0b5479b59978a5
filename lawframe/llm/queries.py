"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from lawframe.llm import audio, bpe, chat, fim, fingerprint, minhash, mixing, packing, quality, sessions, suffix, tokens, urls


def queries() -> dict:
    return {"op1_quality": quality.op1_quality, "op2_tokens": tokens.op2_tokens, "op3_suffix": suffix.op3_suffix, "op4_chat": chat.op4_chat, "op5_fingerprint": fingerprint.op5_fingerprint, "op6_minhash": minhash.op6_minhash, "op7_mixing": mixing.op7_mixing, "op8_packing": packing.op8_packing, "op9_urls": urls.op9_urls, "op10_audio": audio.op10_audio, "op11_sessions": sessions.op11_sessions, "op12_bpe": bpe.op12_bpe, "op13_fim": fim.op13_fim}


def oracle_sql() -> dict:
    return {"op4_chat": chat.ORACLE, "op11_sessions": sessions.ORACLE, "op13_fim": fim.ORACLE}
