"""The queries of this package by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from brightloom.llm import bpe, chat, embeddings, langid, lines, merkle, mixing, passages, periods, pii, simhash, token_counts, topk

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_mixing": mixing.op2_mixing,
    "op3_simhash": simhash.op3_simhash,
    "op4_langid": langid.op4_langid,
    "op5_bpe": bpe.op5_bpe,
    "op6_pii": pii.op6_pii,
    "op7_embedding_dedup": embeddings.op7_embedding_dedup,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_topk": topk.op9_topk,
    "op10_chat": chat.op10_chat,
    "op11_passages": passages.op11_passages,
    "op12_periods": periods.op12_periods,
    "op13_merkle": merkle.op13_merkle,
    "llm_token_counts_words": token_counts.token_counts_words,
}

ORACLE_SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op7_embedding_dedup": embeddings.OP7_SQL,
    "op8_line_dedup": lines.OP8_SQL,
    "op9_topk": topk.OP9_SQL,
    "op11_passages": passages.OP11_SQL,
    "op13_merkle": merkle.OP13_SQL,
    "llm_token_counts_words": token_counts.WORDS_SQL,
}
