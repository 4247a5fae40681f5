"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from siftline.llm import (
    decontaminate,
    hnsw,
    lexical,
    line_dedup,
    mixing,
    phrase_dedup,
    quality,
    secrets,
    simhash,
    suffix_dedup,
    token_counts,
    vector_dedup,
)

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_mixing": mixing.op2_mixing,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_hnsw": hnsw.op4_hnsw,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_phrase_dedup": phrase_dedup.op7_phrase_dedup,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_quality": quality.op9_quality,
    "op10_secrets": secrets.op10_secrets,
    "op11_lexical": lexical.op11_lexical,
    "op12_vector_dedup": vector_dedup.op12_vector_dedup,
}
ORACLES = {
    "op5_decontaminate": decontaminate.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op7_phrase_dedup": phrase_dedup.ORACLE_SQL,
    "op8_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op11_lexical": lexical.ORACLE_SQL,
    "op12_vector_dedup": vector_dedup.ORACLE_SQL,
}
