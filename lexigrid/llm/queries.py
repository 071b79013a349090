"""Registered queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline

from .bpe import op5_byte_bpe
from .chat_tree import op7_chat_formatting
from .decontam import op8_benchmark_decontamination
from .embed_dedup import op9_embedding_near_dedup
from .lang_id import op4_language_id
from .license_scan import op6_license_scan
from .line_dedup import op10_line_dedup
from .lm_score import op1_lm_scoring
from .near_dup import op2_minhash_near_dedup
from .toxicity import op3_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_minhash_near_dedup, op3_toxicity, op4_language_id, op5_byte_bpe,
        op6_license_scan, op7_chat_formatting, op8_benchmark_decontamination, op9_embedding_near_dedup, op10_line_dedup,
    )
} | {"pipeline": corpus_pipeline.run}
ORACLE_SQL: dict[str, str] = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
