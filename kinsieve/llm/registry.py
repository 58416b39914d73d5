"""Queries of the corpus operators, with DuckDB SQL where SQL can express them on whole tables."""

from __future__ import annotations

from .audit import OP11_SQL, op11_filter_audit
from .bpe import op10_byte_bpe
from .decontaminate import OP7_SQL, op7_decontamination
from .forest import op13_nearest
from .html import op1_main_text
from .jaccard import op6_jaccard_join
from .language import op4_language
from .manifest import OP12_SQL, op12_merkle_manifest
from .pii import op3_pii
from .quality import op2_quality
from .substring import op5_substring_dedup
from .topk import OP8_SQL, op8_exact_topk
from .toxicity import op9_toxicity

QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_language": op4_language,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_decontamination": op7_decontamination,
    "op8_exact_topk": op8_exact_topk,
    "op9_toxicity": op9_toxicity,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_nearest": op13_nearest,
}

ORACLE = {
    "op7_decontamination": OP7_SQL,
    "op8_exact_topk": OP8_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
