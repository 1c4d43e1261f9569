"""Registered queries of the operators in this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from .alignment import op13_token_alignment
from .byte_bpe import op8_byte_bpe
from .language_model import op3_kneser_ney
from .mixing import op7_mixing
from .near_dedup import op4_near_duplicates
from .oracle import ORACLE
from .phrase_fingerprint import op5_phrase_fingerprints
from .repetition import op1_suffix_repetition
from .sharding import op2_feistel_shards
from .spelling import op12_spelling_variants
from .suffix_dedup import op6_suffix_dedup
from .token_files import op9_token_files
from .toxicity import op10_toxicity
from .vector_dedup import op11_embedding_near_duplicates

QUERIES = {
    "op1_suffix_repetition": op1_suffix_repetition,
    "op2_feistel_shards": op2_feistel_shards,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_phrase_fingerprints": op5_phrase_fingerprints,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mixing": op7_mixing,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_files": op9_token_files,
    "op10_toxicity": op10_toxicity,
    "op11_embedding_near_duplicates": op11_embedding_near_duplicates,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_alignment": op13_token_alignment,
}

__all__ = ["ORACLE", "QUERIES"]
