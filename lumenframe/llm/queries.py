"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import licenses
from .chat import op1_chat_format
from .embeddings import op7_embedding_dedup
from .jaccard import op3_ngram_jaccard
from .licenses import op8_license_scan
from .packing import op6_packing
from .pieces import op4_sentencepiece
from .quality import op5_quality
from .substring import op10_substring_dedup
from .token_files import op9_token_files
from .toxicity import op2_toxicity

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_token_files": op9_token_files,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {"op8_license_scan": licenses.oracle_sql()}
