"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .ann import op1_nearest_neighbours
from .chat import OP6_SQL, op6_chat_format
from .embedding_dedup import OP7_SQL, op7_embedding_dedup
from .html_text import op10_html_text
from .langid import op9_language_id
from .minhash import OP5_SQL, op5_minhash_dedup
from .packing import op3_best_fit_packing
from .pii import op2_pii
from .quality import op4_quality
from .sentencepiece_fst import op8_sentencepiece

QUERIES = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_pii": op2_pii,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality": op4_quality,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_language_id": op9_language_id,
    "op10_html_text": op10_html_text,
}
ORACLES = {"op5_minhash_dedup": OP5_SQL, "op6_chat_format": OP6_SQL, "op7_embedding_dedup": OP7_SQL}
