"""The queries of the training-data operators, and SQL where SQL can say it."""

from __future__ import annotations

from . import op9_chat as chat
from .op1_suffix_dedup import op1_suffix_dedup
from .op2_near_dedup import op2_near_dedup
from .op3_ann import op3_ann
from .op4_packing import op4_packing
from .op5_quality import op5_quality
from .op6_lm import op6_lm
from .op7_audio import op7_audio
from .op8_pieces import op8_pieces
from .op10_url_filter import op10_url_filter

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_ann": op3_ann,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_lm": op6_lm,
    "op7_audio": op7_audio,
    "op8_pieces": op8_pieces,
    "op9_chat": chat.op9_chat,
    "op10_url_filter": op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op9_chat": chat.ORACLE,
}
