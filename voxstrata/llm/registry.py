"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op6_bpe
from .centroids import OP12_SQL, op12_centroids
from .decontaminate import OP8_SQL, op8_decontaminate
from .line_dedup import OP4_SQL, op4_line_dedup
from .lm_score import op9_lm_score
from .near_dup import OP3_SQL, op3_near_dup
from .pii import op7_pii
from .quality import op10_quality
from .token_counts import op5_token_counts
from .toxicity import op1_toxicity
from .url_filter import op11_url_filter
from .vector_search import OP2_SQL, op2_topk
from .whitening import op13_whitening

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_topk": op2_topk,
    "op3_near_dup": op3_near_dup,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_bpe": op6_bpe,
    "op7_pii": op7_pii,
    "op8_decontaminate": op8_decontaminate,
    "op9_lm_score": op9_lm_score,
    "op10_quality": op10_quality,
    "op11_url_filter": op11_url_filter,
    "op12_centroids": op12_centroids,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL = {"op2_topk": OP2_SQL, "op3_near_dup": OP3_SQL, "op4_line_dedup": OP4_SQL, "op8_decontaminate": OP8_SQL, "op12_centroids": OP12_SQL}
