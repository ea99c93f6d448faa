"""Queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import op2_dartminhash as op2, op3_sharding as op3, op5_threshold as op5, op6_substring as op6, op8_language as op8, op11_resampling as op11, op12_elkan as op12, op13_stream_dedup as op13
from .op1_adaptive_scan import op1_adaptive_scan
from .op10_sentencepiece import op10_shared_prefix
from .op11_resampling import op11_importance_resampling
from .op12_elkan import op12_elkan_bounds
from .op13_stream_dedup import op13_stream_dedup
from .op2_dartminhash import op2_dartminhash
from .op3_sharding import op3_jump_shards
from .op4_ctw import op4_context_tree
from .op5_threshold import op5_threshold_topk
from .op6_substring import op6_count_min_windows
from .op7_pii import op7_semi_markov
from .op8_language import op8_rank_order
from .op9_packing import op9_shortest_pack_first

QUERIES = {
    "op1_adaptive_scan": op1_adaptive_scan,
    "op10_shared_prefix": op10_shared_prefix,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_elkan_bounds": op12_elkan_bounds,
    "op13_stream_dedup": op13_stream_dedup,
    "op2_dartminhash": op2_dartminhash,
    "op3_jump_shards": op3_jump_shards,
    "op4_context_tree": op4_context_tree,
    "op5_threshold_topk": op5_threshold_topk,
    "op6_count_min_windows": op6_count_min_windows,
    "op7_semi_markov": op7_semi_markov,
    "op8_rank_order": op8_rank_order,
    "op9_shortest_pack_first": op9_shortest_pack_first,
}
ORACLE_SQL: dict[str, str] = {
    "op11_importance_resampling": op11.ORACLE,
    "op12_elkan_bounds": op12.ORACLE,
    "op13_stream_dedup": op13.ORACLE,
    "op2_dartminhash": op2.ORACLE,
    "op3_jump_shards": op3.ORACLE,
    "op5_threshold_topk": op5.ORACLE,
    "op6_count_min_windows": op6.ORACLE,
    "op8_rank_order": op8.ORACLE,
}
