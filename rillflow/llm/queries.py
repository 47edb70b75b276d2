"""The training-data queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import corpus_pipeline

from .bpe import op2_byte_bpe
from .chat import OP3_SQL, op3_chat_format
from .classifier import op1_quality_pu
from .neardups import OP4_SQL, op4_near_dedup
from .pack import op7_pack_kk
from .pii import op6_pii_bilstm_crf
from .rules import op9_quality_trees
from .shards import op8_shard_interleave
from .substrings import op5_suffix_dedup
from .topk import OP10_SQL, op10_topk_exact

QUERIES = {
    "op1_quality_pu": op1_quality_pu,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_chat_format": op3_chat_format,
    "op4_near_dedup": op4_near_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_pii_bilstm_crf": op6_pii_bilstm_crf,
    "op7_pack_kk": op7_pack_kk,
    "op8_shard_interleave": op8_shard_interleave,
    "op9_quality_trees": op9_quality_trees,
    "op10_topk_exact": op10_topk_exact,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op3_chat_format": OP3_SQL, "op4_near_dedup": OP4_SQL, "op10_topk_exact": OP10_SQL}
