"""Registered queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from relaysync.llm.cross_polytope import op12_nearest
from relaysync.llm.decontamination import op6_decontamination
from relaysync.llm.embedding_dedup import op4_embedding_dedup
from relaysync.llm.line_dedup import op10_line_dedup
from relaysync.llm.lm_scoring import op1_lm_scoring
from relaysync.llm.order_minhash import op8_near_dedup
from relaysync.llm.packing import op7_packing
from relaysync.llm.pii import op5_pii
from relaysync.llm.prefix_trie import op11_prefix_trie
from relaysync.llm.quality import op3_quality
from relaysync.llm.sharding import op9_sharding
from relaysync.llm.spelling import op13_spelling
from relaysync.llm.toxicity import op2_toxicity

QUERIES = {f.__name__: f for f in (
    op1_lm_scoring, op2_toxicity, op3_quality, op4_embedding_dedup, op5_pii, op6_decontamination, op7_packing,
    op8_near_dedup, op9_sharding, op10_line_dedup, op11_prefix_trie, op12_nearest, op13_spelling)}

SQL: dict[str, str] = {}
