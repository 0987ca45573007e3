"""The queries of this subpackage and their SQL oracles."""

from __future__ import annotations

import corpus_pipeline
from graphloom.llm import (
    op1_quality,
    op2_hyperplanes,
    op3_mixing,
    op4_minhash,
    op5_sentencepiece,
    op6_edit_counts,
    op7_toxicity,
    op8_topk,
    op9_surrogates,
    op10_shards,
    op11_divergence,
    op12_repair,
    op13_grace_dedup,
)

_OPERATORS = {
    "op1_neighbour_quality": op1_quality,
    "op2_hyperplane_near_dedup": op2_hyperplanes,
    "op3_budget_mixing": op3_mixing,
    "op4_minhash_near_dedup": op4_minhash,
    "op5_sentencepiece_lattice": op5_sentencepiece,
    "op6_edit_aware_counts": op6_edit_counts,
    "op7_toxicity_machine": op7_toxicity,
    "op8_branch_and_bound_topk": op8_topk,
    "op9_pii_surrogates": op9_surrogates,
    "op10_training_order_shards": op10_shards,
    "op11_source_divergence": op11_divergence,
    "op12_conversation_repair": op12_repair,
    "op13_grace_dedup": op13_grace_dedup,
}


def queries():
    return {name: module.query for name, module in _OPERATORS.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    found = {name: module.ORACLE for name, module in _OPERATORS.items() if hasattr(module, "ORACLE")}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
