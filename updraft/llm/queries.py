"""Queries of this subpackage by name, with reference SQL where SQL can express them."""

from __future__ import annotations

from updraft.llm.chat import op10_prefix_rendering
from updraft.llm.lines import OP11_SQL, op11_line_dedup
from updraft.llm.merkle import OP13_SQL, op13_merkle
from updraft.llm.mixing import op9_raking
from updraft.llm.near import op5_lsh_forest
from updraft.llm.phrases import op2_phrases
from updraft.llm.pieces import op6_pieces
from updraft.llm.records import op3_records
from updraft.llm.rules import OP8_SQL, op8_host_rules
from updraft.llm.secrets import op7_secret_ledger
from updraft.llm.styletree import op4_style_tree
from updraft.llm.toxicity import op1_noisy_or
from updraft.llm.whitening import op12_chebyshev

QUERIES = {
    "op1_noisy_or": op1_noisy_or,
    "op2_phrases": op2_phrases,
    "op3_records": op3_records,
    "op4_style_tree": op4_style_tree,
    "op5_lsh_forest": op5_lsh_forest,
    "op6_pieces": op6_pieces,
    "op7_secret_ledger": op7_secret_ledger,
    "op8_host_rules": op8_host_rules,
    "op9_raking": op9_raking,
    "op10_prefix_rendering": op10_prefix_rendering,
    "op11_line_dedup": op11_line_dedup,
    "op12_chebyshev": op12_chebyshev,
    "op13_merkle": op13_merkle,
}
ORACLES = {
    "op8_host_rules": OP8_SQL,
    "op11_line_dedup": OP11_SQL,
    "op13_merkle": OP13_SQL,
}
