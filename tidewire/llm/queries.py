"""One query per operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidewire.llm.chat import op11_chat
from tidewire.llm.decontaminate import op2_decontamination
from tidewire.llm.embedding_dedup import op9_embedding_dedup
from tidewire.llm.html_tree import op4_page_text
from tidewire.llm.langid import op3_language
from tidewire.llm.mixing import op6_mixing
from tidewire.llm.oracle import ORACLE
from tidewire.llm.pii import op1_personal_data
from tidewire.llm.runs import op12_runs
from tidewire.llm.secrets import op5_secrets
from tidewire.llm.sharding import op7_sharding
from tidewire.llm.simhash import op8_simhash
from tidewire.llm.toxicity import op10_toxicity
from tidewire.llm.whitening import op13_whitening

QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_spaced_seeds": op2_decontamination,
    "op3_string_kernel": op3_language,
    "op4_style_tree": op4_page_text,
    "op5_random_secrets": op5_secrets,
    "op6_tree_mixing": op6_mixing,
    "op7_jump_sharding": op7_sharding,
    "op8_simhash_anchors": op8_simhash,
    "op9_spherical_cells": op9_embedding_dedup,
    "op10_toxicity_trees": op10_toxicity,
    "op11_reply_trees": op11_chat,
    "op12_difference_cover": op12_runs,
    "op13_jacobi_davidson": op13_whitening,
}

__all__ = ["ORACLE", "QUERIES"]
