"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from barwise.llm import pipeline
from barwise.llm.bpe import op8_bpe
from barwise.llm.decontaminate import op9_decontaminate
from barwise.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from barwise.llm.lines import OP4_SQL, op4_line_dedup
from barwise.llm.pii import op11_pii
from barwise.llm.quality import op6_quality
from barwise.llm.secrets import op7_secrets
from barwise.llm.simhash import op3_simhash_dedup
from barwise.llm.suffix_dedup import op2_suffix_dedup
from barwise.llm.suffix_tree_lm import op5_suffix_tree_lm
from barwise.llm.url_filter import OP1_SQL, op1_url_filter
from barwise.llm.vptree import OP10_SQL, op10_vptree
from barwise.llm.whitening import op13_whitening

QUERIES = {
    "op1_url_filter": (op1_url_filter, OP1_SQL),
    "op2_suffix_dedup": (op2_suffix_dedup, None),
    "op3_simhash_dedup": (op3_simhash_dedup, None),
    "op4_line_dedup": (op4_line_dedup, OP4_SQL),
    "op5_suffix_tree_lm": (op5_suffix_tree_lm, None),
    "op6_quality": (op6_quality, None),
    "op7_secrets": (op7_secrets, None),
    "op8_bpe": (op8_bpe, None),
    "op9_decontaminate": (op9_decontaminate, None),
    "op10_vptree": (op10_vptree, OP10_SQL),
    "op11_pii": (op11_pii, None),
    "op12_hard_negatives": (op12_hard_negatives, OP12_SQL),
    "op13_whitening": (op13_whitening, None),
    "pipeline": (pipeline.run, pipeline.ORACLE_SQL),
}
