"""Corpus pipeline: quality filter, line dedup, near-dedup, decontamination, BPE.

The stages live in ``barwise.llm.pipeline``; this file gives them their place.
"""

from barwise.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
