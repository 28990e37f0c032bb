"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Query, module of this subpackage, name of its SQL (or None).
REGISTERED = [
    ("op1_document_fingerprints", "fingerprints", None),
    ("op2_suffix_dedup", "suffix_dedup", None),
    ("op3_quality_rules", "quality_rules", "OP3_SQL"),
    ("op4_token_counts", "token_counts", None),
    ("op5_secret_scans", "secrets", None),
    ("op6_packing", "packing", None),
    ("op7_quality_classifier", "quality_classifier", None),
    ("op8_simhash_near_dedup", "simhash", None),
    ("op9_bpe_automaton", "bpe", None),
    ("op10_personal_data", "personal_data", None),
]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"spanloom.llm.{module}"), name) for name, module, _ in REGISTERED}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"spanloom.llm.{module}"), sql) for name, module, sql in REGISTERED if sql}
