"""Queries and oracle SQL of this package, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "exact_dedup",
    "token_files",
    "language_id",
    "secret_scan",
    "warc",
    "decontaminate",
    "mixing",
    "line_templates",
    "ngram_join",
    "suffix_tree_lm",
]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"statuta.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"statuta.llm.{m}").ORACLES.items()}
