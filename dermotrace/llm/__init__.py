"""Training-data corpus operators; nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module with ``query(spark, sf_dir)`` and, where SQL can express it, ``SQL``.
MODULES = {
    "op1_suffix_dedup": "suffix_dedup",
    "op2_decontaminate": "decontaminate",
    "op3_url_filter": "url_filter",
    "op4_token_shards": "token_output",
    "op5_cotraining": "cotraining",
    "op6_exact_dedup": "exact_dedup",
    "op7_simhash": "simhash",
    "op8_license_scan": "license_scan",
    "op9_language_id": "language_id",
    "op10_packing": "packing",
    "op11_prefix_trie": "prefix_trie",
    "op12_turn_repair": "turn_repair",
    "op13_line_dedup": "line_dedup",
}


def load(name: str):
    """The module of a query; an ImportError goes to the caller."""
    return import_module(f"{__name__}.{MODULES[name]}")


def queries() -> dict:
    return {name: load(name).query for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: load(name).SQL for name in MODULES if getattr(load(name), "SQL", None)}
