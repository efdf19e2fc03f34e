"""Training-data operators. Nothing outside this subpackage imports it."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("op1_minhash", "op2_chat", "op3_html", "op4_language", "op5_mixing", "op6_licenses", "op7_decontaminate", "op8_tokens", "op9_lines", "op10_embeddings")

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in _MODULES:
    _module = import_module(f".{_name}", __name__)
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
