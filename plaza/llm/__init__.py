"""Operators for text training data; nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib

from plaza.registry import Registry

#: Modules of queries.
QUERIES = ["q_abuse", "q_conversations", "q_raking", "q_neardup", "q_packing", "q_mixing", "q_residue"]


def register(reg: Registry) -> None:
    """Add the queries of this subpackage."""
    for name in QUERIES:
        importlib.import_module(f"plaza.llm.{name}").register(reg)
