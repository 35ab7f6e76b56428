"""Operators of a large-scale training-data pipeline, each a DataFrame operator with its own query."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("exact_dedup", "quality", "vectors", "pieces", "toxicity", "mixing", "masked_lm", "personal", "jaccard", "line_templates", "clusters", "whitening", "bpe")


def load_queries():
    """(queries, oracles) of the operators, by name ``opN_<name>``."""
    queries, oracles = {}, {}
    for name in _MODULES:
        module = import_module(f"fleetgrade.llm.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
