"""Queries over the given tables, one or more per operator."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("finding_queries", "compare_queries", "script_queries", "settings_queries", "tool_queries", "host_queries", "source_queries", "code_queries", "stream_queries", "incremental_queries")


def load_all():
    from fleetgrade.workload import registry

    for name in _MODULES:
        import_module(f"fleetgrade.workload.{name}")
    return registry.QUERIES, registry.ORACLES
