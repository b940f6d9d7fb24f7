"""Whole queries over the fixture tables and their SQL oracles."""

from __future__ import annotations

import importlib

_MODULES = [
    "q_projections",
    "q_joins",
    "q_aggregates",
    "q_summaries",
    "q_windows",
    "q_order_set",
    "q_scalars",
    "q_roster",
    "q_stats",
    "q_sources",
    "q_text",
    "q_streams",
    "q_matrix",
]


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"swapledger.plans.{m}")


def all_queries():
    from swapledger.plans import registry

    _load()
    return registry.all_queries()


def all_oracles():
    from swapledger.plans import registry

    _load()
    return registry.all_oracles()
