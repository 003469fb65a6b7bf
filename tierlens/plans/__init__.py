"""Registered queries over the test tables."""

from __future__ import annotations

import importlib

MODULES = ("label_queries", "audit_queries", "score_queries", "sampling_queries", "policy_queries", "stream_queries")


def load():
    """(queries, oracles) after importing every query module."""
    for name in MODULES:
        importlib.import_module(f"tierlens.plans.{name}")
    from tierlens.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
