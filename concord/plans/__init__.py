"""Registered queries: each module pairs Spark queries with the SQL they must equal."""

from __future__ import annotations

import importlib

MODULES = (
    "vector_queries", "table_queries", "agreement_queries", "cluster_queries", "spectrum_queries", "text_queries", "stream_queries", "source_queries",
)


def load_all() -> tuple[dict, dict]:
    """(queries, oracles) of every module."""
    from concord.plans import base

    for name in MODULES:
        importlib.import_module(f"concord.plans.{name}")
    return dict(base.QUERIES), dict(base.ORACLES)
