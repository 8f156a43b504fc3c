"""Queries over the benchmark tables, each with an equivalent SQL text where SQL can express it."""

from __future__ import annotations

from braid.catalog.base import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    """Import every query module and return (queries, oracle SQL)."""
    from braid.catalog import (  # noqa: F401
        changes, governance, ingest, landscape, payments, retrieval, routing, streams,
    )

    return QUERIES, ORACLES
