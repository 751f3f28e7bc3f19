"""Registered queries over the given tables, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations


def load() -> dict:
    """Every registered query, by name."""
    from gatelight.catalog import base
    from gatelight.catalog import ingest_queries, search_queries, history_queries, score_queries, stream_queries  # noqa: F401

    return base.QUERIES
