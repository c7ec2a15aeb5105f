"""Registered queries of the library proper: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from importlib import import_module

PARTS = ("text_queries", "join_queries", "score_queries", "window_queries", "stream_queries")


def _all() -> dict:
    found: dict = {}
    for part in PARTS:
        found |= import_module(f"captext.plans.{part}").QUERIES
    return found


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql}
