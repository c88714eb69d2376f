"""The registry of the core queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("nested_queries", "relational_queries", "text_queries", "record_queries", "quota_queries", "metric_queries", "run_queries", "source_queries")


def collect(package: str = "tamis.plans", modules: tuple[str, ...] = MODULES) -> tuple[dict, dict]:
    queries: dict = {}
    oracle: dict = {}
    for name in modules:
        m = import_module(f"{package}.{name}")
        if clash := queries.keys() & m.QUERIES.keys():
            raise ValueError(f"queries registered twice: {sorted(clash)}")
        queries |= m.QUERIES
        oracle |= m.ORACLE
    return queries, oracle
