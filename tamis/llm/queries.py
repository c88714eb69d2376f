"""The registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from tamis.plans.catalog import collect

QUERIES, ORACLE = collect("tamis.llm", ("splits_queries", "neardup_queries", "defects_queries", "truncation_queries", "sampling_queries", "leakage_queries", "packing_queries", "diverse_queries"))
