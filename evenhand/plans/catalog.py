"""Imports every family so that its queries are registered."""

from __future__ import annotations

from evenhand.plans import attribution_queries, corpus_queries, diagnostic_queries, effect_queries, grading_queries, retrieval_queries  # noqa: F401
from evenhand.plans import rule_queries, screening_queries, source_queries, stream_queries  # noqa: F401
from evenhand.plans.registry import ORACLES, QUERIES  # noqa: F401
