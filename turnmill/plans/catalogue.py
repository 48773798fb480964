"""The registered queries and the SQL that says what they should return."""

from __future__ import annotations

from turnmill.plans import corpus_queries, dialogue_queries, format_queries, sentence_queries, streaming_queries, training_queries  # noqa: F401
from turnmill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
