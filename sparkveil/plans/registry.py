"""All queries of the engine and their SQL, by name. The modules of queries register what they hold as they are imported."""

from __future__ import annotations

from . import file_queries, plan_queries, queries  # noqa: F401

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
