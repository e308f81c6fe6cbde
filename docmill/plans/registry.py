"""All queries of the core and their SQL."""

from __future__ import annotations

from docmill.plans import audits, corpus, integrity, reviews, rollups, streams

MODULES = (integrity, corpus, audits, rollups, streams, reviews)
FLAGSHIP = "evidence"


def queries() -> dict:
    """Query name to function of (spark, folder)."""
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to SQL, where there is any."""
    return {k: v for m in MODULES for k, v in m.SQL.items()}
