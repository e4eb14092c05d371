"""All registered queries and their SQL."""

from __future__ import annotations

from quarrymill.queries import corpus, filtering, platform, relational, scalars, search, statistics

_MODULES = [scalars, filtering, relational, statistics, search, corpus, platform]
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
