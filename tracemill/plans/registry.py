"""Every registered query by name, with its oracle SQL where SQL can express it."""

from __future__ import annotations

from tracemill.plans import analytics, cases, live, logs, procedures, retrieval, store, texts, workspaces

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for module in (store, analytics, texts, retrieval, cases, logs, procedures, workspaces, live):
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE
FLAGSHIP = "q65_rrf_fusion"
