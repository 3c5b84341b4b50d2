"""All registered queries and their SQL."""

from __future__ import annotations

from marlstone.plans import aggregates, commits, dataflow, documents, extraction, graph, graph_views, grpc, joins, knowledge, lanes, packages, records, references, revisions, scalars, scans, search, stores, streams, windows  # noqa: F401
from marlstone.plans.base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "search_exact"
