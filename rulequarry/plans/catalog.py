"""The queries of the trace engine and the DuckDB statement that each must equal."""

from __future__ import annotations

from rulequarry.plans import checking, clusters, extras, live, mine, mining, operations, patterns, payloads, projection, reports, review, scoring, store, text, tracks, verification  # noqa: F401
from rulequarry.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
