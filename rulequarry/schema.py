"""Schemas of traces, rules and results, and the validity of rule parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = "struct<type: string, content: string, tool: string, latency_ms: int, result_status: string>"
TRACE = f"trace_id string, session_id string, version string, segment string, started_at timestamp_ntz, steps array<{STEP}>"
PARAMS = (
    "struct<tool_a: string, tool_b: string, chain: array<string>, keyword: string, tool: string, forbidden_patterns: array<string>, "
    "allowed_repertoire: array<string>, category: string, metric: string, feature: string, threshold: double, rate: double, percentile: double, p1: double, "
    "p99: double, median: double, terminator_tool: string, forbidden_after: array<string>, upstream_tool: string, downstream_tool: string, "
    "segment: string, expected_tool: string, forbidden_tool: string, rubric: string>"
)
RULE = f"rule_id string, type string, description string, severity string, params {PARAMS}"
SEVERITY = {"low": 1, "medium": 2, "high": 3, "critical": 4}
TYPES = ("ordering", "conditional", "negative", "statistical", "state", "composition", "tool_selection", "output_format")
TOOL_NAME = "^[A-Za-z_][A-Za-z0-9_./-]{0,127}$"
KEYWORD = "^[a-z][a-z0-9_]{1,63}$"
SEGMENT = "^[A-Za-z0-9_-]{1,32}$"


def severity_rank(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(0)
    for name, rank in SEVERITY.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def params_valid(kind: str = "type", params: str = "params") -> Column:
    """Whether the parameters are complete and in range for the rule's type; null parts count as missing."""
    p = lambda name: F.col(f"{params}.{name}")
    tool = lambda name: F.trim(p(name)).rlike(TOOL_NAME)
    deny, allow = F.size(p("forbidden_patterns")) > 0, F.size(p("allowed_repertoire")) > 0
    latency = (p("metric") == "latency_ms") & tool("tool") & (p("threshold") >= 0)
    success = (p("metric") == "success_rate") & tool("tool") & p("rate").between(0, 1)
    envelope = (p("metric") == "feature_envelope") & (F.length(p("feature")) > 0) & (p("p1") <= p("p99"))
    by_type = {
        "ordering": tool("tool_a") & tool("tool_b"),
        "conditional": F.lower(F.trim(p("keyword"))).rlike(KEYWORD) & tool("tool"),
        "negative": F.coalesce(deny, F.lit(False)) != F.coalesce(allow, F.lit(False)),
        "statistical": F.coalesce(latency, F.lit(False)) | F.coalesce(success, F.lit(False)) | F.coalesce(envelope, F.lit(False)),
        "state": tool("terminator_tool") & (F.size(p("forbidden_after")) > 0),
        "composition": tool("upstream_tool") & tool("downstream_tool"),
        "tool_selection": F.trim(p("segment")).rlike(SEGMENT) & tool("expected_tool"),
        "output_format": F.coalesce(F.length(p("rubric")) <= 2048, F.lit(True)),
    }
    out = F.lit(False)
    for name, ok in by_type.items():
        out = F.when(F.col(kind) == name, F.coalesce(ok, F.lit(False))).otherwise(out)
    return out
