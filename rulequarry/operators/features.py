"""Per-trace features: everything a rule asks of a trace, computed once and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOOL_STEPS = "filter(steps, s -> s.type = 'tool_call')"
SHAPE = "array_join(transform(steps, s -> CASE s.type WHEN 'tool_call' THEN concat('tool:', coalesce(s.tool, '')) WHEN 'user_input' THEN 'user' WHEN 'agent_response' THEN 'response' WHEN 'agent_thought' THEN 'thought' WHEN 'system' THEN 'system' ELSE 'unknown' END), '|')"


def shape() -> Column:
    return F.expr(SHAPE)


def fingerprint() -> Column:
    return F.substring(F.sha2(shape(), 256), 1, 16)


def tool_sequence() -> Column:
    return F.expr(f"transform({TOOL_STEPS}, s -> s.tool)")


#: Modes of sampling: everything; a share; errors and a share of the rest; also slow traces and those of a known segment.
SAMPLING = ("none", "rate", "tail_on_error", "adaptive")


def sampled(mode: str, rate: float = 1.0, keep_errors: bool = True, keep_segments: bool = True, slow_ms: int = 1000) -> Column:
    """Whether a trace stays; a share is drawn by its id, so the same ids stay everywhere."""
    from rulequarry.functions.text import sampling_roll

    if mode not in SAMPLING:
        raise ValueError(f"unknown mode of sampling: {mode}")
    if mode == "none":
        return F.lit(True)
    kept = F.lit(rate >= 1) if rate >= 1 or rate <= 0 else sampling_roll("trace_id") < rate
    if keep_errors:
        kept = kept | F.expr(f"exists({TOOL_STEPS}, s -> coalesce(nullif(s.result_status, ''), 'success') <> 'success')")
    if mode == "adaptive":
        kept = kept | F.expr(f"exists({TOOL_STEPS}, s -> coalesce(s.latency_ms, 0) >= {slow_ms})")
        if keep_segments:
            kept = kept | F.col("segment").isNotNull()
    return kept


def user_tokens(text: str) -> Column:
    """Distinct lower-case words of three characters or more."""
    return F.expr(f"array_distinct(regexp_extract_all(lower({text}), '[a-z][a-z0-9_]{{2,}}', 0))")


def with_features(traces: DataFrame) -> DataFrame:
    """Adds calls (index over all steps, tool, latency, status), tools, user_text and segment_lower."""
    return traces.withColumns(
        {
            "calls": F.expr("filter(transform(steps, (s, i) -> named_struct('i', i, 'type', s.type, 'tool', s.tool, 'latency_ms', s.latency_ms, 'ok', coalesce(nullif(s.result_status, ''), 'success') = 'success')), c -> c.type = 'tool_call')"),
            "tools": tool_sequence(),
            "user_text": F.expr("lower(array_join(transform(filter(steps, s -> s.type = 'user_input'), s -> coalesce(s.content, '')), ' '))"),
            "segment_lower": F.lower("segment"),
        }
    )


def behavioral(traces: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The eight behavioural features of each trace, and the columns in keep."""
    total = lambda e: F.expr(f"aggregate({e}, 0L, (a, x) -> a + x)")
    return traces.select(
        "trace_id",
        F.size("steps").cast("long").alias("step_count"),
        F.expr(f"CAST(size({TOOL_STEPS}) AS bigint)").alias("tool_count"),
        F.size(F.array_distinct(tool_sequence())).cast("long").alias("distinct_tools"),
        total("transform(filter(steps, s -> s.type = 'user_input'), s -> CAST(length(coalesce(s.content, '')) AS bigint))").alias("user_chars"),
        total("transform(filter(steps, s -> s.type = 'agent_response'), s -> CAST(length(coalesce(s.content, '')) AS bigint))").alias("response_chars"),
        total(f"transform({TOOL_STEPS}, s -> CAST(coalesce(s.latency_ms, 0) AS bigint))").alias("sum_latency"),
        F.expr(f"CAST(coalesce(array_max(transform({TOOL_STEPS}, s -> coalesce(s.latency_ms, 0))), 0) AS bigint)").alias("max_latency"),
        F.expr(f"CAST(size(filter({TOOL_STEPS}, s -> coalesce(nullif(s.result_status, ''), 'success') <> 'success')) AS bigint)").alias("error_count"),
        *keep,
    )
