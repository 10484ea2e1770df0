"""Rule checks: the outcome of a rule on a trace as one Catalyst expression over the trace's arrays.

A check reads with_features() and a rule's params and gives pass, fail, warn or not_applicable. The
rules are the small side: their size is checked, and they are broadcast while they have at most
MAX_RULES rows; a larger table is checked in parts. The traces are never shuffled.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulequarry.operators.features import with_features
from rulequarry.schema import PARAMS, severity_rank

MAX_RULES = 20_000
NA = "'not_applicable'"


def _first(tool: str) -> str:
    return f"array_position(tools, {tool})"


def _order(a: str, b: str) -> str:
    return f"""CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} = {b} OR {_first(b)} = 0 THEN {NA}
        WHEN {_first(a)} > 0 AND {_first(a)} < {_first(b)} THEN 'pass' ELSE 'fail' END"""


ORDERING = _order("coalesce(p.tool_a, p.chain[0])", "coalesce(p.tool_b, try_element_at(p.chain, -1))")
COMPOSITION = _order("p.upstream_tool", "p.downstream_tool")
CHAIN = f"""CASE WHEN size(p.chain) < 2 OR p.chain IS NULL THEN {NA}
    WHEN NOT array_contains(tools, try_element_at(p.chain, -1)) THEN {NA}
    WHEN aggregate(tools, 0, (k, t) -> IF(k < size(p.chain) AND t = get(p.chain, k), k + 1, k)) = size(p.chain) THEN 'pass' ELSE 'fail' END"""
CONDITIONAL = f"CASE WHEN p.keyword IS NULL OR p.tool IS NULL OR NOT contains(user_text, lower(p.keyword)) THEN {NA} WHEN array_contains(tools, p.tool) THEN 'pass' ELSE 'fail' END"
NEGATIVE = f"""CASE WHEN size(p.allowed_repertoire) > 0 THEN IF(size(array_except(tools, p.allowed_repertoire)) > 0, 'fail', 'pass')
    WHEN size(p.forbidden_patterns) > 0 THEN IF(exists(tools, t -> exists(p.forbidden_patterns, f -> contains(lower(t), lower(f)))), 'fail', 'pass')
    ELSE {NA} END"""
LATENCY = f"CASE WHEN p.tool IS NULL OR p.threshold IS NULL OR NOT array_contains(tools, p.tool) THEN {NA} WHEN exists(calls, c -> c.tool = p.tool AND coalesce(c.latency_ms > p.threshold, false)) THEN 'warn' ELSE 'pass' END"
_OF = "size(filter(calls, c -> c.tool = p.tool))"
SUCCESS = f"""CASE WHEN p.tool IS NULL OR NOT array_contains(tools, p.tool) THEN {NA}
    WHEN 1D - CAST(size(filter(calls, c -> c.tool = p.tool AND NOT c.ok)) AS double) / {_OF} >= coalesce(nullif(p.rate, 0D), 0.95D) THEN 'pass' ELSE 'fail' END"""
_FEATURES = {
    "step_count": "size(steps)",
    "tool_count": "size(calls)",
    "distinct_tools": "size(array_distinct(tools))",
    "sum_latency": "aggregate(calls, 0L, (a, c) -> a + coalesce(c.latency_ms, 0))",
    "max_latency": "coalesce(array_max(transform(calls, c -> coalesce(c.latency_ms, 0))), 0)",
    "error_count": "size(filter(calls, c -> NOT c.ok))",
    "user_chars": "aggregate(filter(steps, s -> s.type = 'user_input'), 0L, (a, s) -> a + length(coalesce(s.content, '')))",
    "response_chars": "aggregate(filter(steps, s -> s.type = 'agent_response'), 0L, (a, s) -> a + length(coalesce(s.content, '')))",
}
_FEATURE = "CASE p.feature " + " ".join(f"WHEN '{k}' THEN CAST({v} AS double)" for k, v in _FEATURES.items()) + " END"
ENVELOPE = f"CASE WHEN {_FEATURE} IS NULL OR p.p1 IS NULL OR p.p99 IS NULL THEN {NA} WHEN {_FEATURE} BETWEEN p.p1 AND p.p99 THEN 'pass' ELSE 'warn' END"
STATE = f"""CASE WHEN p.terminator_tool IS NULL OR NOT array_contains(tools, p.terminator_tool) THEN {NA}
    WHEN exists(slice(tools, CAST({_first('p.terminator_tool')} AS int) + 1, size(tools)), t -> array_contains(p.forbidden_after, t)) THEN 'fail' ELSE 'pass' END"""
SELECTION = f"""CASE WHEN p.segment IS NULL OR segment_lower IS NULL OR segment_lower <> lower(p.segment) THEN {NA}
    WHEN p.forbidden_tool IS NOT NULL AND NOT (p.forbidden_tool <=> p.expected_tool) AND array_contains(tools, p.forbidden_tool) THEN 'fail'
    WHEN array_contains(tools, p.expected_tool) THEN 'pass' ELSE {NA} END"""
BY_TYPE = {
    "ordering": ORDERING,
    "chain": CHAIN,
    "composition": COMPOSITION,
    "conditional": CONDITIONAL,
    "negative": NEGATIVE,
    "state": STATE,
    "tool_selection": SELECTION,
}
_extra: dict[str, str] = {}


def register(rule_type: str, expression: str) -> None:
    """Add a check of your own: SQL over calls, tools, user_text, segment_lower and the rule's params as p."""
    _extra[rule_type] = expression


def outcome(envelope: bool = True) -> Column:
    """The outcome of the row's rule (type, p) on the row's trace; unknown types, and envelopes if not wanted, are not applicable."""
    cases = " ".join(f"WHEN type = '{k}' THEN {v}" for k, v in (BY_TYPE | _extra).items())
    return F.expr(f"""CASE {cases}
        WHEN type = 'statistical' AND p.metric = 'latency_ms' THEN {LATENCY}
        WHEN type = 'statistical' AND p.metric = 'success_rate' THEN {SUCCESS}
        WHEN type = 'statistical' AND p.metric = 'feature_envelope' THEN {ENVELOPE if envelope else NA}
        ELSE {NA} END""")


def check_all(traces: DataFrame, rules: DataFrame, keep: tuple[str, ...] = ("version",), strict_compat: bool = False) -> DataFrame:
    """Every rule on every trace: trace_id, rule_id, type, severity, outcome and the columns in keep.

    Up to MAX_LITERAL rules are read and become one projection of the trace, an outcome for each with its parameters as constants, so a
    trace isn't copied for each rule; more are put beside the traces. Both give the same rows.
    """
    rows = with_features(traces)
    few = rules.select("rule_id", "type", "severity", "params").limit(MAX_LITERAL + 1).collect()
    if len(few) > MAX_LITERAL:
        return with_each(rows, rules).select("trace_id", "rule_id", "type", "severity", *keep, outcome(not strict_compat).alias("outcome"))
    if not few:
        few_rows = rows.filter("false").select("trace_id", *[F.lit("").alias(c) for c in ("rule_id", "type", "severity")], *keep, F.lit("").alias("outcome"))
        return few_rows
    # the arrays that all rules read are made once, before the projection that repeats the trace's columns in each of its entries
    wide = rows.select("trace_id", *keep, *[c for c in ("steps", "calls", "tools", "user_text", "segment_lower") if c not in keep])
    of_rule = [
        F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.type).cast("string").alias("type"), F.lit(r.severity).cast("string").alias("severity"), F.expr(_with_literals(_case(r, not strict_compat), r.params)).cast("string").alias("outcome"))
        for r in few
    ]
    return wide.select("trace_id", *keep, F.inline(F.array(*of_rule))).select("trace_id", "rule_id", "type", "severity", *keep, "outcome")


#: Rules of a table that are built into the plan; each adds an expression to it.
MAX_LITERAL = 64


def _case(r, envelope: bool) -> str:
    """The expression of one rule's type, with its parameters as p."""
    known = BY_TYPE | _extra
    if r.type in known:
        return known[r.type]
    metric = r.params.metric if r.type == "statistical" and r.params else None
    return {"latency_ms": LATENCY, "success_rate": SUCCESS, "feature_envelope": ENVELOPE if envelope else NA}.get(metric, NA)


def _sql(value, kind: str) -> str:
    """A value of params as a constant of SQL."""
    if value is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(value, list):
        return f"CAST(array({', '.join(_sql(v, 'string') for v in value)}) AS {kind})"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS double)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_KINDS = dict(x.split(": ") for x in PARAMS[len("struct<") : -1].split(", "))


def _with_literals(text: str, params) -> str:
    given = params.asDict() if params is not None else {}
    return re.sub(r"\bp\.(\w+)", lambda m: _sql(given.get(m[1]), _KINDS.get(m[1], "string")), text)


def with_each(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Every row beside every rule (rule_id, type, severity, p); rules are broadcast in parts of at most MAX_RULES."""
    some = rules.select("rule_id", "type", "severity", F.col("params").alias("p"))
    parts = max(1, -(-rules.count() // MAX_RULES))
    split = [some if parts == 1 else some.filter(F.pmod(F.xxhash64("rule_id"), F.lit(parts)) == k) for k in range(parts)]
    return reduce(DataFrame.unionByName, [rows.crossJoin(F.broadcast(x)) for x in split])


def details(traces: DataFrame, rules: DataFrame) -> DataFrame:
    """Failed and warned checks, with the offending step numbers, the worst value, and what was expected and observed as text."""
    rows = with_each(with_features(traces), rules).withColumn("outcome", outcome()).filter("outcome IN ('fail', 'warn')")
    affected = f"""transform(filter(calls, c -> CASE
        WHEN type = 'statistical' AND p.metric = 'latency_ms' THEN c.tool = p.tool AND coalesce(c.latency_ms > p.threshold, false)
        WHEN type = 'statistical' AND p.metric = 'success_rate' THEN c.tool = p.tool AND NOT c.ok
        WHEN type = 'negative' AND size(p.allowed_repertoire) > 0 THEN NOT array_contains(p.allowed_repertoire, c.tool)
        WHEN type = 'negative' THEN exists(p.forbidden_patterns, f -> contains(lower(c.tool), lower(f)))
        WHEN type = 'ordering' THEN c.tool = p.tool_b
        WHEN type = 'composition' THEN c.tool = p.downstream_tool
        WHEN type = 'state' THEN array_contains(p.forbidden_after, c.tool)
        WHEN type = 'tool_selection' THEN c.tool = p.forbidden_tool
        ELSE false END), c -> CAST(c.i AS string))"""
    worst = "CASE WHEN type = 'statistical' AND p.metric = 'latency_ms' THEN array_max(transform(filter(calls, c -> c.tool = p.tool), c -> c.latency_ms)) END"
    rows = rows.withColumns({"__hits": F.expr(affected), "worst": F.expr(worst).cast("long")})
    # of the affected steps: the first, its tool, and the value of a feature
    rows = rows.withColumns({"__first": F.expr("try_element_at(__hits, 1)"), "__value": F.expr(_FEATURE)})
    rows = rows.withColumn("__tool", F.expr("try_element_at(filter(calls, c -> c.i = CAST(__first AS int)), 1).tool"))
    said = [F.expr(f"CASE {' '.join(f'WHEN {when} THEN {pair[k]}' for when, pair in SAID.items())} END").alias(name) for k, name in enumerate(("expected", "observed"))]
    return rows.select("trace_id", "rule_id", "outcome", F.array_join("__hits", ",").alias("affected"), "worst", *said)


_AT = "concat('called `', __tool, '` at step ', __first)"
_LATE = "concat('`', {b}, '` called at step ', __first, ' without `', {a}, '` before it')"
_A, _B = "coalesce(p.tool_a, p.chain[0])", "coalesce(p.tool_b, try_element_at(p.chain, -1))"
#: What a rule expects and what was seen, by kind of rule.
SAID = {
    "type = 'ordering'": (f"concat('`', {_A}, '` called before `', {_B}, '`')", _LATE.format(a=_A, b=_B)),
    "type = 'composition'": ("concat('`', p.upstream_tool, '` before any `', p.downstream_tool, '`')", _LATE.format(a="p.upstream_tool", b="p.downstream_tool")),
    "type = 'chain'": ("array_join(transform(p.chain, t -> concat('`', t, '`')), ' then ')", "'the calls are not in that order'"),
    "type = 'conditional'": ("concat('tool `', p.tool, '` invoked when input mentions \\'', p.keyword, '\\'')", "concat('tool `', p.tool, '` not invoked')"),
    "type = 'negative' AND size(p.allowed_repertoire) > 0": ("'only tools of the allowed repertoire'", _AT),
    "type = 'negative'": ("concat('no tool whose name has one of: ', array_join(p.forbidden_patterns, ', '))", _AT),
    "type = 'state'": ("concat('none of ', array_join(p.forbidden_after, ', '), ' after `', p.terminator_tool, '`')", _AT),
    "type = 'tool_selection'": ("concat('segment \\'', p.segment, '\\' routes to `', p.expected_tool, '`')", _AT),
    "p.metric = 'latency_ms'": ("concat('latency <= ', CAST(round(p.threshold) AS bigint), 'ms')", "concat('`', p.tool, '` took ', worst, 'ms')"),
    "p.metric = 'success_rate'": ("format_string('success rate >= %.2f%%', 100 * coalesce(nullif(p.rate, 0D), 0.95D))", "concat('`', p.tool, '` failed ', size(__hits), ' times')"),
    "p.metric = 'feature_envelope'": ("concat(p.feature, ' between ', format_number(p.p1, '0.##'), ' and ', format_number(p.p99, '0.##'))", "concat(p.feature, ' is ', format_number(__value, '0.##'))"),
}


def guardrail_replay(traces: DataFrame, rules: DataFrame, least_rank: int = 1) -> DataFrame:
    """The first call of each trace and rule at which a check of the calls so far, without results, fails."""
    some = rules.filter(severity_rank("severity") >= least_rank)
    full = with_features(traces).filter("size(calls) > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.size("calls"))))
    prefix = full.withColumns(
        {
            "calls": F.expr("transform(slice(calls, 1, n), (c, k) -> IF(k = n - 1, named_struct('i', c.i, 'type', c.type, 'tool', c.tool, 'latency_ms', CAST(NULL AS int), 'ok', true), c))"),
            "tools": F.expr("slice(tools, 1, n)"),
        }
    )
    return with_each(prefix, some).withColumn("outcome", outcome(False)).filter("outcome = 'fail'").groupBy("trace_id", "rule_id").agg(F.min("n").cast("long").alias("blocked_call"))
