"""Formal reading of rules: direct evaluation on traces, and search of all small traces.

The templates quantify over the calls of a trace, so evaluating the formula on it is exact. A
template that some trace violates is violated by one of at most two calls over the rule's own tools, so
trying those decides it for every length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulequarry.operators import checks
from rulequarry.operators.features import with_features
from rulequarry.schema import PARAMS, params_valid

_BEFORE = "forall(sequence(0, size({tools}) - 1), i -> get({tools}, i) <> {b} OR exists(slice({tools}, 1, i), t -> t = {a}))"
_NOT_EMPTY = "size({tools}) = 0 OR "


def _holds(tools: str = "tools", calls: str = "calls") -> str:
    """Whether the row's rule (type, p) holds on a trace of these tools and calls, as SQL; a rule that doesn't apply holds."""
    order = lambda a, b: f"({_NOT_EMPTY.format(tools=tools)}coalesce({_BEFORE.format(a=a, b=b, tools=tools)}, true))"
    cases = {
        "type = 'ordering'": order("p.tool_a", "p.tool_b"),
        "type = 'composition'": order("p.upstream_tool", "p.downstream_tool"),
        "type = 'conditional'": f"NOT array_contains(transform(split(user_text, '\\\\s+'), t -> regexp_replace(t, '[^\\\\p{{L}}\\\\p{{N}}_]', '')), lower(p.keyword)) OR array_contains({tools}, p.tool)",
        "type = 'negative'": f"NOT arrays_overlap({tools}, coalesce(p.forbidden_patterns, CAST(array() AS array<string>)))",
        "type = 'statistical' AND p.metric = 'latency_ms'": f"NOT exists({calls}, c -> c.tool = p.tool AND coalesce(c.latency_ms > p.threshold, false))",
        "type = 'statistical' AND p.metric = 'success_rate'": f"NOT exists({calls}, c -> c.tool = p.tool AND NOT c.ok)",
        "type = 'state'": f"NOT array_contains({tools}, p.terminator_tool) OR NOT exists(slice({tools}, CAST(array_position({tools}, p.terminator_tool) AS int) + 1, size({tools})), t -> array_contains(p.forbidden_after, t))",
        "type = 'tool_selection'": f"coalesce(segment_lower, '') <> lower(p.segment) OR IF(p.forbidden_tool IS NULL, array_contains({tools}, p.expected_tool), NOT array_contains({tools}, p.forbidden_tool))",
    }
    return "coalesce(CASE " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + " ELSE true END, true)"


def holds() -> Column:
    """Whether the row's rule (type, p) holds on the row's trace; a rule that doesn't apply holds."""
    return F.expr(_holds())


def verify(traces: DataFrame, rules: DataFrame) -> DataFrame:
    return checks.with_each(with_features(traces), rules).select("trace_id", "rule_id", holds().alias("holds"))


def outcomes(traces: DataFrame, rules: DataFrame) -> DataFrame:
    """pass or fail by the formal reading; rules that have none (unknown kinds, a language model's verdict, bad parameters) are not_applicable."""
    known = rules.withColumn("type", F.when(params_valid() & (F.col("type") != "output_format"), F.col("type")))
    rows = checks.with_each(with_features(traces), known)
    outcome = F.when(F.col("type").isNull(), F.expr(checks.NA)).when(holds(), "pass").otherwise("fail")
    return rows.select("trace_id", "rule_id", outcome.alias("outcome"))


def signature() -> Column:
    """16 hex digits that name a rule (type, params): of its JSON with sorted keys, without absent parameters."""
    one = lambda x: F.substr(F.to_json(F.array(x)), F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    parts = []
    for name, kind in sorted(x.split(": ") for x in PARAMS[len("struct<") : -1].split(", ")):
        value = F.col(f"params.{name}")
        text = F.concat(F.lit("["), F.array_join(F.transform(value, one), ", "), F.lit("]")) if kind.startswith("array") else one(value)
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f'"{name}": '), text)))
    body = F.concat(F.lit('{"params": {'), F.concat_ws(", ", *parts), F.lit('}, "type": '), one(F.col("type")), F.lit("}"))
    return F.substring(F.sha2(body, 256), 1, 16)


def verify_recent(traces: DataFrame, rules: DataFrame, sample: int = 500, most: int = 3, version: str | None = None) -> DataFrame:
    """Each rule on the `sample` latest traces (of a version): how many hold, the rate to four places, and up to `most` of the latest traces that don't."""
    recent = (traces if version is None else traces.filter(F.col("version") == version)).orderBy(F.desc("started_at"), "trace_id").limit(sample)
    rows = checks.with_each(with_features(recent), rules).select("rule_id", "started_at", "trace_id", holds().alias("holds"))
    broken = F.array_sort(F.collect_list(F.when(~F.col("holds"), F.struct((-F.unix_micros(F.col("started_at").cast("timestamp"))).alias("age"), "trace_id"))))
    out = rows.groupBy("rule_id").agg(F.count("*").alias("sample_size"), F.count_if("holds").alias("holds"), broken.alias("b"))
    shown = F.array_join(F.transform(F.slice("b", 1, most), lambda x: x["trace_id"]), ",")
    out = out.select("rule_id", "sample_size", "holds", (F.col("sample_size") - F.col("holds")).alias("violates"), F.round(F.col("holds") / F.greatest(F.lit(1), "sample_size"), 4).alias("pass_rate"), shown.alias("counter_examples"))
    return out.join(rules.select("rule_id", signature().alias("signature")), "rule_id")


def smallest_violations(rules: DataFrame, slow_ms: int = 60_000) -> DataFrame:
    """rule_id, type, severity, p, and as b (n, slow, text, names) the smallest trace that violates the rule, null if none does.

    Tried are all traces of at most two calls over the rule's own tools, fast and successful or slow and failed, with its keyword and
    segment. They stay in the rule's row, so a task holds those of one rule at a time; rows of one rule_id meet before, not after.
    """
    own = F.expr("""array_sort(array_distinct(filter(concat(array(p.tool_a, p.tool_b, p.tool, p.terminator_tool, p.upstream_tool, p.downstream_tool, p.expected_tool, p.forbidden_tool),
        coalesce(p.forbidden_patterns, array()), coalesce(p.forbidden_after, array())), t -> t IS NOT NULL)))""")
    rows = rules.repartition("rule_id").select("rule_id", "type", "severity", F.col("params").alias("p")).withColumn("own", own)
    one = "transform(own, t -> array(t))"
    two = "flatten(transform(own, a -> transform(own, b -> array(a, b))))"
    call = f"named_struct('tool', t, 'latency_ms', IF(slow, {slow_ms}, 1), 'ok', NOT slow)"
    each = f"transform(array(false, true), slow -> named_struct('slow', slow, 'names', names, 'calls', transform(names, t -> {call})))"
    tried = F.expr(f"flatten(transform(concat(array(CAST(array() AS array<string>)), {one}, {two}), names -> {each}))")
    rows = rows.withColumns({"user_text": F.expr("lower(coalesce(p.keyword, ''))"), "segment_lower": F.expr("lower(p.segment)"), "tried": tried})
    # a pattern is banned by name here, and a trace with that very name violates it
    broken = f"filter(tried, x -> NOT {_holds('x.names', 'x.calls')})"
    least = F.expr(f"array_min(transform({broken}, x -> named_struct('n', size(x.names), 'slow', x.slow, 'text', array_join(x.names, '>'), 'names', x.names)))")
    return rows.select("rule_id", "type", "severity", "p", least.alias("b"))


def counterexamples(rules: DataFrame) -> DataFrame:
    """rule_id, violable, counterexample: the smallest violating trace's calls."""
    best = smallest_violations(rules).groupBy("rule_id").agg(F.min("b").alias("b"))
    return best.select("rule_id", F.col("b").isNotNull().alias("violable"), F.coalesce("b.text", F.lit("")).alias("counterexample"))


def checked_counterexamples(rules: DataFrame, slow_ms: int = 60_000) -> DataFrame:
    """The outcome of each rule's own check on its smallest counterexample."""
    step = "named_struct('type', '{}', 'content', {}, 'tool', {}, 'latency_ms', {}, 'result_status', {})"
    user = step.format("user_input", "coalesce(lower(p.keyword), '')", "CAST(NULL AS string)", "CAST(NULL AS int)", "CAST(NULL AS string)")
    call = step.format("tool_call", "CAST(NULL AS string)", "t", f"IF(b.slow, {slow_ms}, 1)", "IF(b.slow, 'error', 'success')")
    found = smallest_violations(rules, slow_ms).filter("b IS NOT NULL")
    found = found.withColumns({"steps": F.expr(f"concat(array({user}), transform(b.names, t -> {call}))"), "segment": F.col("p.segment")})
    best = with_features(found).withColumn("outcome", checks.outcome(False)).groupBy("rule_id").agg(F.min(F.struct("b", "outcome")).alias("b"))
    return best.select("rule_id", F.col("b.outcome").alias("outcome"))
