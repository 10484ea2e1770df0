"""Payloads of any depth, exports, alias tables, renames and statements under other planners."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import compare
from rulequarry.functions import payload
from rulequarry.operators import aliases, exports, features, versions
from rulequarry.plans import catalog
from rulequarry.schema import RULE, TRACE

SF = "/root/testdata/sf0.001"


def value(rng, depth):
    kind = rng.randrange(7 if depth else 5)
    if kind == 5:
        return [value(rng, depth - 1) for _ in range(rng.randrange(6))]
    if kind == 6:
        return {rng.choice(["a", "b:", "Password", "api_key", "k\\\"", "é", "credentials"]) + rng.choice(["", "", "1"]): value(rng, depth - 1) for _ in range(rng.randrange(6))}
    return [None, True, -1.5e3, "te\\xt {\"}[,: " * rng.randrange(4), "ü\n" * rng.randrange(9)][kind]


def plain_redacted(v):
    if isinstance(v, dict):
        return {k: "[redacted:blocked_field]" if k.lower() in payload.BLOCKED else plain_redacted(x) for k, x in v.items()}
    return [plain_redacted(x) for x in v] if isinstance(v, list) else v


def plain_cut(v, chars, items):
    if isinstance(v, dict):
        return {k: plain_cut(x, chars, items) for k, x in list(v.items())[:items]}
    if isinstance(v, list):
        return [plain_cut(x, chars, items) for x in v[:items]]
    return v[:chars] + "…" if isinstance(v, str) and len(v) > chars else v


def test_payloads_by_plain_recursion():
    rng = random.Random(3)
    for k in range(600):
        v = value(rng, 6)
        text = json.dumps(v, ensure_ascii=bool(k % 2), indent=rng.choice([None, 1]))
        assert json.loads(payload.redact_json(text)) == plain_redacted(v), text
        assert json.loads(payload.truncate_json(text, 5, 3)) == plain_cut(v, 5, 3), text


def test_deep_and_broken_payloads():
    deep = '{"a":' * 50_000 + '{"password": [1, {"x": "SECRET"}], "b": 2}' + "}" * 50_000
    assert "SECRET" not in payload.redact_json(deep) and payload.redact_json(deep).count("}") == 50_001
    assert payload.truncate_json(deep, 3, 1).startswith('{"a":' * 50_000 + '{"password":[1]}')
    for text in ("", '{"password"', '{"password":', '{"api_key": "open', "[[[", "]]]", '{"credentials": }', "null", "[1,2,3,4", ":", ",,,"):
        assert isinstance(payload.redact_json(text), str) and isinstance(payload.truncate_json(text, 2, 2), str)
    assert payload.redact_json('{"api_key": "open') == '{"api_key": "[redacted:blocked_field]"' and payload.redact_json(None) is None is payload.truncate_json(None, 1, 1)


def test_compact_steps(spark):
    steps = "array(named_struct('type', 'tool_call', 'content', CAST(NULL AS string), 'tool', 't', 'latency_ms', 5, 'result_status', 'success', 'other', 1), named_struct('type', 'user_input', 'content', repeat('x', 241), 'tool', NULL, 'latency_ms', NULL, 'result_status', NULL, 'other', 2))"
    row = spark.range(1).select(F.expr(steps).alias("steps")).select(payload.compact_steps("steps", ("content", "tool", "latency_ms", "result_status")).alias("c")).first()
    assert json.loads(row.c) == [{"type": "tool_call", "tool": "t", "latency_ms": 5, "result_status": "success"}, {"type": "user_input", "content": "x" * 240 + "…"}]


def test_renames_are_those_of_serving_in_order(spark):
    rng = random.Random(9)
    for _ in range(3):
        old, new = ({"".join(rng.choice("abc") for _ in range(rng.randint(4, 6))) for _ in range(60)} for _ in range(2))
        near = lambda a, b: min(2, max(1, len(a) // 4)) >= distance(a, b)
        used, want = set(), {}
        for a in sorted(old - new):
            best = min(((distance(a, b), b) for b in new - old - used if near(a, b)), default=None)
            if best:
                want[a] = best[1]
                used.add(best[1])
        frame = lambda names: spark.createDataFrame([(n,) for n in sorted(names)], "name string")
        assert {r.old_name: r.new_name for r in versions.renames(frame(old - new), frame(new - old)).collect()} == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alias_tables_by_broadcast_and_by_join(spark):
    steps = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b"), ("t", 3, None), ("u", 1, "a")], "trace_id string, i int, tool string")
    known = spark.createDataFrame([("a", "z"), ("a", "y"), (None, "n"), ("c", None)], "raw string, canonical string")
    want = [("t", 1, "y"), ("t", 2, "b"), ("t", 3, None), ("u", 1, "y")]
    for most in (10, 0):
        found = aliases.applied(steps, known, most)
        assert sorted(map(tuple, found.select("trace_id", "i", "tool").collect()), key=str) == want
        assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) == (most == 10)


def test_sampling_modes(spark):
    step = lambda ms, status: ("tool_call", None, "x", ms, status)
    traces = spark.createDataFrame([("a", "s", "v", None, None, [step(5, "success")]), ("b", "s", "v", None, None, [step(5, "timeout")]), ("c", "s", "v", None, None, [step(1000, None)]), ("d", "s", "v", "EU", None, [])], TRACE)
    kept = lambda *a, **k: [r.kept for r in traces.orderBy("trace_id").select(features.sampled(*a, **k).alias("kept")).collect()]
    assert kept("none", 0.0) == [True] * 4 and kept("rate", 0.0) == [False, True, False, False] and kept("rate", 0.0, keep_errors=False) == [False] * 4
    assert kept("tail_on_error", 1.0) == [True] * 4 and kept("adaptive", 0.0) == [False, True, True, True] and kept("adaptive", 0.0, keep_segments=False) == [False, True, True, False]
    with pytest.raises(ValueError):
        features.sampled("often")


def test_exports_without_rules_and_without_templates(spark):
    none = spark.createDataFrame([], RULE)
    assert [r.text.splitlines()[-1] for r in exports.test_config(none).collect()] == ["  []"]
    odd = spark.createDataFrame([{"rule_id": "x", "type": "statistical", "description": "d", "severity": "low", "params": {"metric": "feature_envelope"}}, {"rule_id": "y", "type": "negative", "description": 'say "hi": now', "severity": "low", "params": {}}], RULE)
    assert [(r.rule_id, r.block) for r in exports.test_blocks(odd).collect()] == [("y", "  - description: \"say 'hi': now\"\n    metadata:\n      severity: low\n      type: negative\n    assert:\n      - type: not-contains-any\n        value:")]


@pytest.mark.parametrize("setting", ["SET threads = 1; SET memory_limit = '200MB'", "SET disabled_optimizers = 'join_order'", "SET disabled_optimizers = 'join_order,filter_pushdown,statistics_propagation'"])
def test_statement_of_details_under_other_planners(setting):
    con = compare.connection(SF)
    want = sorted(con.execute(catalog.oracle_sql()["violation_details"]).fetchall(), key=str)
    try:
        con.execute(setting)
    except duckdb.Error:
        pytest.skip("this DuckDB has no such setting")
    assert sorted(con.execute(catalog.oracle_sql()["violation_details"]).fetchall(), key=str) == want


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_traces_stay_in_their_rule(spark):
    """The traces tried for a rule aren't rows that a task sorts."""
    from rulequarry.plans import store

    for query in (store.bounded_counterexample, store.synth_violation):
        assert "Generate" not in _plan(query(spark, "/root/testdata/sf0.001"))


def test_long_payloads_go_to_python_in_small_batches(spark):
    from rulequarry.plans import payloads

    plan = _plan(payloads.value_truncation(spark, "/root/testdata/sf0.001"))
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
