"""Checks of a fixed rule table on the event traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulequarry.operators import checks, regress
from rulequarry.plans.registry import query
from rulequarry.schema import RULE
from rulequarry.sources.views import EVENTS, document_traces, event_traces


def rule(rule_id, rule_type, severity, **params):
    return {"rule_id": rule_id, "type": rule_type, "description": f"{rule_type} rule {rule_id}", "severity": severity, "params": params}


TOOLS = ["click", "purchase", "signup", "view"]
RULES = [
    rule("r01", "ordering", "high", tool_a="view", tool_b="purchase"),
    rule("r02", "composition", "medium", upstream_tool="signup", downstream_tool="purchase"),
    rule("r03", "conditional", "medium", keyword="eu", tool="view"),
    rule("r04", "negative", "critical", allowed_repertoire=TOOLS),
    rule("r05", "negative", "high", forbidden_patterns=["Sign", "delete"], category="policy"),
    rule("r06", "statistical", "low", metric="latency_ms", tool="view", threshold=2500.0, percentile=99.0),
    rule("r07", "statistical", "medium", metric="success_rate", tool="click", rate=0.9),
    rule("r08", "state", "critical", terminator_tool="purchase", forbidden_after=["view", "signup"]),
    rule("r09", "tool_selection", "high", segment="eu", expected_tool="view", forbidden_tool="signup"),
    rule("r10", "statistical", "low", metric="feature_envelope", feature="tool_count", p1=1.0, p99=6.0),
    rule("r11", "ordering", "medium", tool_a="click", tool_b="click"),
    rule("r12", "statistical", "medium", metric="success_rate", tool="view", rate=0.0),
    rule("r13", "output_format", "low", rubric="polite"),
    rule("r14", "chain", "low", chain=["view", "click", "purchase"]),
]


def rules_table(spark):
    return spark.createDataFrame(RULES, RULE)


_T = "list_position(tools, '{}')"
_NA = "'not_applicable'"


def _order_sql(a, b):
    return f"CASE WHEN NOT list_contains(tools, '{b}') THEN {_NA} WHEN list_contains(tools, '{a}') AND {_T.format(a)} < {_T.format(b)} THEN 'pass' ELSE 'fail' END"


def _success_sql(tool, rate):
    z = "list_zip(tools, statuses)"
    err = f"len(list_filter({z}, lambda x: x[1] = '{tool}' AND x[2] <> 'success'))"
    n = f"len(list_filter(tools, lambda x: x = '{tool}'))"
    return f"CASE WHEN {n} = 0 THEN {_NA} WHEN CAST(1 AS DOUBLE) - CAST({err} AS DOUBLE) / {n} >= CAST({rate} AS DOUBLE) THEN 'pass' ELSE 'fail' END"


OUTCOMES = {
    "r01": _order_sql("view", "purchase"),
    "r02": _order_sql("signup", "purchase"),
    "r03": f"CASE WHEN NOT contains(lower('Visit from ' || segment || ' shop'), 'eu') THEN {_NA} WHEN list_contains(tools, 'view') THEN 'pass' ELSE 'fail' END",
    "r04": "CASE WHEN len(list_filter(tools, lambda x: x NOT IN ('click', 'purchase', 'signup', 'view'))) > 0 THEN 'fail' ELSE 'pass' END",
    "r05": "CASE WHEN len(list_filter(tools, lambda x: contains(lower(x), 'sign') OR contains(lower(x), 'delete'))) > 0 THEN 'fail' ELSE 'pass' END",
    "r06": f"CASE WHEN NOT list_contains(tools, 'view') THEN {_NA} WHEN len(list_filter(list_zip(tools, latencies), lambda x: x[1] = 'view' AND x[2] > 2500)) > 0 THEN 'warn' ELSE 'pass' END",
    "r07": _success_sql("click", 0.9),
    "r08": f"CASE WHEN NOT list_contains(tools, 'purchase') THEN {_NA} WHEN len(list_filter(tools[list_position(tools, 'purchase') + 1:], lambda x: x IN ('view', 'signup'))) > 0 THEN 'fail' ELSE 'pass' END",
    "r09": f"CASE WHEN lower(segment) <> 'eu' THEN {_NA} WHEN list_contains(tools, 'signup') THEN 'fail' WHEN list_contains(tools, 'view') THEN 'pass' ELSE {_NA} END",
    "r10": "CASE WHEN len(tools) BETWEEN 1 AND 6 THEN 'pass' ELSE 'warn' END",
    "r11": _NA,
    "r12": _success_sql("view", 0.95),
    "r13": _NA,
    "r14": f"""CASE WHEN NOT list_contains(tools, 'purchase') THEN {_NA}
        WHEN regexp_matches(array_to_string(tools, ','), '(^|,)view(,|,.*,)click(,|,.*,)purchase(,|$)') THEN 'pass' ELSE 'fail' END""",
}
RESULTS = f"WITH {EVENTS}, results AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT trace_id, version, '{r['rule_id']}' AS rule_id, '{r['type']}' AS type, '{r['severity']}' AS severity, {OUTCOMES[r['rule_id']]} AS outcome FROM tr" for r in RULES
) + ")"
SUMMARY = f"""{RESULTS}, counts AS (
  SELECT rule_id, version, count(*) FILTER (WHERE outcome = 'pass') AS passed, count(*) FILTER (WHERE outcome = 'fail') AS failed, count(*) FILTER (WHERE outcome = 'warn') AS warned
  FROM results GROUP BY rule_id, version),
summary AS (
  SELECT *, passed + failed + warned AS applicable, round_even(passed / greatest(1, passed + failed + warned), 4) AS pass_rate,
         round_even(failed / greatest(1, passed + failed + warned), 4) AS fail_rate, round_even(warned / greatest(1, passed + failed + warned), 4) AS warn_rate FROM counts)"""


def results(spark, sf_dir):
    return checks.check_all(event_traces(spark, sf_dir), rules_table(spark))


@query(f"{RESULTS} SELECT trace_id, version, rule_id, type, severity, outcome FROM results")
def check_all(spark, sf_dir):
    return results(spark, sf_dir).select("trace_id", "version", "rule_id", "type", "severity", "outcome")


def _one(name, rule_id):
    def run(spark, sf_dir):
        return checks.check_all(event_traces(spark, sf_dir), rules_table(spark).filter(F.col("rule_id") == rule_id)).select("trace_id", "outcome")

    query(f"{RESULTS} SELECT trace_id, outcome FROM results WHERE rule_id = '{rule_id}'", name)(run)


for _name, _id in {
    "check_ordering": "r01", "check_composition": "r02", "check_conditional": "r03", "check_repertoire": "r04", "check_denylist": "r05", "check_latency": "r06",
    "check_success_rate": "r07", "check_state": "r08", "check_tool_selection": "r09", "check_envelope": "r10", "check_output_format": "r13", "check_chain": "r14",
}.items():
    _one(_name, _id)


@query("""
SELECT CAST(doc_id AS VARCHAR) AS trace_id,
       CASE WHEN NOT contains(lower(text), 'the ') THEN 'not_applicable' WHEN lang = 'en' THEN 'pass' ELSE 'fail' END AS outcome FROM documents""")
def check_conditional_documents(spark, sf_dir):
    rules = spark.createDataFrame([rule("d1", "conditional", "low", keyword="the ", tool="lang_en")], RULE)
    return checks.check_all(document_traces(spark, sf_dir), rules).select("trace_id", "outcome")


#: What each rule expects, and how what was seen is put, as text over the columns of a failed row.
_SAID = {
    "r01": ("`view` called before `purchase`", "'`purchase` called at step ' || first_step || ' without `view` before it'"),
    "r02": ("`signup` before any `purchase`", "'`purchase` called at step ' || first_step || ' without `signup` before it'"),
    "r03": ("tool `view` invoked when input mentions 'eu'", "'tool `view` not invoked'"),
    "r04": ("only tools of the allowed repertoire", "'called `' || first_tool || '` at step ' || first_step"),
    "r05": ("no tool whose name has one of: Sign, delete", "'called `' || first_tool || '` at step ' || first_step"),
    "r06": ("latency <= 2500ms", "'`view` took ' || worst || 'ms'"),
    "r07": ("success rate >= 90.00%", "'`click` failed ' || n_affected || ' times'"),
    "r12": ("success rate >= 95.00%", "'`view` failed ' || n_affected || ' times'"),
    "r08": ("none of view, signup after `purchase`", "'called `' || first_tool || '` at step ' || first_step"),
    "r09": ("segment 'eu' routes to `view`", "'called `' || first_tool || '` at step ' || first_step"),
    "r10": ("tool_count between 1 and 6", "'tool_count is ' || n_tools"),
    "r14": ("`view` then `click` then `purchase`", "'the calls are not in that order'"),
}
_QUOTED = {k: (a.replace("'", "''"), b) for k, (a, b) in _SAID.items()}


#: The calls that a failed check is about, by rule.
_HITS = {
    "r01": "tool = 'purchase'", "r02": "tool = 'purchase'", "r04": "tool NOT IN ('click', 'purchase', 'signup', 'view')", "r05": "(contains(lower(tool), 'sign') OR contains(lower(tool), 'delete'))", "r06": "tool = 'view' AND latency_ms > 2500",
    "r07": "tool = 'click' AND status <> 'success'", "r12": "tool = 'view' AND status <> 'success'", "r08": "tool IN ('view', 'signup')", "r09": "tool = 'signup'",
}


@query(f"""{RESULTS},
bad AS MATERIALIZED (SELECT trace_id, rule_id, outcome FROM results WHERE outcome IN ('fail', 'warn')),
hits AS MATERIALIZED ({' UNION ALL '.join(f"SELECT s.trace_id, '{k}' AS rule_id, s.ti, s.tool FROM (SELECT trace_id, ti, tool FROM st WHERE {v}) s JOIN (SELECT trace_id FROM bad WHERE rule_id = '{k}') b ON b.trace_id = s.trace_id" for k, v in _HITS.items())}),
h AS MATERIALIZED (SELECT trace_id, rule_id, string_agg(CAST(ti + 1 AS VARCHAR), ',' ORDER BY ti) AS affected, count(*) AS n_affected, CAST(min(ti) + 1 AS VARCHAR) AS first_step, arg_min(tool, ti) AS first_tool FROM hits GROUP BY trace_id, rule_id),
w AS MATERIALIZED (SELECT trace_id, max(latency_ms) AS worst FROM st WHERE tool = 'view' GROUP BY trace_id),
v AS (SELECT r.trace_id, r.rule_id, r.outcome, coalesce(h.affected, '') AS affected, CASE WHEN r.rule_id = 'r06' THEN CAST(w.worst AS BIGINT) END AS worst, coalesce(h.n_affected, 0) AS n_affected, h.first_step, h.first_tool, len(tr.tools) AS n_tools
  FROM bad r JOIN tr ON tr.trace_id = r.trace_id LEFT JOIN h ON h.trace_id = r.trace_id AND h.rule_id = r.rule_id LEFT JOIN w ON w.trace_id = r.trace_id)
SELECT trace_id, rule_id, outcome, affected, worst, CASE rule_id {' '.join(f"WHEN '{k}' THEN '{a}'" for k, (a, _) in _QUOTED.items())} END AS expected,
  CASE rule_id {' '.join(f"WHEN '{k}' THEN {b}" for k, (_, b) in _QUOTED.items())} END AS observed FROM v""")
def violation_details(spark, sf_dir):
    return checks.details(event_traces(spark, sf_dir), rules_table(spark))


@query(f"""WITH {EVENTS},
p AS (SELECT s.trace_id, s.ti + 1 AS n, s.segment, t.tools[1:s.ti + 1] AS tools FROM st s JOIN tr t USING (trace_id)),
b AS (
  SELECT trace_id, n, 'r01' AS rule_id FROM p WHERE ({OUTCOMES['r01']}) = 'fail' UNION ALL SELECT trace_id, n, 'r02' FROM p WHERE ({OUTCOMES['r02']}) = 'fail' UNION ALL
  SELECT trace_id, n, 'r03' FROM p WHERE ({OUTCOMES['r03']}) = 'fail' UNION ALL SELECT trace_id, n, 'r04' FROM p WHERE ({OUTCOMES['r04']}) = 'fail' UNION ALL
  SELECT trace_id, n, 'r05' FROM p WHERE ({OUTCOMES['r05']}) = 'fail' UNION ALL SELECT trace_id, n, 'r08' FROM p WHERE ({OUTCOMES['r08']}) = 'fail' UNION ALL
  SELECT trace_id, n, 'r09' FROM p WHERE ({OUTCOMES['r09']}) = 'fail')
SELECT trace_id, rule_id, min(n) AS blocked_call FROM b GROUP BY ALL""")
def guardrail_replay(spark, sf_dir):
    rules = rules_table(spark).filter("rule_id IN ('r01', 'r02', 'r03', 'r04', 'r05', 'r08', 'r09', 'r10', 'r11')")
    return checks.guardrail_replay(event_traces(spark, sf_dir), rules)


@query(f"{SUMMARY} SELECT rule_id, version, passed, failed, warned, applicable, pass_rate, fail_rate, warn_rate FROM summary")
def batch_summary(spark, sf_dir):
    return regress.batch_summary(results(spark, sf_dir), ("rule_id", "version"))


_COMPARE = f"""{SUMMARY}, compared AS (
  SELECT r.rule_id, r.severity, {', '.join(f'coalesce(b.{c}, 0) AS b_{c}, coalesce(c.{c}, 0) AS c_{c}' for c in ('applicable', 'passed', 'failed', 'warned', 'pass_rate', 'fail_rate', 'warn_rate'))}
  FROM (SELECT DISTINCT rule_id, severity FROM results) r LEFT JOIN (SELECT * FROM summary WHERE version = 'v1') b USING (rule_id) LEFT JOIN (SELECT * FROM summary WHERE version = 'v2') c USING (rule_id)),
judged AS (
  SELECT *, CASE WHEN c_applicable < 3 THEN 'pass' WHEN c_fail_rate > b_fail_rate AND c_pass_rate <= b_pass_rate - CAST(0.1 AS DOUBLE) THEN 'fail'
                 WHEN c_warn_rate >= b_warn_rate + CAST(0.1 AS DOUBLE) THEN 'warn' ELSE 'pass' END AS verdict FROM compared)"""


@query(f"{_COMPARE} SELECT * FROM judged")
def regression_compare(spark, sf_dir):
    return regress.compare(regress.batch_summary(results(spark, sf_dir), ("rule_id", "version")), rules_table(spark))


@query(f"{_COMPARE} SELECT CAST(max(CASE WHEN verdict = 'fail' THEN 1 ELSE 0 END) AS INTEGER) AS exit_code FROM judged")
def exit_code(spark, sf_dir):
    return regress.exit_code(regression_compare(spark, sf_dir))


@query(f"""{RESULTS} SELECT rule_id, string_agg(trace_id, ',' ORDER BY trace_id) AS samples FROM (
  SELECT rule_id, trace_id, row_number() OVER (PARTITION BY rule_id ORDER BY trace_id) AS k FROM results WHERE outcome IN ('fail', 'warn')) WHERE k <= 5 GROUP BY rule_id""")
def first_failing(spark, sf_dir):
    return regress.first_failing(results(spark, sf_dir))


@query(f"""{RESULTS}, f AS (SELECT rule_id, min(trace_id) FILTER (WHERE version = 'v2' AND outcome = 'fail') AS failing, min(trace_id) FILTER (WHERE version = 'v1' AND outcome = 'pass') AS good FROM results GROUP BY rule_id)
SELECT rule_id, failing, good, (SELECT segment FROM tr WHERE trace_id = failing) AS segment FROM f""")
def root_cause_inputs(spark, sf_dir):
    """The first failing candidate trace of each rule, the first passing baseline trace, and the failing segment."""
    found = checks.check_all(event_traces(spark, sf_dir), rules_table(spark), ("version", "segment"))
    failing = F.min(F.when((F.col("version") == "v2") & (F.col("outcome") == "fail"), F.struct("trace_id", "segment")))
    good = F.min(F.when((F.col("version") == "v1") & (F.col("outcome") == "pass"), F.col("trace_id")))
    return found.groupBy("rule_id").agg(failing.alias("f"), good.alias("good")).select("rule_id", F.col("f.trace_id").alias("failing"), "good", F.col("f.segment").alias("segment"))


@query(f"""{RESULTS}, f AS (SELECT rule_id, min(trace_id) FILTER (WHERE version = 'v2' AND outcome = 'fail') AS failing FROM results GROUP BY rule_id)
SELECT rule_id, 'Rule ' || rule_id || ' fails on trace ' || failing || ' in segment ' || (SELECT segment FROM tr WHERE trace_id = failing) AS hint FROM f WHERE failing IS NOT NULL""")
def root_cause_hint(spark, sf_dir):
    return root_cause_inputs(spark, sf_dir).filter("failing IS NOT NULL").select("rule_id", F.format_string("Rule %s fails on trace %s in segment %s", "rule_id", "failing", "segment").alias("hint"))


_PACK = f"""{SUMMARY}, whole AS (SELECT rule_id, sum(passed) AS passed, sum(passed + failed + warned) AS applicable FROM counts GROUP BY rule_id), n AS (SELECT count(*) AS n FROM tr),
fit AS (SELECT rule_id, applicable / n AS app, CASE WHEN applicable > 0 THEN passed / applicable ELSE 0.0 END AS rate FROM whole, n)"""


@query(f"""{_PACK} SELECT rule_id, CAST(app AS DOUBLE) AS applicability, CAST(rate AS DOUBLE) AS pass_rate, round(CAST(0.4 AS DOUBLE) * app + CAST(0.6 AS DOUBLE) * rate, 6) AS fit,
  CASE WHEN round(CAST(0.4 AS DOUBLE) * app + CAST(0.6 AS DOUBLE) * rate, 6) >= 0.85 THEN 'active' WHEN round(CAST(0.4 AS DOUBLE) * app + CAST(0.6 AS DOUBLE) * rate, 6) >= 0.6 THEN 'pending' ELSE 'rejected' END AS status FROM fit""")
def pack_autofit(spark, sf_dir):
    """How well a pack of rules fits the traces: applicability and pass rate, weighed."""
    traces = event_traces(spark, sf_dir)
    whole = regress.batch_summary(checks.check_all(traces, rules_table(spark)))
    n = traces.agg(F.count("*").alias("n"))
    rate = F.when(F.col("applicable") > 0, F.col("passed") / F.col("applicable")).otherwise(0.0)
    out = whole.crossJoin(F.broadcast(n)).select("rule_id", (F.col("applicable") / F.col("n")).alias("applicability"), rate.alias("pass_rate"))
    out = out.withColumn("fit", F.round(F.lit(0.4) * F.col("applicability") + F.lit(0.6) * F.col("pass_rate"), 6))
    return out.withColumn("status", F.when(F.col("fit") >= 0.85, "active").when(F.col("fit") >= 0.6, "pending").otherwise("rejected"))
