"""A stored table of rules: filters, counts, validity, exports, reports, policies, packs; renames and aliases of stored names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rulequarry.operators import aliases, exports
from rulequarry.operators import verify as V
from rulequarry.plans.checking import _COMPARE, regression_compare, rules_table
from rulequarry.plans.registry import query
from rulequarry.schema import SEVERITY, TYPES, params_valid, severity_rank
from rulequarry.sources.rules import STATUSES, STORED, stored_rules
from rulequarry.sources.views import table


@query(f"""WITH {STORED} SELECT rule_id, type, severity, confidence FROM sr
WHERE status = 'active' AND type <> 'state' AND confidence >= 0.3 AND severity IN ('high', 'critical') ORDER BY confidence DESC, rule_id""")
def rule_filter(spark, sf_dir):
    """Rules of a status, of some types, from a severity and a confidence on, the most certain first."""
    kept = stored_rules(spark, sf_dir).filter((F.col("status") == "active") & (F.col("type") != "state") & (F.col("confidence") >= 0.3) & (severity_rank("severity") >= SEVERITY["high"]))
    return kept.select("rule_id", "type", "severity", "confidence").orderBy(F.desc("confidence"), "rule_id")


@query(f"WITH {STORED} SELECT rule_id, CASE WHEN k % 4 = 0 THEN 'holds(trace, ''' || substr(trim(description), 1, 120) || ''')' ELSE 'rule_' || k END AS formal_rule FROM sr")
def formal_rule_fallback(spark, sf_dir):
    said = F.concat(F.lit("holds(trace, '"), F.substring(F.trim("description"), 1, 120), F.lit("')"))
    return stored_rules(spark, sf_dir).select("rule_id", F.coalesce(F.expr("nullif(trim(formal_rule), '')"), said).alias("formal_rule"))


@query(f"""WITH {STORED} SELECT 'status' AS field, v.value, count(sr.rule_id) AS n FROM (VALUES ('pending'), ('active'), ('rejected')) v(value) LEFT JOIN sr ON sr.status = v.value AND sr.confidence >= 0.6 GROUP BY v.value
UNION ALL SELECT 'type', type, count(*) FROM sr WHERE confidence >= 0.6 GROUP BY type""")
def rule_counts(spark, sf_dir):
    """Rules of some confidence by status, zeros included, and by type; both from one aggregate."""
    counts = stored_rules(spark, sf_dir).filter("confidence >= 0.6").groupBy("status", "type").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(s, 0) for s in STATUSES], "value string, n long")
    by_status = counts.select(F.col("status").alias("value"), "n").unionByName(every).groupBy("value").agg(F.sum("n").alias("n"))
    by_type = counts.groupBy(F.col("type").alias("value")).agg(F.sum("n").alias("n"))
    return by_status.select(F.lit("status").alias("field"), "value", "n").unionByName(by_type.select(F.lit("type").alias("field"), "value", "n"))


@query(f"WITH {STORED} SELECT rule_id, ok AS valid FROM valid")
def params_validity(spark, sf_dir):
    return stored_rules(spark, sf_dir).select("rule_id", params_valid().alias("valid"))


@query(f"WITH {STORED} SELECT rule_id, type, 'pending' AS status, CAST(row_number() OVER (PARTITION BY type ORDER BY rule_id) AS INTEGER) AS n FROM valid WHERE ok")
def pack_install(spark, sf_dir):
    """Valid rules as pending ones, numbered within their type."""
    kept = stored_rules(spark, sf_dir).filter(params_valid())
    return kept.select("rule_id", "type", F.lit("pending").alias("status"), F.row_number().over(Window.partitionBy("type").orderBy("rule_id")).alias("n"))


_TAG = "'  [' || rpad(upper(severity), 8, ' ') || '] ' || rule_id || ': ' || type || ' rule ' || rule_id || chr(10) || '    ('"
_PCT = "CAST(CAST(round_even({} * 100, 0) AS BIGINT) AS VARCHAR)"


@query(f"""{_COMPARE}, typed AS (SELECT j.*, t.type FROM judged j JOIN (SELECT DISTINCT rule_id, type FROM results) t USING (rule_id)),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE verdict = 'pass') AS p, count(*) FILTER (WHERE verdict = 'warn') AS w, count(*) FILTER (WHERE verdict = 'fail') AS f FROM judged)
SELECT 0 AS section, 0 AS rank, '' AS rule_id, 'Agent: shop | Rules checked: ' || n || chr(10) || 'PASS (' || p || ') | WARN (' || w || ') | FAIL (' || f || ')' AS line FROM n
UNION ALL SELECT CASE verdict WHEN 'fail' THEN 1 ELSE 2 END, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END, rule_id,
  {_TAG} || CASE verdict WHEN 'fail' THEN {_PCT.format('c_pass_rate')} || '% compliance, baseline ' || {_PCT.format('b_pass_rate')} || '%)' ELSE 'warning rate ' || {_PCT.format('b_warn_rate')} || '% -> ' || {_PCT.format('c_warn_rate')} || '%)' END FROM typed WHERE verdict <> 'pass'
UNION ALL SELECT 3, 0, '', 'No regressions detected' FROM n WHERE w = 0 AND f = 0""")
def pr_report_lines(spark, sf_dir):
    """The report of a regression, line by line: counts, failures and warnings by falling severity."""
    return exports.report(regression_compare(spark, sf_dir), rules_table(spark), "shop")


def _code(lines, a, b="''"):
    body = "\n".join(["      - type: javascript", "        value: |", *["          " + x for x in lines]]).replace("'", "''")
    return f"replace(replace('{body}', '{{a}}', {a}), '{{b}}', {b})"


_QUOTED = r"""CASE WHEN regexp_matches({0}, '[:#\n"'']') THEN '"' || replace(replace({0}, '\', '\\'), '"', '\"') || '"' ELSE {0} END"""
_RATE = "printf('%.4f', CASE WHEN p_size = 0 THEN CAST(0.95 AS DOUBLE) ELSE CAST(p_size AS DOUBLE) / 40 END)"
_BLOCKS = f"""{STORED}, blocks AS (
  SELECT rule_id, '  - description: ' || {_QUOTED.format('label')} || chr(10) || '    metadata:' || chr(10) || '      severity: ' || severity || chr(10) || '      type: ' || type ||
    CASE WHEN type = 'conditional' THEN chr(10) || '    vars:' || chr(10) || '      keyword: ' || adj || chr(10) || '      expected_tool: ' || noun ELSE '' END || chr(10) || '    assert:' || chr(10) ||
    CASE type WHEN 'ordering' THEN {_code(exports.ORDER_JS, 'tool_a', 'noun')} WHEN 'conditional' THEN {_code(exports.KEYWORD_JS, 'adj', 'noun')}
      WHEN 'negative' THEN '      - type: not-contains-any' || chr(10) || '        value:' || coalesce(array_to_string(list_transform(patterns, lambda x: chr(10) || '          - ' || x), ''), '')
      WHEN 'statistical' THEN CASE kind WHEN 0 THEN '      - type: latency' || chr(10) || '        threshold: ' || (CASE WHEN p_size = 0 THEN 1000 ELSE p_size * 10 END) ELSE {_code(exports.RATE_JS, 'noun', _RATE)} END
      WHEN 'tool_selection' THEN {_code(exports.USED_JS, 'noun')} ELSE '      - type: llm-rubric' || chr(10) || '        value: ' || {_QUOTED.format('description')} END AS block
  FROM (SELECT *, substr(replace(description, '"', ''''), 1, 160) AS label FROM sr) WHERE NOT (type = 'statistical' AND kind = 2))"""


@query(f"WITH {_BLOCKS} SELECT rule_id, block FROM blocks")
def export_lines(spark, sf_dir):
    """Each stored rule as a block of a test configuration, by the template of its type."""
    return exports.test_blocks(stored_rules(spark, sf_dir))


@query(f"""WITH {_BLOCKS} SELECT 1 AS ord, rule_id, block AS text FROM blocks UNION ALL
SELECT 0, '', 'description: Discovered rules' || chr(10) || 'providers:' || chr(10) || '  - echo' || chr(10) || 'prompts:' || chr(10) || '  - "{{{{user_input}}}}"' || chr(10) || 'tests:'""")
def export_config(spark, sf_dir):
    """The whole configuration in order."""
    return exports.test_config(stored_rules(spark, sf_dir))


@query(f"WITH {STORED} SELECT '# ' || t || ' export' || chr(10) || '# ' || (SELECT count(*) FROM sr WHERE status = 'active') || ' rules to translate' || chr(10) AS text FROM (VALUES ('validators'), ('pytest')) v(t)")
def export_headers(spark, sf_dir):
    """What stands in for two exporters, with the number of active rules."""
    rows = stored_rules(spark, sf_dir).filter("status = 'active'")
    return exports.stub(rows, "validators").unionByName(exports.stub(rows, "pytest"))


@query("""WITH w AS (SELECT string_split(p_name, ' ')[2] AS pattern, lower(p_type) AS category, max(p_size) AS top FROM part WHERE p_size >= 40 GROUP BY ALL)
SELECT pattern, CASE WHEN top >= 48 THEN 'critical' WHEN top >= 45 THEN 'high' ELSE 'medium' END AS severity, category, 'The agent never calls tools named like `' || pattern || '` (' || category || ')' AS description, CAST(1 AS DOUBLE) AS support FROM w""")
def mine_denylist(spark, sf_dir):
    """One rule for each pattern, severity and category of a policy table."""
    part = table(spark, sf_dir, "part").filter("p_size >= 40")
    severity = F.when(F.col("top") >= 48, "critical").when(F.col("top") >= 45, "high").otherwise("medium")
    policy = part.groupBy(F.split("p_name", " ")[1].alias("pattern"), F.lower("p_type").alias("category")).agg(F.max("p_size").alias("top")).select("pattern", severity.alias("severity"), "category")
    return policy.distinct().select("pattern", "severity", "category", F.format_string("The agent never calls tools named like `%s` (%s)", "pattern", "category").alias("description"), F.lit(1.0).alias("support"))


#: Rules that small traces decide: valid, with tools of their own.
_DECIDED = "ok AND type <> 'output_format' AND NOT (type = 'statistical' AND kind = 2) AND NOT listed"


def _decided(spark, sf_dir):
    return stored_rules(spark, sf_dir).filter(params_valid() & (F.col("type") != "output_format") & ~F.coalesce(F.col("params.metric") == "feature_envelope", F.lit(False)) & (F.coalesce(F.size("params.allowed_repertoire"), F.lit(0)) <= 0))


@query(f"""WITH {STORED} SELECT rule_id, true AS violable, CASE type WHEN 'conditional' THEN '' WHEN 'negative' THEN least(adj, noun) WHEN 'state' THEN noun || '>' || adj WHEN 'tool_selection' THEN CASE WHEN k % 16 = 6 THEN adj ELSE '' END ELSE noun END AS counterexample FROM valid WHERE {_DECIDED}""")
def bounded_counterexample(spark, sf_dir):
    """The smallest trace over a rule's tools that violates it; up to two calls decide every template."""
    return V.counterexamples(_decided(spark, sf_dir))


@query(f"WITH {STORED} SELECT rule_id, CASE WHEN type = 'statistical' AND kind = 0 THEN 'warn' WHEN type = 'tool_selection' AND k % 16 <> 6 THEN 'not_applicable' ELSE 'fail' END AS outcome FROM valid WHERE {_DECIDED}")
def synth_violation(spark, sf_dir):
    """Traces made of the counterexamples, checked by the rules that they are to violate."""
    return V.checked_counterexamples(_decided(spark, sf_dir))


_NAMED = "replace(p_name, ' ', '') || chr(CAST(97 + p_size % 26 AS INTEGER))"
_FREE = "list_filter(l.bs, lambda y: NOT list_contains(w.used, y))"


@query(f"""WITH RECURSIVE x AS (SELECT DISTINCT {_NAMED} AS name, p_partkey % 2 AS side FROM part),
old AS (SELECT name FROM x WHERE side = 0 EXCEPT SELECT name FROM x WHERE side = 1), new AS (SELECT name FROM x WHERE side = 1 EXCEPT SELECT name FROM x WHERE side = 0),
near AS MATERIALIZED (SELECT o.name AS a, n.name AS b, levenshtein(o.name, n.name) AS d FROM old o JOIN new n ON levenshtein(o.name, n.name) <= least(2, greatest(1, length(o.name) // 4))),
lists AS MATERIALIZED (SELECT a, list(b ORDER BY d, b) AS bs, row_number() OVER (ORDER BY a) AS i FROM near GROUP BY a),
walk AS (SELECT CAST(0 AS BIGINT) AS i, '' AS a, CAST(NULL AS VARCHAR) AS b, CAST([] AS VARCHAR[]) AS used
  UNION ALL SELECT l.i, l.a, ({_FREE})[1], CASE WHEN len({_FREE}) > 0 THEN list_append(w.used, ({_FREE})[1]) ELSE w.used END FROM walk w JOIN lists l ON l.i = w.i + 1)
SELECT a AS old_name, b AS new_name FROM walk WHERE b IS NOT NULL""")
def version_renames(spark, sf_dir):
    """Removed tools matched one to one with added ones of a close canonical form, in order of names, each with the nearest that is left."""
    from rulequarry.operators.versions import renames

    names = table(spark, sf_dir, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.chr(97 + F.col("p_size") % 26)).alias("name"), (F.col("p_partkey") % 2).alias("side"))
    even, odd = names.filter("side = 0").select("name"), names.filter("side = 1").select("name")
    return renames(even.subtract(odd), odd.subtract(even))


@query("""WITH m AS (SELECT 'part_' || p_partkey AS raw, lower(p_brand) AS canonical FROM part WHERE p_size < 25)
SELECT l_orderkey, string_agg(coalesce(m.canonical, l.tool), '>' ORDER BY l_linenumber, l.tool) AS tools FROM (SELECT l_orderkey, l_linenumber, 'part_' || l_partkey AS tool FROM lineitem) l LEFT JOIN m ON m.raw = l.tool GROUP BY l_orderkey""")
def alias_apply(spark, sf_dir):
    """Tool names replaced by those that an alias table gives for them, the others kept; the order of calls stays."""
    known = table(spark, sf_dir, "part").filter("p_size < 25").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("raw"), F.lower("p_brand").alias("canonical"))
    steps = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("tool"))
    named = aliases.applied(steps.withColumn("raw", F.col("tool")), known)
    calls = F.sort_array(F.collect_list(F.struct("l_linenumber", "raw", "tool")))
    return named.groupBy("l_orderkey").agg(calls.alias("calls")).select("l_orderkey", F.array_join(F.transform("calls", lambda c: c["tool"]), ">").alias("tools"))


assert len(TYPES) == 8  # the statement's rules are dealt to as many types
