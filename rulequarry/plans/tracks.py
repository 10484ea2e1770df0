"""Candidates of two tracks: suggestions without repeats, merging of what agrees, and the whole mine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.operators import candidates
from rulequarry.plans import patterns
from rulequarry.plans.mine import _D, union_of_miners
from rulequarry.plans.registry import ORACLES, query
from rulequarry.plans.scoring import clarity_sql, tfidf_sql
from rulequarry.schema import PARAMS
from rulequarry.sources.rules import STORED, stored_rules
from rulequarry.sources.views import event_steps

_BONUS = f"CASE WHEN track = 'both' THEN {_D.format(0.2)} ELSE {_D.format(0)} END"


def _score(support: str) -> str:
    return f"CAST(round(CAST({_D.format(0.4)} * {support} + {_D.format(0.3)} * consistency + {_BONUS} + {_D.format(0.1)} * {clarity_sql('description')} AS DECIMAL(18, 9)), 4) AS DOUBLE)"


_STORED = f"""WITH {STORED}, cand AS (SELECT *, CAST(p_size % 5 AS DOUBLE) / 5 AS consistency, CASE k % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'statistical' ELSE 'suggested' END AS track FROM valid)"""


def _stored(spark, sf_dir) -> DataFrame:
    """Stored rules as candidates: support, consistency, track and evidence with repeats."""
    k = F.substring("rule_id", 2, 20).cast("long")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("rule_id"), ((F.col("p_size") % 5) / 5.0).alias("consistency"))
    track = F.when(k % 3 == 0, "both").when(k % 3 == 1, "statistical").otherwise("suggested")
    evidence = F.transform(F.sequence(F.lit(0), F.lit(149)), lambda i: F.concat(F.lit("t"), (i % (k % 130 + 1)).cast("string")))
    # a small table of parts makes long lists of evidence: the rows aren't left to the few tasks that read them
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = stored_rules(spark, sf_dir).repartition(n, "rule_id").join(part.repartition(n, "rule_id"), "rule_id")
    return rules.withColumns({"item_id": k, "support": F.col("confidence"), "track": track, "evidence": evidence})


@query(f"""{_STORED}, s AS (SELECT *, {_score('confidence')} AS final FROM cand WHERE ok)
SELECT rule_id, final AS confidence, CASE WHEN final < 0.8 THEN 'pending' ELSE 'active' END AS status, {_BONUS} AS cross_val_bonus, 150 AS evidence_count, CAST(least(100, k % 130 + 1) AS INTEGER) AS n_evidence, trim(description) AS description,
  CASE WHEN k % 4 = 0 THEN 'holds(trace, ''' || substr(trim(description), 1, 120) || ''')' ELSE 'rule_' || k END AS formal_rule FROM s WHERE final >= 0.6""")
def formalize(spark, sf_dir):
    """Valid candidates that aren't rejected, scored, with formal rules and evidence without repeats."""
    found = candidates.formalised(_stored(spark, sf_dir))
    return found.select("rule_id", "confidence", "status", "cross_val_bonus", "evidence_count", F.size("evidence").alias("n_evidence"), "description", "formal_rule")


@query(f"""{_STORED}, g AS (SELECT type, trim(regexp_replace(regexp_replace(lower(description), '[^a-z0-9_ ]', '', 'g'), ' +', ' ', 'g')) AS key, list(confidence ORDER BY k) AS s, list(consistency ORDER BY k) AS c, arg_min(description, k) AS description, max(k % 130 + 1) AS most, count(*) AS n FROM cand GROUP BY 1, 2)
SELECT type, key, description, list_reduce(s, lambda a, x: CAST(round(CAST((a + x) / 2 AS DECIMAL(18, 9)), 4) AS DOUBLE)) AS support, list_reduce(c, lambda a, x: CAST(round(CAST((a + x) / 2 AS DECIMAL(18, 9)), 4) AS DOUBLE)) AS consistency, CAST(least(50, most) AS INTEGER) AS n_evidence, n FROM g""")
def llm_dedup_average(spark, sf_dir):
    """Suggestions of one type and normalised description as one, their support averaged in turn."""
    found = candidates.deduplicated(_stored(spark, sf_dir).drop("params"))
    return found.select("type", "key", "description", "support", "consistency", F.size("evidence").alias("n_evidence"), "n")


_NO = "CAST(NULL AS VARCHAR)"
_KEYS = ("tool_a", "tool_b", "tool", "keyword", "metric", "feature")


def _keys(**given) -> str:
    return ", ".join(f"{given.get(k, _NO)} AS {k}" for k in _KEYS)


_CAND = f"""WITH RECURSIVE found AS (
  SELECT 'ordering' AS type, 'The agent always calls `' || tool_a || '` before calling `' || tool_b || '`' AS description, round(support, 4) AS support, round(consistency, 4) AS consistency, severity, {_keys(tool_a='tool_a', tool_b='tool_b')} FROM ({ORACLES['mine_ordering']}) WHERE kept
  UNION ALL SELECT 'ordering', description, support, support, 'medium', {_keys(tool_a="regexp_extract(pattern, '^[^>]*')", tool_b="regexp_extract(pattern, '[^>]*$')")} FROM ({patterns.ALL_CHAINS})
  UNION ALL SELECT 'statistical', 'Latency of `' || tool || '` stays under ' || CAST(threshold AS VARCHAR) || ' ms', {_D.format(1)}, round(within_rate, 4), 'low', {_keys(tool='tool', metric="'latency_ms'")} FROM ({ORACLES['latency_p99']})
  UNION ALL SELECT 'statistical', '`' || tool || '` succeeds in 95% of its calls or more', {_D.format(1)}, round(rate, 4), 'medium', {_keys(tool='tool', metric="'success_rate'")} FROM ({ORACLES['success_rate']}) WHERE kept
  UNION ALL SELECT 'statistical', 'The feature `' || feature || '` stays within its usual range', {_D.format(1)}, round(within_rate, 4), 'low', {_keys(metric="'feature_envelope'", feature='feature')} FROM ({ORACLES['feature_envelope']})
  UNION ALL SELECT 'negative', 'The agent calls only these tools: `' || string_agg(tool, ', ' ORDER BY tool) || '`', {_D.format(1)}, {_D.format(1)}, 'high', {_keys()} FROM ({ORACLES['mine_repertoire']}) WHERE allowed HAVING count(*) > 0
  UNION ALL SELECT 'conditional', 'The agent calls `' || tool || '` when the input mentions `' || keyword || '`', round(lift, 4), round(lift, 4), 'medium', {_keys(tool='tool', keyword='keyword')} FROM ({ORACLES['mine_conditional']})),
said AS (SELECT DISTINCT event_type AS tool FROM events),
guess AS (
  SELECT 'negative' AS type, 'The agent calls only these tools, in all visits: `' || (SELECT string_agg(tool, ', ' ORDER BY tool) FROM said) || '`' AS description, {_D.format(0.9)} AS support, {_D.format(0.9)} AS consistency, 'critical' AS severity, {_keys()}
  UNION ALL SELECT 'state', 'Once `' || tool || '` was called, the visit is over and nothing is paid for', {_D.format(0.8)}, {_D.format(0.9)}, 'high', {_keys()} FROM said
  UNION ALL SELECT 'ordering', 'A visit looks at things with `' || x.tool || '` some time before `' || y.tool || '` is reached', {_D.format(0.9)}, {_D.format(0.9)}, 'medium', {_keys(tool_a='x.tool', tool_b='y.tool')} FROM said x JOIN said y ON x.tool < y.tool),
c AS (SELECT '0|' || type || '|' || description AS item_id, *, 'statistical' AS track FROM found UNION ALL SELECT '1|' || type || '|' || description, *, 'suggested' FROM guess)"""
_BASE = "(-length(description), item_id)"
_MERGED = f"""{tfidf_sql(_CAND)}, sim AS (SELECT a.item_id AS a, b.item_id AS b, round(sum(a.w * b.w), 6) AS cosine FROM v a JOIN v b ON a.type = b.type AND a.term = b.term AND a.item_id < b.item_id GROUP BY ALL),
e AS (SELECT a, b FROM sim WHERE cosine >= 0.7 UNION SELECT b, a FROM sim WHERE cosine >= 0.7), reach AS (SELECT item_id AS x, item_id AS y FROM c UNION SELECT x, e.b FROM reach JOIN e ON e.a = reach.y), cl AS (SELECT x AS item_id, min(y) AS cluster FROM reach GROUP BY x),
odd AS (SELECT cluster FROM cl JOIN c USING (item_id) GROUP BY cluster HAVING {' OR '.join(f'count(DISTINCT {k}) > 1' for k in _KEYS)}),
ag AS (SELECT item_id, CASE WHEN cluster IN (SELECT cluster FROM odd) THEN item_id ELSE cluster END AS cluster FROM cl),
m AS (SELECT cluster, arg_min(type, {_BASE}) AS type, arg_min(description, {_BASE}) AS description, arg_min(severity, {_BASE}) AS severity, max(support) AS support, max(consistency) AS consistency, count(*) AS n,
  CASE WHEN count(DISTINCT track) > 1 THEN 'both' ELSE min(track) END AS track FROM ag JOIN c USING (item_id) GROUP BY cluster),
s AS (SELECT *, {_score('support')} AS confidence FROM m WHERE type <> 'state')"""


@query(f"{_MERGED} SELECT type, description, severity, support, consistency, n, track, {_BONUS} AS cross_val_bonus, confidence, CASE WHEN confidence < 0.8 THEN 'pending' ELSE 'active' END AS status FROM s WHERE confidence >= 0.6")
def mine_two_tracks(spark, sf_dir):
    """The whole mine: the miners' candidates and suggestions (here made of the tools in the events, some incomplete), merged, validated, scored and sorted out."""
    tools = event_steps(spark, sf_dir).select("tool").distinct()
    fields = [x.split(": ") for x in PARAMS[len("struct<") : -1].split(", ")]

    def guess(rows, kind, text, support, severity, **params):
        made = F.struct(*[params.get(name, F.lit(None)).cast(t).alias(name) for name, t in fields])
        return rows.select(F.lit(kind).alias("type"), text.alias("description"), F.lit(support).alias("support"), F.lit(0.9).alias("consistency"), F.lit(severity).alias("severity"), made.alias("params"), F.array(F.lit("seen")).alias("evidence"))

    every = tools.agg(F.sort_array(F.collect_list("tool")).alias("tools"))  # a handful of names
    pairs = tools.select(F.col("tool").alias("a")).join(tools.select(F.col("tool").alias("b")), F.col("a") < F.col("b"))
    suggested = [
        guess(every, "negative", F.concat(F.lit("The agent calls only these tools, in all visits: `"), F.array_join("tools", ", "), F.lit("`")), 0.9, "critical", allowed_repertoire=F.col("tools")),
        guess(tools, "state", F.concat(F.lit("Once `"), "tool", F.lit("` was called, the visit is over and nothing is paid for")), 0.8, "high", terminator_tool=F.col("tool")),
        guess(pairs, "ordering", F.format_string("A visit looks at things with `%s` some time before `%s` is reached", "a", "b"), 0.9, "medium", tool_a=F.col("a"), tool_b=F.col("b")),
    ]
    found = candidates.two_tracks(union_of_miners(spark, sf_dir, patterns.all_chains), reduce(DataFrame.unionByName, suggested))
    return found.select("type", "description", "severity", "support", "consistency", "n", "track", "cross_val_bonus", "confidence", "status")
