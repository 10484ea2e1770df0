"""Queued traces after all decisions on them, and outputs by a judge."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulequarry.operators import review
from rulequarry.plans.registry import query
from rulequarry.sources.views import spread, table


@query("""WITH d AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' WHEN 'N' THEN 'edited' END AS decision, l_suppkey AS reviewer,
  CASE WHEN l_quantity > 25 THEN 'part ' || l_partkey END AS replacement, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem),
g AS (SELECT id, arg_max(decision, k) AS decision, arg_max(reviewer, k) AS reviewer, arg_max(replacement, k) FILTER (WHERE decision = 'edited' AND replacement IS NOT NULL) AS replacement, count(*) AS n FROM d WHERE decision IS NOT NULL GROUP BY id)
SELECT o_orderkey AS item_id, coalesce(decision, 'pending') AS decision, CAST(reviewer AS VARCHAR) AS decided_by, coalesce(replacement, 'order ' || o_orderkey) AS trace, coalesce(n, 0) AS n_decisions FROM orders LEFT JOIN g ON id = o_orderkey""")
def queue_edited_traces(spark, sf_dir):
    """Orders as queued traces, their lines as decisions in order of shipping, of which edits bring other traces."""
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("trace"))
    lines = table(spark, sf_dir, "lineitem")
    decisions = lines.select(
        F.col("l_orderkey").alias("item_id"), F.expr("CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' WHEN 'N' THEN 'edited' END").alias("decision"), F.col("l_suppkey").cast("string").alias("decided_by"),
        F.col("l_shipdate").alias("decided_at"), F.lit(None).cast("string").alias("edit_notes"), F.when(F.col("l_quantity") > 25, F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("replacement"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
    )
    found = review.decide(items, decisions, ["decided_at", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    return found.select("item_id", "decision", "decided_by", "trace", "n_decisions")


def _ask(prompts):
    """A judge that needs no service: short responses fail, and it has no view on Asia."""
    import json

    for p in map(json.loads, prompts):
        if "ASIA" in p["rule"]:
            yield "I can't say."
        else:
            yield "So: " + json.dumps({"verdict": "Fail" if len(p["agent_response"]) < 500 else "PASS", "reason": f"{len(p['agent_response'])} characters"})


@query("""WITH r AS (SELECT doc_id, r_name, length(substr(text, 1, 2000)) AS n FROM documents, region WHERE text IS NOT NULL)
SELECT CAST(doc_id AS VARCHAR) AS trace_id, r_name AS rule_id, CASE WHEN contains(r_name, 'ASIA') THEN 'not_applicable' WHEN n < 500 THEN 'fail' ELSE 'pass' END AS outcome,
  CASE WHEN n < 500 AND NOT contains(r_name, 'ASIA') THEN 'Suits ' || r_name END AS expected, CASE WHEN n < 500 AND NOT contains(r_name, 'ASIA') THEN n || ' characters' END AS observed FROM r""")
def judged_output_format(spark, sf_dir):
    """A rule of each region on documents as responses, by a judge in Python."""
    step = F.struct(F.lit("agent_response").alias("type"), F.col("text").alias("content"))
    traces = spread(table(spark, sf_dir, "documents")).filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("trace_id"), F.array(step).alias("steps"))
    rules = table(spark, sf_dir, "region").select(F.col("r_name").alias("rule_id"), F.lit("output_format").alias("type"), F.lit("high").alias("severity"), F.concat(F.lit("Suits "), "r_name").alias("description"))
    return review.judged(traces, rules, _ask).drop("severity")
