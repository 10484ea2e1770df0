"""Features and filters of traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rulequarry.functions import text as T
from rulequarry.operators import features
from rulequarry.plans.registry import query
from rulequarry.sources.views import EVENTS, event_steps, event_traces, table

SHAPED = f"""WITH {EVENTS}, shaped AS (
  SELECT *, 'user|' || array_to_string(list_transform(tools, lambda t: 'tool:' || t), '|') AS shape FROM tr),
fp AS (SELECT *, substr(sha256(shape), 1, 16) AS fingerprint FROM shaped)"""


def shaped(spark, sf_dir):
    return event_traces(spark, sf_dir).withColumn("shape", features.shape()).withColumn("fingerprint", features.fingerprint())


@query(f"WITH {EVENTS} SELECT trace_id, array_to_string(tools, '>') AS tools FROM tr")
def tool_sequence(spark, sf_dir):
    return event_traces(spark, sf_dir).select("trace_id", F.array_join(features.tool_sequence(), ">").alias("tools"))


@query(f"WITH {EVENTS} SELECT trace_id, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools FROM st GROUP BY trace_id")
def tool_set(spark, sf_dir):
    return event_traces(spark, sf_dir).select("trace_id", F.array_join(F.sort_array(F.array_distinct(features.tool_sequence())), ",").alias("tools"))


@query(f"WITH {EVENTS} SELECT string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools FROM st")
def tool_inventory(spark, sf_dir):
    return event_steps(spark, sf_dir).agg(F.array_join(F.sort_array(F.collect_set("tool")), ",").alias("tools"))


@query(f"""WITH {EVENTS} SELECT trace_id, count(*) + 1 AS step_count, count(*) AS tool_count, count(DISTINCT tool) AS distinct_tools, CAST(18 AS BIGINT) AS user_chars, CAST(0 AS BIGINT) AS response_chars,
  CAST(sum(latency_ms) AS BIGINT) AS sum_latency, CAST(max(latency_ms) AS BIGINT) AS max_latency, count(*) FILTER (WHERE status <> 'success') AS error_count FROM st GROUP BY trace_id""")
def behavioral_features(spark, sf_dir):
    return features.behavioral(event_traces(spark, sf_dir))


@query(f"{SHAPED} SELECT trace_id, shape FROM fp")
def canonical_shape(spark, sf_dir):
    return shaped(spark, sf_dir).select("trace_id", "shape")


@query(f"{SHAPED} SELECT trace_id, fingerprint FROM fp")
def fingerprint(spark, sf_dir):
    return shaped(spark, sf_dir).select("trace_id", "fingerprint")


@query("SELECT token, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_]{2,}'))) AS token FROM documents) GROUP BY token")
def user_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.explode(features.user_tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT trace_id, started_at FROM tr WHERE version = 'v2' AND segment = 'EU' ORDER BY started_at DESC, trace_id LIMIT 100")
def trace_scan_recent(spark, sf_dir):
    first = event_steps(spark, sf_dir).filter("version = 'v2' AND segment = 'EU'").groupBy("trace_id").agg(F.min("ts").alias("started_at"))
    return first.orderBy(F.desc("started_at"), "trace_id").limit(100)


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'dag' WHEN 1 THEN 'langchain' ELSE 'raw_json' END AS format FROM events""")
def format_detect(spark, sf_dir):
    """The format of a JSON payload, from the keys it has."""
    from rulequarry.sources.normalize import detect_format

    payload = F.expr("""CASE event_id % 4 WHEN 0 THEN concat('{"nodes": [{"id": ', event_id, '}], "edges": []}') WHEN 1 THEN '{"run_type": "chain", "child_runs": []}'
        WHEN 2 THEN '{"steps": []}' ELSE props END""")
    return table(spark, sf_dir, "events").select("event_id", detect_format(payload).alias("format"))


@query("""WITH old AS (SELECT p_partkey AS id, p_name AS description, CAST(p_size AS DOUBLE) AS confidence FROM part WHERE p_partkey % 3 <> 0),
new AS (SELECT p_partkey AS id, p_name || ' v2' AS description, CAST(p_size AS DOUBLE) + 1 AS confidence FROM part WHERE p_partkey % 2 = 0)
SELECT id, coalesce(new.description, old.description) AS description, coalesce(new.confidence, old.confidence) AS confidence,
  CASE WHEN old.description IS NULL THEN 'insert' WHEN new.description IS NULL THEN 'keep' ELSE 'update' END AS action FROM old FULL JOIN new USING (id)""")
def rule_upsert(spark, sf_dir):
    """Merge of new rules into a store: matched rows updated, others inserted or kept."""
    from rulequarry.sources.store import upsert

    part = table(spark, sf_dir, "part")
    old = part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("description"), F.col("p_size").cast("double").alias("confidence"))
    new = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" v2")).alias("description"), (F.col("p_size") + 1).cast("double").alias("confidence"))
    return upsert(old, new, ["id"])


@query("""SELECT s_suppkey AS k, s_name AS name FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT s_suppkey, 'decided ' || s_name FROM supplier WHERE s_nationkey = 3""")
def alias_table_replace(spark, sf_dir):
    from rulequarry.sources.store import replace_where

    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), "s_nationkey")
    new = old.filter("s_nationkey = 3").withColumn("name", F.concat(F.lit("decided "), "name"))
    return replace_where(old, new, F.col("s_nationkey") == 3).select("k", "name")


@query(f"WITH {EVENTS} SELECT trace_id, version, segment, len(tools) AS turns, CASE WHEN list_contains(statuses, 'error') THEN 'error' ELSE 'success' END AS status FROM tr")
def trace_status(spark, sf_dir):
    return event_traces(spark, sf_dir).select(
        "trace_id", "version", "segment", (F.size("steps") - 1).cast("long").alias("turns"), F.expr("IF(exists(steps, s -> coalesce(s.result_status, '') = 'error'), 'error', 'success')").alias("status")
    )


@query(f"WITH {EVENTS} SELECT status, version, count(*) AS n FROM st GROUP BY ALL")
def status_counts(spark, sf_dir):
    return event_steps(spark, sf_dir).groupBy("status", "version").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT session_id, trace_id, row_number() OVER (PARTITION BY session_id ORDER BY started_at, trace_id) AS turn FROM tr")
def session_turns(spark, sf_dir):
    first = event_steps(spark, sf_dir).groupBy("session_id", "trace_id").agg(F.min("ts").alias("started_at"))
    return first.select("session_id", "trace_id", F.row_number().over(Window.partitionBy("session_id").orderBy("started_at", "trace_id")).cast("long").alias("turn"))
