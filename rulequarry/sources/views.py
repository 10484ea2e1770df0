"""Trace-shaped views of plain tables, and the same views as DuckDB text for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION_CUT = "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where a scan has fewer splits than there are; larger inputs, which have more, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event: a tool call of the trace (user, day). No shuffle."""
    return table(spark, sf_dir, "events").select(
        F.concat_ws("_", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("trace_id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.when(F.col("ts") < F.lit(VERSION_CUT).cast("timestamp_ntz"), "v1").otherwise("v2").alias("version"),
        F.expr("CASE user_id % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'EU' ELSE 'JP' END").alias("segment"),
        "ts",
        "event_id",
        F.col("event_type").alias("tool"),
        F.floor(F.col("value") * 10).cast("int").alias("latency_ms"),
        F.when(F.get_json_object("props", "$.k").cast("int") >= 95, "error").otherwise("success").alias("status"),
    )


def traces(steps: DataFrame) -> DataFrame:
    """Tool calls -> nested traces in time order, with the user's request in front; one shuffle, on the trace."""
    call = F.struct("ts", "event_id", "tool", "latency_ms", "status")
    grouped = steps.groupBy("trace_id", "session_id", "version", "segment").agg(F.sort_array(F.collect_list(call)).alias("calls"))
    return grouped.select(
        "trace_id",
        "session_id",
        "version",
        "segment",
        F.col("calls")[0]["ts"].alias("started_at"),
        F.expr("""concat(
            array(named_struct('type', 'user_input', 'content', concat('Visit from ', segment, ' shop'), 'tool', CAST(NULL AS string), 'latency_ms', CAST(NULL AS int), 'result_status', CAST(NULL AS string))),
            transform(calls, c -> named_struct('type', 'tool_call', 'content', CAST(NULL AS string), 'tool', c.tool, 'latency_ms', c.latency_ms, 'result_status', c.status)))""").alias("steps"),
    )


def event_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(event_steps(spark, sf_dir))


#: Tool calls with their number in the trace (ti, from 0).
EVENTS = f"""
ev AS (
  SELECT CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y-%m-%d') AS trace_id, CAST(user_id AS VARCHAR) AS session_id,
         CASE WHEN ts < TIMESTAMP '{VERSION_CUT}' THEN 'v1' ELSE 'v2' END AS version,
         CASE user_id % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'EU' ELSE 'JP' END AS segment, ts, event_id, event_type AS tool,
         CAST(floor(value * 10) AS INTEGER) AS latency_ms,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 95 THEN 'error' ELSE 'success' END AS status
  FROM events),
st AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, event_id) - 1 AS ti FROM ev),
tr AS MATERIALIZED (SELECT trace_id, any_value(session_id) AS session_id, any_value(version) AS version, any_value(segment) AS segment, min(ts) AS started_at,
              list(tool ORDER BY ti) AS tools, list(status ORDER BY ti) AS statuses, list(latency_ms ORDER BY ti) AS latencies
       FROM st GROUP BY trace_id)
"""


def document_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as traces: the text is the request, the language and the source are tools."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("string").alias("trace_id"),
        F.col("source").alias("session_id"),
        F.lit("v1").alias("version"),
        F.col("source").alias("segment"),
        F.lit(None).cast("timestamp_ntz").alias("started_at"),
        F.expr("""array(
            named_struct('type', 'user_input', 'content', text, 'tool', CAST(NULL AS string), 'latency_ms', CAST(NULL AS int), 'result_status', CAST(NULL AS string)),
            named_struct('type', 'tool_call', 'content', CAST(NULL AS string), 'tool', concat('lang_', lang), 'latency_ms', CAST(n_chars AS int), 'result_status', CAST(NULL AS string)),
            named_struct('type', 'tool_call', 'content', CAST(NULL AS string), 'tool', source, 'latency_ms', CAST(NULL AS int), 'result_status', 'success'))""").alias("steps"),
    )
