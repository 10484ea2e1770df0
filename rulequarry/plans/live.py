"""Batch forms of what the streams do: callbacks paired to runs, drift detectors with resets and expiry."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulequarry.operators import callbacks, drift
from rulequarry.plans.registry import query
from rulequarry.sources.views import table

_TIMEOUT = 5 * 86_400
_KIND = "CASE WHEN event_id % 3 = 0 THEN 'start' WHEN event_id % 7 = 1 THEN 'error' ELSE 'end' END"
_RUNS = f"""WITH cb AS (SELECT user_id, event_type AS tool, ts, event_id, {_KIND} AS kind FROM events),
r AS (SELECT *, count(*) FILTER (WHERE kind = 'start') OVER (PARTITION BY user_id, tool ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM cb),
n AS (SELECT *, lead(kind) OVER w AS next_kind, lead(ts) OVER w AS next_ts FROM r WINDOW w AS (PARTITION BY user_id, tool ORDER BY ts, event_id)),
p AS (SELECT user_id, run, tool, ts AS started_at, CASE WHEN next_kind <> 'start' AND next_ts <= ts + INTERVAL {_TIMEOUT} SECONDS THEN next_kind END AS closed, next_ts FROM n WHERE kind = 'start'),
paired AS (SELECT user_id, CAST(user_id AS VARCHAR) || ':' || tool || ':' || run AS run_id, tool, started_at, CASE WHEN closed IS NOT NULL THEN CAST((epoch_us(next_ts) - epoch_us(started_at)) // 1000 AS INTEGER) END AS latency_ms,
  CASE closed WHEN 'end' THEN 'success' WHEN 'error' THEN 'error' ELSE 'timeout' END AS result_status FROM p)"""


def _callbacks(spark, sf_dir):
    """Events as callbacks that carry no run id: starts, ends and errors of a user's tool."""
    kind = F.when(F.col("event_id") % 3 == 0, "start").when(F.col("event_id") % 7 == 1, "error").otherwise("end")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("tool"), F.col("ts").cast("timestamp").alias("at"), "event_id", kind.alias("kind"))
    return callbacks.numbered(rows, ["user_id", "tool"], ["at", "event_id"])


@query(f"{_RUNS} SELECT run_id, tool, started_at, latency_ms, result_status FROM paired")
def event_pairing(spark, sf_dir):
    """Start and end rows of different events, paired per user and tool; what nothing closes in time is a timeout."""
    found = callbacks.paired(_callbacks(spark, sf_dir), _TIMEOUT)
    return found.withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


@query(f"{_RUNS} SELECT CAST(user_id AS VARCHAR) AS trace_id, count(*) AS n_steps, string_agg(tool || '=' || result_status, '>' ORDER BY started_at, run_id) AS steps, coalesce(sum(latency_ms), 0) AS latency_ms FROM paired GROUP BY user_id")
def callback_traces(spark, sf_dir):
    """Paired callbacks as traces of a user."""
    found = callbacks.traces(callbacks.paired(_callbacks(spark, sf_dir), _TIMEOUT), F.split("run_id", ":")[0])
    total = F.aggregate("steps", F.lit(0).cast("long"), lambda a, s: a + F.coalesce(s["latency_ms"], F.lit(0)))
    return found.select("trace_id", F.size("steps").cast("long").alias("n_steps"), F.array_join(F.transform("steps", lambda s: F.concat(s["tool"], F.lit("="), s["result_status"])), ">").alias("steps"), total.alias("latency_ms"))


_IDLE = 4 * 86_400
_X = "CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 95 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END"


@query(f"""WITH RECURSIVE o AS (SELECT CAST(user_id AS VARCHAR) AS agent, row_number() OVER w AS i, event_type = 'signup' AS control, {_X} AS x, ts - lag(ts) OVER w > INTERVAL {_IDLE} SECONDS AS idle FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT agent, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS s, CAST(0 AS DOUBLE) AS low, CAST(0 AS BIGINT) AS resets, CAST(0 AS BIGINT) AS expiries FROM o WHERE i = 1
  UNION ALL SELECT agent, i, n, mean, s, CASE WHEN n = 0 THEN CAST(0 AS DOUBLE) ELSE least(low, s) END, resets, expiries FROM (
    SELECT agent, i, CASE WHEN control THEN 0 ELSE was + 1 END AS n, CASE WHEN control THEN CAST(0 AS DOUBLE) ELSE m END AS mean, CASE WHEN control THEN CAST(0 AS DOUBLE) ELSE sum + (m - x) - CAST(0.005 AS DOUBLE) END AS s, l AS low, resets + CASE WHEN control THEN 1 ELSE 0 END AS resets, expiries FROM (
      SELECT *, CASE WHEN was = 0 THEN x ELSE mean + CAST(0.05 AS DOUBLE) * (x - mean) END AS m FROM (
        SELECT o.agent, o.i, o.control, o.x, s.resets, s.expiries + CASE WHEN o.idle AND s.n > 0 THEN 1 ELSE 0 END AS expiries, CASE WHEN o.idle THEN 0 ELSE s.n END AS was, CASE WHEN o.idle THEN CAST(0 AS DOUBLE) ELSE s.mean END AS mean,
          CASE WHEN o.idle THEN CAST(0 AS DOUBLE) ELSE s.s END AS sum, CASE WHEN o.idle THEN CAST(0 AS DOUBLE) ELSE s.low END AS l FROM s JOIN o ON o.agent = s.agent AND o.i = s.i + 1))))
SELECT agent, n, round(mean, 6) AS mean, round(s - low, 6) AS excursion, resets, expiries FROM s QUALIFY row_number() OVER (PARTITION BY agent ORDER BY i DESC) = 1""")
def drift_stats(spark, sf_dir):
    """The detectors' state of every agent at the end: observations since the last reset or expiry, their mean and the excursion; signups reset an agent."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("agent"), F.lit("success").alias("rule"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("ord"),
        F.when(F.get_json_object("props", "$.k").cast("int") >= 95, 0.0).otherwise(1.0).alias("x"), F.when(F.col("event_type") == "signup", "reset").alias("control"),
    )
    return drift.stats(rows, _IDLE).select("agent", "n", F.round("mean", 6).alias("mean"), F.round("excursion", 6).alias("excursion"), "resets", "expiries")
