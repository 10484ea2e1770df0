"""Reports, exports, metrics, alerts and review queues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rulequarry.functions import text as T
from rulequarry.plans.checking import RULES, _COMPARE, regression_compare, rules_table
from rulequarry.plans.registry import query
from rulequarry.sources.views import EVENTS, event_steps, event_traces, table


_BOUNDS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 60000)


@query(f"WITH {EVENTS} SELECT tool, le, count(*) FILTER (WHERE latency_ms <= le) AS n FROM st, (SELECT unnest([{', '.join(map(str, _BOUNDS))}]) AS le) GROUP BY ALL")
def latency_histogram(spark, sf_dir):
    """Cumulative buckets: one count for each bucket on the map side, summed up by a window over few rows."""
    steps = event_steps(spark, sf_dir).select("tool", "latency_ms")
    sums = steps.groupBy("tool").agg(*[F.sum(F.when(F.col("latency_ms") <= b, 1).otherwise(0)).cast("long").alias(str(b)) for b in _BOUNDS])
    return sums.select("tool", F.expr(f"stack({len(_BOUNDS)}, {', '.join(f'{b}, `{b}`' for b in _BOUNDS)}) AS (le, n)"))


@query(f"WITH {EVENTS}, s AS (SELECT tool, list(latency_ms ORDER BY latency_ms) AS l, count(*) AS n FROM st GROUP BY tool) SELECT tool, " + ", ".join(f"l[least(n - 1, CAST(floor(n * CAST({q} AS DOUBLE)) AS BIGINT)) + 1] AS {a}" for q, a in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))) + " FROM s")
def latency_ring_stats(spark, sf_dir):
    """Order statistics by rank, from counts of equal latencies."""
    h = event_steps(spark, sf_dir).groupBy("tool", "latency_ms").agg(F.count("*").alias("c"))
    w = Window.partitionBy("tool")
    h = h.withColumns({"cum": F.sum("c").over(w.orderBy("latency_ms")), "n": F.sum("c").over(w)})
    at = lambda q: F.min(F.when(F.col("cum") > F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q))), F.col("latency_ms")))
    return h.groupBy("tool").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@query(f"""WITH {EVENTS} SELECT 'tool_calls_total{{tool="' || tool || '",status="' || status || '"}} ' || CAST(count(*) AS VARCHAR) AS line FROM st GROUP BY tool, status
UNION ALL SELECT 'tool_latency_bucket{{tool="' || tool || '",le="' || CAST(le AS VARCHAR) || '"}} ' || CAST(count(*) FILTER (WHERE latency_ms <= le) AS VARCHAR) FROM st, (SELECT unnest([{', '.join(map(str, _BOUNDS))}]) AS le) GROUP BY tool, le
UNION ALL SELECT 'tool_latency_bucket{{tool="' || tool || '",le="+Inf"}} ' || CAST(count(*) AS VARCHAR) FROM st GROUP BY tool""")
def metrics_exposition(spark, sf_dir):
    calls = event_steps(spark, sf_dir).groupBy("tool", "status").agg(F.count("*").alias("n"))
    lines = calls.select(F.format_string('tool_calls_total{tool="%s",status="%s"} %d', "tool", "status", "n").alias("line"))
    buckets = latency_histogram(spark, sf_dir).select(F.format_string('tool_latency_bucket{tool="%s",le="%d"} %d', "tool", "le", "n").alias("line"))
    inf = calls.groupBy("tool").agg(F.sum("n").alias("n")).select(F.format_string('tool_latency_bucket{tool="%s",le="+Inf"} %d', "tool", "n").alias("line"))
    return lines.unionByName(buckets).unionByName(inf)


@query(f"""WITH {EVENTS} SELECT event_id, '{{"agent":"' || session_id || '","tool":"' || tool || '","latency_ms":' || CAST(latency_ms AS VARCHAR) || '}}' AS payload FROM st WHERE status = 'error'""")
def alert_payloads(spark, sf_dir):
    bad = event_steps(spark, sf_dir).filter("status = 'error'")
    return bad.select("event_id", F.to_json(F.struct(F.col("session_id").alias("agent"), "tool", "latency_ms")).alias("payload"))


@query(f"WITH {EVENTS} SELECT session_id || ':' || tool AS dedup_key, min(event_id) AS first_event FROM st WHERE status = 'error' GROUP BY 1")
def alert_dedup(spark, sf_dir):
    return event_steps(spark, sf_dir).filter("status = 'error'").groupBy(F.concat("session_id", F.lit(":"), "tool").alias("dedup_key")).agg(F.min("event_id").alias("first_event"))


@query(f"WITH {EVENTS} SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY session_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS k FROM st) WHERE k <= 1")
def alert_rate_limit(spark, sf_dir):
    """At most one alert of an agent an hour, the first."""
    w = Window.partitionBy("session_id", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return event_steps(spark, sf_dir).withColumn("k", F.row_number().over(w)).filter("k <= 1").select("event_id")


@query()
def alert_sliding_limit(spark, sf_dir):
    """Alerts of failed calls, at most two of a session in any six hours."""
    from rulequarry.operators import alerts

    bad = event_steps(spark, sf_dir).filter("status = 'error'").select(F.col("session_id").alias("agent"), F.col("ts").alias("at"), "event_id")
    return alerts.limited(bad, most=2, seconds=6 * 3600).select("event_id", "agent")


def _jitter(k: int, base: int) -> str:
    return f"CAST(floor((('0x' || substr(sha1(CAST(event_id AS VARCHAR) || ':{k}'), 1, 8))::BIGINT / CAST(4294967295 AS DOUBLE)) * {base}) AS BIGINT)"


@query(f"""WITH {EVENTS}, b AS (SELECT event_id, session_id AS agent, epoch_us(ts) // 1000 AS raised, {_jitter(1, 250)} AS j1, {_jitter(2, 500)} AS j2, CASE (event_id + latency_ms) % 4 WHEN 3 THEN 1 WHEN 2 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS ok FROM st WHERE status = 'error')
SELECT event_id, agent, CAST(CASE ok WHEN 0 THEN 3 ELSE ok END AS INTEGER) AS attempts, ok > 0 AS delivered, raised + CASE ok WHEN 1 THEN 0 WHEN 2 THEN 250 + j1 ELSE 750 + j1 + j2 END AS done_ms FROM b""")
def alert_deliveries(spark, sf_dir):
    """Alerts of failed calls to a sink that takes some at the first try, some later and some never."""
    from rulequarry.operators import alerts

    bad = event_steps(spark, sf_dir).filter("status = 'error'").select("event_id", F.col("session_id").alias("agent"), F.col("ts").cast("timestamp").alias("at"), "latency_ms")
    done = alerts.deliveries(bad, lambda k: (F.col("event_id") + F.col("latency_ms") + k) % 4 == 0)
    return done.select("event_id", "agent", "attempts", "delivered", F.unix_millis("done_at").alias("done_ms"))


@query(f"""WITH {EVENTS}, b AS (SELECT event_id, latency_ms, tool, CASE WHEN latency_ms >= 900 THEN 'critical' ELSE 'high' END AS severity FROM st WHERE status = 'error')
SELECT event_id, '{{"text":"[' || severity || '] ' || tool || ' failed"}}' AS slack, '{{"event_action":"trigger","payload":{{"summary":"' || tool || ' failed","severity":"' || CASE severity WHEN 'critical' THEN 'critical' ELSE 'error' END || '","source":"checks"}}}}' AS pager,
  severity = 'critical' AS pages FROM b""")
def alert_sinks(spark, sf_dir):
    """What each kind of sink is sent, and whether the alert is severe enough to page someone."""
    bad = event_steps(spark, sf_dir).filter("status = 'error'").withColumn("severity", F.when(F.col("latency_ms") >= 900, "critical").otherwise("high"))
    slack = F.to_json(F.struct(F.format_string("[%s] %s failed", "severity", "tool").alias("text")))
    level = F.when(F.col("severity") == "critical", "critical").otherwise("error")
    pager = F.to_json(F.struct(F.lit("trigger").alias("event_action"), F.struct(F.concat("tool", F.lit(" failed")).alias("summary"), level.alias("severity"), F.lit("checks").alias("source")).alias("payload")))
    return bad.select("event_id", slack.alias("slack"), pager.alias("pager"), (F.col("severity") == "critical").alias("pages"))


@query(f"WITH {EVENTS} SELECT trace_id, CASE WHEN date_diff('day', CAST(started_at AS DATE), DATE '2024-04-15') > 90 THEN 'drop' WHEN date_diff('day', CAST(started_at AS DATE), DATE '2024-04-15') > 30 THEN 'cold' ELSE 'hot' END AS tier FROM tr")
def retention_tier(spark, sf_dir):
    from rulequarry.sources.store import retention

    return retention(event_traces(spark, sf_dir), "2024-04-15").select("trace_id", "tier")


_QUEUE = "q AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'edited' END AS decision, o_orderdate AS decided_at, o_custkey AS reviewer FROM orders)"


def _queue(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr("CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'edited' END").alias("decision"), F.col("o_orderdate").alias("decided_at"), F.col("o_custkey").alias("reviewer"))


@query(f"WITH {_QUEUE} SELECT d.decision, count(q.id) AS n FROM (VALUES ('pending'), ('approved'), ('rejected'), ('edited')) d(decision) LEFT JOIN q USING (decision) GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM q")
def queue_stats(spark, sf_dir):
    counts = _queue(spark, sf_dir).groupBy("decision").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(d,) for d in ("pending", "approved", "rejected", "edited")], "decision string")
    out = every.join(counts, "decision", "left").select("decision", F.coalesce("n", F.lit(0)).alias("n"))
    return out.unionByName(counts.agg(F.sum("n").alias("n")).select(F.lit("total").alias("decision"), "n"))


@query(f"WITH {_QUEUE} SELECT reviewer, arg_max(decision, (decided_at, id)) AS decision FROM q GROUP BY reviewer")
def queue_decide(spark, sf_dir):
    """The latest decision wins."""
    return _queue(spark, sf_dir).groupBy("reviewer").agg(F.max_by("decision", F.struct("decided_at", "id")).alias("decision"))


@query(f"WITH {_QUEUE} SELECT id, reviewer FROM q WHERE decision IN ('approved', 'edited')")
def queue_approved(spark, sf_dir):
    return _queue(spark, sf_dir).filter("decision IN ('approved', 'edited')").select("id", "reviewer")


_DIFF = f"WITH {EVENTS}, v AS (SELECT segment, list(DISTINCT tool) FILTER (WHERE version = 'v1' AND (segment <> 'EU' OR tool <> 'view')) AS a, list(DISTINCT tool) FILTER (WHERE version = 'v2' AND (segment <> 'US' OR tool <> 'click')) AS b FROM st GROUP BY segment)"


def _diff(spark, sf_dir):
    steps = event_steps(spark, sf_dir)
    a = F.collect_set(F.when((F.col("version") == "v1") & ~((F.col("segment") == "EU") & (F.col("tool") == "view")), F.col("tool")))
    b = F.collect_set(F.when((F.col("version") == "v2") & ~((F.col("segment") == "US") & (F.col("tool") == "click")), F.col("tool")))
    return steps.groupBy("segment").agg(a.alias("a"), b.alias("b"))


@query(f"{_DIFF} SELECT segment, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS added, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS removed, array_to_string(list_sort(list_intersect(a, b)), ',') AS common FROM v")
def version_diff(spark, sf_dir):
    join = lambda c: F.array_join(F.sort_array(c), ",")
    return _diff(spark, sf_dir).select("segment", join(F.array_except("b", "a")).alias("added"), join(F.array_except("a", "b")).alias("removed"), join(F.array_intersect("a", "b")).alias("common"))


@query(f"{_DIFF} SELECT segment, (len(list_filter(b, lambda x: NOT list_contains(a, x))) + len(list_filter(a, lambda x: NOT list_contains(b, x)))) / CAST(len(a) AS DOUBLE) > CAST(0.3 AS DOUBLE) AS breaking FROM v")
def version_breaking(spark, sf_dir):
    return _diff(spark, sf_dir).select("segment", ((F.size(F.array_except("b", "a")) + F.size(F.array_except("a", "b"))) / F.size("a") > 0.3).alias("breaking"))
