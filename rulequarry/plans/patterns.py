"""Sequence patterns and ordering rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rulequarry.operators import features, sequences
from rulequarry.plans.registry import query
from rulequarry.sources.views import EVENTS, event_steps, event_traces

_FREQ = f"""WITH {EVENTS}, f AS (SELECT trace_id, tool, min(ti) AS a, max(ti) AS z FROM st GROUP BY ALL),
p1 AS (SELECT tool AS pattern, 1 AS len, count(*) AS n FROM f GROUP BY tool),
p2 AS (SELECT x.tool || '>' || y.tool AS pattern, 2 AS len, count(*) AS n FROM f x JOIN f y USING (trace_id) WHERE x.a < y.z GROUP BY x.tool, y.tool),
m AS (SELECT x.trace_id, x.tool AS t1, s.tool AS t2, min(s.ti) AS b FROM f x JOIN st s ON s.trace_id = x.trace_id AND s.ti > x.a GROUP BY ALL),
p3 AS (SELECT t1 || '>' || t2 || '>' || y.tool AS pattern, 3 AS len, count(*) AS n FROM m JOIN f y USING (trace_id) WHERE m.b < y.z GROUP BY t1, t2, y.tool),
al AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3),
fr AS (SELECT pattern, len, n FROM al WHERE n >= greatest(1, CAST(floor(CAST(0.01 AS DOUBLE) * (SELECT count(*) FROM tr)) AS BIGINT)))"""


def _sequences(spark, sf_dir):
    return event_traces(spark, sf_dir).select("trace_id", features.tool_sequence().alias("tools"))


@query(f"{_FREQ} SELECT pattern, n AS n_traces FROM fr")
def freq_subsequences(spark, sf_dir):
    found = sequences.frequent_subsequences(_sequences(spark, sf_dir), 0.01)
    return found.select(F.array_join("pattern", ">").alias("pattern"), "n_traces")


@query(f"""{_FREQ} SELECT a.pattern, a.n AS n_traces FROM fr a WHERE a.len >= 2 AND NOT EXISTS (SELECT 1 FROM fr b WHERE b.n = a.n AND b.len > a.len AND
  regexp_matches(b.pattern, '(^|>)' || replace(a.pattern, '>', '(>|>.*>)') || '(>|$)'))""")
def closed_patterns(spark, sf_dir):
    found = sequences.closed_patterns(sequences.frequent_subsequences(_sequences(spark, sf_dir), 0.01))
    return found.select(F.array_join("pattern", ">").alias("pattern"), "n_traces")


_PAIR = f"""WITH {EVENTS}, f AS (SELECT trace_id, tool, min(ti) AS a FROM st GROUP BY ALL),
d AS (SELECT x.tool AS tool_a, y.tool AS tool_b, count(*) FILTER (WHERE x.a < y.a) AS forward, count(*) FILTER (WHERE x.a > y.a) AS backward, count(*) FILTER (WHERE x.a < y.a AND y.a - x.a <= 5) AS near
  FROM f x JOIN f y USING (trace_id) WHERE x.tool <> y.tool GROUP BY ALL),
g AS (SELECT *, forward / (forward + backward) AS directionality, CASE WHEN forward > 0 THEN near / forward ELSE CAST(0 AS DOUBLE) END AS gap_consistency FROM d)"""


def _pairs(spark, sf_dir):
    steps = event_steps(spark, sf_dir)
    numbered = steps.select("trace_id", "tool", (F.row_number().over(Window.partitionBy("trace_id").orderBy("ts", "event_id")) - 1).alias("ti"))
    return sequences.pair_direction(numbered.groupBy("trace_id", "tool").agg(F.min("ti").alias("first")))


@query(f"{_PAIR} SELECT * FROM g")
def pair_direction(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"""{_PAIR}, n AS (SELECT count(*) AS n FROM tr) SELECT tool_a, tool_b, CAST(forward AS DOUBLE) / n AS support, directionality AS consistency, CASE WHEN gap_consistency >= 0.8 THEN 'high' ELSE 'medium' END AS severity,
  CAST(forward AS DOUBLE) / n >= 0.6 AND directionality >= 0.9 AS kept FROM g, n""")
def mine_ordering(spark, sf_dir):
    """Ordering rules of two tools, with those under the thresholds marked."""
    n = event_steps(spark, sf_dir).agg(F.countDistinct("trace_id").alias("n"))
    g = _pairs(spark, sf_dir).crossJoin(F.broadcast(n)).withColumn("support", F.col("forward").cast("double") / F.col("n"))
    return g.select("tool_a", "tool_b", "support", F.col("directionality").alias("consistency"), F.when(F.col("gap_consistency") >= 0.8, "high").otherwise("medium").alias("severity"), ((F.col("support") >= 0.6) & (F.col("directionality") >= 0.9)).alias("kept"))


_CHAINS = """, n AS (SELECT count(*) AS n FROM tr) SELECT a.pattern, 'The agent always calls `' || replace(a.pattern, '>', '` then `') || '`' AS description, 'forall trace: contains_subsequence(trace, ' || replace(a.pattern, '>', ', ') || ')' AS formal_rule,
  round(CAST(a.n AS DOUBLE) / n.n, 4) AS support FROM fr a, n WHERE a.len >= 3 AND NOT EXISTS (SELECT 1 FROM fr b WHERE b.n = a.n AND b.len > a.len AND regexp_matches(b.pattern, '(^|>)' || replace(a.pattern, '>', '(>|>.*>)') || '(>|$)'))"""


def _chains(rows, closed):
    """Ordering rules from the closed patterns of three tools or more."""
    n = rows.agg(F.count("*").alias("n"))
    found = closed.filter("size(pattern) >= 3").crossJoin(F.broadcast(n))
    return found.select(
        F.array_join("pattern", ">").alias("pattern"), F.concat(F.lit("The agent always calls `"), F.array_join("pattern", "` then `"), F.lit("`")).alias("description"),
        F.concat(F.lit("forall trace: contains_subsequence(trace, "), F.array_join("pattern", ", "), F.lit(")")).alias("formal_rule"), F.round(F.col("n_traces").cast("double") / F.col("n"), 4).alias("support"),
    )


@query(f"{_FREQ}{_CHAINS}")
def mine_chains(spark, sf_dir):
    """Ordering rules of three tools, from closed patterns of up to three; all_chains has those of any length."""
    rows = _sequences(spark, sf_dir)
    return _chains(rows, sequences.closed_patterns(sequences.frequent_subsequences(rows, 0.01)))


#: Patterns of any length, grown a tool at a time from where their first match in a trace ends.
_ALL_FREQ = f"""WITH RECURSIVE {EVENTS}, lo AS (SELECT greatest(1, CAST(floor(CAST(0.01 AS DOUBLE) * count(*)) AS BIGINT)) AS least FROM tr),
g AS (SELECT trace_id, tool AS pattern, 1 AS len, min(ti) AS z FROM st WHERE tool IS NOT NULL GROUP BY ALL
  UNION ALL SELECT * FROM (SELECT g.trace_id, g.pattern || '>' || s.tool AS pattern, g.len + 1 AS len, min(s.ti) AS z FROM g JOIN st s ON s.trace_id = g.trace_id AND s.ti > g.z WHERE s.tool IS NOT NULL GROUP BY ALL) QUALIFY count(*) OVER (PARTITION BY pattern) >= (SELECT least FROM lo)),
fr AS (SELECT pattern, len, count(*) AS n FROM g GROUP BY pattern, len HAVING count(*) >= (SELECT least FROM lo))"""
ALL_CHAINS = f"{_ALL_FREQ}{_CHAINS}"


def all_chains(spark, sf_dir):
    """Ordering rules of three tools or more, from closed patterns of any length."""
    rows = _sequences(spark, sf_dir)
    return _chains(rows, sequences.closed_subsequences(rows, 0.01))


@query(f"""{_FREQ}, has AS (SELECT x.tool || '>' || y.tool AS pattern, trace_id FROM f x JOIN f y USING (trace_id) WHERE x.a < y.z UNION ALL SELECT t1 || '>' || t2 || '>' || y.tool, trace_id FROM m JOIN f y USING (trace_id) WHERE m.b < y.z),
e AS (SELECT pattern, trace_id, row_number() OVER (PARTITION BY pattern ORDER BY trace_id) AS k FROM fr JOIN has USING (pattern))
SELECT pattern, count(*) AS n, string_agg(trace_id, ',' ORDER BY trace_id) AS evidence FROM e WHERE k <= 50 GROUP BY pattern""")
def pattern_evidence(spark, sf_dir):
    """The first 50 traces, by id, of each frequent pattern of two tools or more."""
    rows = _sequences(spark, sf_dir)
    found = sequences.frequent_subsequences(rows, 0.01).filter("size(pattern) >= 2")
    first = sequences.evidence(rows, found, 50)
    return first.select(F.array_join("pattern", ">").alias("pattern"), F.size("ids").cast("long").alias("n"), F.array_join("ids", ",").alias("evidence"))


@query(f"WITH {EVENTS}, r AS (SELECT session_id, ts, event_id, status, row_number() OVER w AS k, avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN 255 PRECEDING AND CURRENT ROW) AS rate FROM st WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)) SELECT event_id, round(rate, 6) AS rate FROM r")
def rolling_pass_rate(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(-255, 0)
    return event_steps(spark, sf_dir).select("event_id", F.round(F.avg(F.when(F.col("status") == "success", 1.0).otherwise(0.0)).over(w), 6).alias("rate"))
