"""Verification of rules on traces and on all small traces, certificates, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulequarry.operators import drift
from rulequarry.operators import verify as V
from rulequarry.plans.checking import RULES, SUMMARY, rules_table
from rulequarry.plans.registry import query
from rulequarry.sources.views import EVENTS, event_steps, event_traces

_HOLDS = {
    "r01": "NOT list_contains(tools, 'purchase') OR (list_contains(tools, 'view') AND list_position(tools, 'view') < list_position(tools, 'purchase'))",
    "r02": "NOT list_contains(tools, 'purchase') OR (list_contains(tools, 'signup') AND list_position(tools, 'signup') < list_position(tools, 'purchase'))",
    "r03": "segment <> 'EU' OR list_contains(tools, 'view')",
    "r05": "true",
    "r06": "len(list_filter(list_zip(tools, latencies), lambda x: x[1] = 'view' AND x[2] > 2500)) = 0",
    "r07": "len(list_filter(list_zip(tools, statuses), lambda x: x[1] = 'click' AND x[2] <> 'success')) = 0",
    "r08": "NOT list_contains(tools, 'purchase') OR len(list_filter(tools[list_position(tools, 'purchase') + 1:], lambda x: x IN ('view', 'signup'))) = 0",
    "r09": "segment <> 'EU' OR NOT list_contains(tools, 'signup')",
}


@query(f"WITH {EVENTS} " + " UNION ALL ".join(f"SELECT trace_id, '{k}' AS rule_id, {v} AS holds FROM tr" for k, v in _HOLDS.items()))
def fol_verify(spark, sf_dir):
    """First-order reading of each rule, evaluated on each trace: no vacuous outcomes, keywords as whole tokens, tools by equality."""
    rules = rules_table(spark).filter(F.col("rule_id").isin(*_HOLDS))
    return V.verify(event_traces(spark, sf_dir), rules)


@query(f"{SUMMARY}, w AS (SELECT rule_id, sum(passed) AS p, sum(failed + warned) AS f FROM counts GROUP BY rule_id) SELECT rule_id, CAST(p + f AS BIGINT) AS checked, CAST(f AS BIGINT) AS violations, CASE WHEN p + f = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(p AS DOUBLE) / (p + f) END AS empirical FROM w")
def certificate_evidence(spark, sf_dir):
    from rulequarry.operators import regress
    from rulequarry.plans.checking import results

    s = regress.batch_summary(results(spark, sf_dir))
    return s.select("rule_id", F.col("applicable").alias("checked"), (F.col("failed") + F.col("warned")).alias("violations"), F.when(F.col("applicable") == 0, 1.0).otherwise(F.col("passed").cast("double") / F.col("applicable")).alias("empirical"))


def _observations(spark, sf_dir):
    return event_steps(spark, sf_dir).select("session_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ord"), F.col("event_id").alias("tie"), F.when(F.col("status") == "success", 1.0).otherwise(0.0).alias("x"))


_OBS = f"WITH RECURSIVE {EVENTS}, o AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS i, CASE WHEN status = 'success' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x FROM st)"


@query(f"""{_OBS}, ph AS (SELECT session_id, i, x AS mean, (x - x) - CAST(0.005 AS DOUBLE) AS s, least(CAST(0 AS DOUBLE), -CAST(0.005 AS DOUBLE)) AS low, CAST(0 AS BIGINT) AS fired FROM o WHERE i = 1
  UNION ALL SELECT session_id, i, mean, s, least(low, s), CASE WHEN fired > 0 THEN fired WHEN i >= 30 AND s - least(low, s) > 8 THEN i ELSE 0 END FROM (
    SELECT o.session_id, o.i, p.mean + CAST(0.05 AS DOUBLE) * (o.x - p.mean) AS mean, p.s + ((p.mean + CAST(0.05 AS DOUBLE) * (o.x - p.mean)) - o.x) - CAST(0.005 AS DOUBLE) AS s, p.low, p.fired FROM ph p JOIN o ON o.session_id = p.session_id AND o.i = p.i + 1))
SELECT session_id, max(i) AS n, max(fired) AS fired_at, round(arg_max(s, i), 6) AS cumulated FROM ph GROUP BY session_id""")
def page_hinkley(spark, sf_dir):
    return drift.page_hinkley(_observations(spark, sf_dir), "session_id")


@query(f"""{_OBS}, cs AS (SELECT session_id, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down, CAST(0 AS BIGINT) AS fired, '' AS direction FROM o WHERE i = 1
  UNION ALL SELECT session_id, i, up, down, CASE WHEN fired > 0 THEN fired WHEN i >= 20 AND (up > 4 OR down < -4) THEN i ELSE 0 END, CASE WHEN fired > 0 THEN direction WHEN i >= 20 AND up > 4 THEN 'up' WHEN i >= 20 AND down < -4 THEN 'down' ELSE '' END FROM (
    SELECT o.session_id, o.i, greatest(CAST(0 AS DOUBLE), c.up + (o.x - CAST(0.95 AS DOUBLE)) - CAST(0.05 AS DOUBLE)) AS up, least(CAST(0 AS DOUBLE), c.down + (o.x - CAST(0.95 AS DOUBLE)) + CAST(0.05 AS DOUBLE)) AS down, c.fired, c.direction FROM cs c JOIN o ON o.session_id = c.session_id AND o.i = c.i + 1))
SELECT session_id, max(i) AS n, max(fired) AS fired_at, arg_max(direction, i) AS direction FROM cs GROUP BY session_id""")
def cusum(spark, sf_dir):
    return drift.cusum(_observations(spark, sf_dir), "session_id")


@query()
def drift_events(spark, sf_dir):
    return drift.drift_events(_observations(spark, sf_dir), "session_id")


@query(f"WITH {EVENTS} SELECT session_id, count(*) AS n, avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END) AS mean FROM st GROUP BY session_id")
def drift_snapshot(spark, sf_dir):
    return _observations(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
