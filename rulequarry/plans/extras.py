"""Replays of streams as batches, counts and scalar functions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulequarry.functions import text as T
from rulequarry.operators import checks
from rulequarry.plans.checking import RESULTS, rules_table
from rulequarry.plans.projection import SHAPED, shaped
from rulequarry.plans.registry import query
from rulequarry.plans.text import _FORMS, _TOK, _TRI, _names
from rulequarry.operators import aliases
from rulequarry.sources.views import EVENTS, event_traces, table


@query(f"""{RESULTS} SELECT CAST(t.started_at AS DATE) AS day, r.rule_id, count(*) AS n, avg(CASE WHEN r.outcome = 'pass' THEN 1.0 ELSE 0.0 END) AS pass_rate FROM results r JOIN tr t USING (trace_id) WHERE r.outcome <> 'not_applicable' GROUP BY ALL""")
def windowed_pass_rate(spark, sf_dir):
    """Pass rates in tumbling windows of a day, as the stream of checks gives them."""
    rows = checks.check_all(event_traces(spark, sf_dir), rules_table(spark), ("started_at",)).filter("outcome <> 'not_applicable'")
    rate = F.avg(F.when(F.col("outcome") == "pass", 1.0).otherwise(0.0))
    w = F.window(F.col("started_at").cast("timestamp"), "1 day")
    return rows.groupBy(w.alias("w"), "rule_id").agg(F.count("*").alias("n"), rate.alias("pass_rate")).select(F.to_date("w.start").alias("day"), "rule_id", "n", "pass_rate")


@query(f"{SHAPED} SELECT session_id, fingerprint, count(*) AS n FROM fp GROUP BY ALL")
def stream_fingerprint_counts(spark, sf_dir):
    return shaped(spark, sf_dir).groupBy("session_id", "fingerprint").agg(F.count("*").alias("n"))


_NEXT = f"{_FORMS}, t AS (SELECT x.name AS a, y.name AS b, x.form AS fa, y.form AS fb FROM r x JOIN r y ON y.id = x.id + 1)"


def _neighbours(spark, sf_dir):
    rows = aliases.forms(_names(spark, sf_dir))
    return rows.select("id", F.col("name").alias("a"), F.col("form").alias("fa")).join(rows.select((F.col("id") - 1).alias("id"), F.col("name").alias("b"), F.col("form").alias("fb")), "id")


@query(f"{_NEXT}, k AS (SELECT a, b, {_TOK.format('fa')} AS x, {_TOK.format('fb')} AS y FROM t) SELECT a, b, CASE WHEN len(list_distinct(x || y)) = 0 THEN CAST(0 AS DOUBLE) ELSE len(list_intersect(x, y)) / CAST(len(list_distinct(x || y)) AS DOUBLE) END AS jaccard FROM k")
def token_jaccard(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("a", "b", T.token_jaccard("fa", "fb").alias("jaccard"))


@query(f"""{_NEXT}, g AS (SELECT a, b, 0 AS side, unnest({_TRI.format('fa')}) AS g FROM t UNION ALL SELECT a, b, 1, unnest({_TRI.format('fb')}) FROM t),
c AS (SELECT a, b, g, count(*) FILTER (WHERE side = 0) AS x, count(*) FILTER (WHERE side = 1) AS y FROM g GROUP BY ALL) SELECT a, b, round(sum(x * y) / sqrt(CAST(sum(x * x) AS DOUBLE) * sum(y * y)), 6) AS cosine FROM c GROUP BY a, b""")
def trigram_cosine(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("a", "b", F.round(T.trigram_cosine("fa", "fb"), 6).alias("cosine"))


@query()
def synthetic_booking_agent(spark, sf_dir):
    from rulequarry.sources.generate import booking_agent

    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return booking_agent(ids).select("trace_id", "segment", F.size("steps").alias("n_steps"))
