"""Chains, envelopes and conditionals of every cluster at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulequarry.operators import by_cluster, features
from rulequarry.plans.mining import _ASSOC, _FEATURES, _LIFT, with_statistics
from rulequarry.plans.registry import query
from rulequarry.sources.views import EVENTS, document_traces, event_traces


@query(f"""WITH {EVENTS}, f AS (SELECT segment AS c, trace_id, tool, min(ti) AS a, max(ti) AS z FROM st GROUP BY ALL), n AS (SELECT segment AS c, count(*) AS n FROM tr GROUP BY ALL),
p2 AS (SELECT x.c, x.tool || '>' || y.tool AS pattern, 2 AS len, count(*) AS k FROM f x JOIN f y USING (trace_id) WHERE x.a < y.z GROUP BY x.c, x.tool, y.tool),
m AS (SELECT x.c, x.trace_id, x.tool AS t1, s.tool AS t2, min(s.ti) AS b FROM f x JOIN st s ON s.trace_id = x.trace_id AND s.ti > x.a GROUP BY ALL),
p3 AS (SELECT m.c, t1 || '>' || t2 || '>' || y.tool AS pattern, 3 AS len, count(*) AS k FROM m JOIN f y USING (trace_id) WHERE m.b < y.z GROUP BY m.c, t1, t2, y.tool),
fr AS (SELECT c, pattern, len, k, n FROM (SELECT * FROM p2 UNION ALL SELECT * FROM p3) JOIN n USING (c) WHERE k >= greatest(1, CAST(floor(CAST(0.01 AS DOUBLE) * n) AS BIGINT)))
SELECT c AS cluster_id, pattern, 'The agent always calls `' || replace(pattern, '>', '` then `') || '`' AS description, round(CAST(k AS DOUBLE) / n, 4) AS support FROM fr WHERE len >= 3""")
def mine_chains_per_cluster(spark, sf_dir):
    """Closed patterns of three tools in each segment; those of the greatest length are all closed."""
    rows = event_traces(spark, sf_dir).select(F.col("segment").alias("cluster_id"), features.tool_sequence().alias("tools"))
    found = by_cluster.closed_patterns(by_cluster.frequent_subsequences(rows, 0.01)).filter("size(pattern) >= 3")
    said = F.concat(F.lit("The agent always calls `"), F.array_join("pattern", "` then `"), F.lit("`"))
    return found.select("cluster_id", F.array_join("pattern", ">").alias("pattern"), said.alias("description"), F.round(F.col("n_traces").cast("double") / F.col("n"), 4).alias("support"))


@query(f"""WITH {EVENTS}, b AS (SELECT segment AS c, trace_id, count(*) + 1 AS step_count, count(*) AS tool_count, count(DISTINCT tool) AS distinct_tools, 18 AS user_chars, 0 AS response_chars, sum(latency_ms) AS sum_latency, max(latency_ms) AS max_latency,
  count(*) FILTER (WHERE status <> 'success') AS error_count FROM st GROUP BY ALL),
u AS (UNPIVOT (SELECT c, trace_id, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in _FEATURES)} FROM b) ON {', '.join(_FEATURES)} INTO NAME feature VALUE v),
p AS (SELECT c, feature, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.99) AS p99, quantile_cont(v, 0.5) AS median FROM u GROUP BY ALL)
SELECT c AS cluster_id, feature, round(p1, 6) AS p1, round(p99, 6) AS p99, round(median, 6) AS median, avg(CASE WHEN v BETWEEN p1 AND p99 THEN 1.0 ELSE 0.0 END) AS within_rate FROM p JOIN u USING (c, feature)
WHERE p99 - p1 >= 1e-6 AND NOT (median = 0 AND p99 < 5) GROUP BY ALL HAVING avg(CASE WHEN v BETWEEN p1 AND p99 THEN 1.0 ELSE 0.0 END) >= 0.95""")
def mine_envelopes_per_cluster(spark, sf_dir):
    """The usual range of each feature in each segment."""
    rows = features.behavioral(event_traces(spark, sf_dir), keep=("segment",)).withColumnRenamed("segment", "cluster_id")
    found = by_cluster.envelopes(rows)
    return found.select("cluster_id", "feature", *[F.round(c, 6).alias(c) for c in ("p1", "p99", "median")], "within_rate")


# the statement for all documents, with the source in every key
_BY_SOURCE = (
    _ASSOC.replace("SELECT doc_id, unnest", "SELECT doc_id, source AS c, unnest").replace("SELECT doc_id, 'lang_' || lang AS tool FROM documents UNION ALL SELECT doc_id, source FROM documents", "SELECT doc_id, source AS c, unnest(['lang_' || lang, source]) AS tool FROM documents")
    .replace("n AS (SELECT count(*) AS n FROM documents)", "n AS (SELECT source AS c, count(*) AS n FROM documents GROUP BY ALL)")
    .replace("SELECT keyword, count(*) AS nk FROM kw GROUP BY keyword HAVING", "SELECT c, keyword, count(*) AS nk FROM kw GROUP BY ALL HAVING").replace("SELECT tool, count(*) AS nt FROM tl GROUP BY tool", "SELECT c, tool, count(*) AS nt FROM tl GROUP BY ALL")
    .replace("c AS (SELECT keyword, tool, count(*) AS n11 FROM kw JOIN tl USING (doc_id) GROUP BY ALL)", "b AS (SELECT kw.c, keyword, tool, count(*) AS n11 FROM kw JOIN tl USING (doc_id) GROUP BY ALL)")
    .replace("SELECT keyword, tool, n11, nk - n11", "SELECT c, keyword, tool, n11, nk - n11").replace("FROM c JOIN k USING (keyword) JOIN t USING (tool), n)", "FROM b JOIN k USING (c, keyword) JOIN t USING (c, tool) JOIN n USING (c))")
)


@query(f"""{_BY_SOURCE} SELECT c AS cluster_id, keyword, tool, n11, round({_LIFT}, 6) AS lift, round(mi, 6) AS mi FROM stat
WHERE n11 + n10 < CAST(floor(CAST(0.8 AS DOUBLE) * n) AS BIGINT) AND CAST(n11 AS DOUBLE) / n >= 0.05 AND round(mi, 6) >= 0.05 AND round(chi2, 6) >= 6.63 AND round({_LIFT}, 6) >= 0.2""")
def mine_conditional_per_cluster(spark, sf_dir):
    """Tools that a keyword calls for among the documents of each source."""
    rows = document_traces(spark, sf_dir).select(F.col("segment").alias("cluster_id"), features.user_tokens("steps[0].content").alias("keywords"), F.array_distinct(features.tool_sequence()).alias("tools"))
    lift = F.round(F.expr(_LIFT.replace("DOUBLE", "double")), 6)
    s = with_statistics(by_cluster.contingency(rows)).withColumn("lift", lift)
    kept = s.filter("n11 + n10 < floor(0.8D * n) AND CAST(n11 AS double) / n >= 0.05D AND round(mi, 6) >= 0.05D AND round(chi2, 6) >= 6.63D AND lift >= 0.2D")
    return kept.select("cluster_id", "keyword", "tool", "n11", "lift", F.round("mi", 6).alias("mi"))
