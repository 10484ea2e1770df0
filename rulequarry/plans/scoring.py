"""Candidates: vectors, similarity, merging, scores and triage. The candidates are lines of `benchmark`, typed by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulequarry.functions import text as T
from rulequarry.operators import candidates
from rulequarry.plans.registry import query
from rulequarry.sources.views import EVENTS, event_traces, table

_CAND = """WITH c AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'ordering' WHEN 1 THEN 'conditional' ELSE 'state' END AS type, text AS description, CASE item_id % 2 WHEN 0 THEN 'statistical' ELSE 'llm' END AS track,
  (item_id % 7) / CAST(7 AS DOUBLE) AS support, (item_id % 5) / CAST(5 AS DOUBLE) AS consistency, item_id % 4 AS tool_a FROM benchmark)"""


def _candidates(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        "item_id",
        F.expr("CASE item_id % 3 WHEN 0 THEN 'ordering' WHEN 1 THEN 'conditional' ELSE 'state' END").alias("type"),
        F.col("text").alias("description"),
        F.expr("CASE item_id % 2 WHEN 0 THEN 'statistical' ELSE 'llm' END").alias("track"),
        F.expr("(item_id % 7) / 7D").alias("support"),
        F.expr("(item_id % 5) / 5D").alias("consistency"),
        F.expr("IF(item_id % 3 = 0, map('tool_a', concat('t', item_id % 4), 'category', CAST(item_id AS string)), CAST(NULL AS map<string, string>))").alias("params"),
        F.expr("array(concat('t', item_id % 10), concat('u', item_id % 3))").alias("evidence"),
    )


_JARGON = " OR ".join(f"contains(lower(trim(description)), '{t}')" for t in T.JARGON)
def clarity_sql(column: str) -> str:
    jargon = _JARGON.replace("description", column)
    return f"""greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(1 AS DOUBLE) - CASE WHEN length(trim({column})) < 25 THEN CAST(0.4 AS DOUBLE) WHEN length(trim({column})) > 200 THEN CAST(0.2 AS DOUBLE) ELSE 0 END
  - CASE WHEN regexp_matches(trim({column}), '`[^`]+`') OR regexp_matches(trim({column}), '[0-9]') THEN 0 ELSE CAST(0.2 AS DOUBLE) END - CASE WHEN {jargon} THEN CAST(0.3 AS DOUBLE) ELSE 0 END))"""


_CLARITY = clarity_sql("description")
_SCORED = f"{_CAND}, s AS (SELECT *, {_CLARITY} AS clarity FROM c), f AS (SELECT *, round(CAST(0.4 AS DOUBLE) * support + CAST(0.3 AS DOUBLE) * consistency + CAST(0.1 AS DOUBLE) * clarity, 4) AS confidence FROM s)"


@query(f"{_SCORED} SELECT item_id, round(clarity, 6) AS clarity FROM s")
def clarity_score(spark, sf_dir):
    return _candidates(spark, sf_dir).select("item_id", F.round(T.clarity("description"), 6).alias("clarity"))


@query(f"{_SCORED} SELECT item_id, confidence FROM f")
def confidence(spark, sf_dir):
    return candidates.scored(_candidates(spark, sf_dir)).select("item_id", "confidence")


@query(f"{_SCORED} SELECT item_id, CASE WHEN confidence < 0.6 THEN 'rejected' WHEN confidence < 0.8 THEN 'pending' ELSE 'active' END AS status FROM f")
def triage(spark, sf_dir):
    return candidates.scored(_candidates(spark, sf_dir)).select("item_id", "status")


def tfidf_sql(cand):
    """Unit vectors v(item_id, type, term, w) of the candidates c(item_id, type, description) that a WITH clause gives."""
    return r"""{0}, wd AS (SELECT item_id, type, list_filter(regexp_extract_all(lower(description), '[a-z][a-z0-9_]+'), lambda t: t NOT IN ('the', 'a', 'an', 'is', 'are', 'always', 'never', 'before', 'after', 'agent', 'trace', 'must', 'this', 'that', 'with', 'and', 'or', 'of',
  'to', 'for', 'from', 'has', 'have', 'be', 'been', 'if', 'when', 'then', 'as', 'at', 'by', 'on', 'in', 'it', 'its', 'into')) AS words FROM c),
n AS (SELECT type, count(*) AS n, avg(len(words)) AS mean FROM wd GROUP BY type),
ft AS (SELECT item_id, type, n, words || CASE WHEN mean >= 8 THEN ['__bi__' || words[i] || '_' || words[i + 1] FOR i IN range(1, len(words))] ELSE [] END || flatten([['__ch__' || t[i:i + 2] FOR i IN range(1, length(t) - 1)] FOR t IN words]) AS terms FROM wd JOIN n USING (type)),
tok AS (SELECT item_id, type, n, len(terms) AS len, unnest(terms) AS term FROM ft), tf AS (SELECT item_id, type, n, len, term, count(*) AS c FROM tok GROUP BY ALL), df AS (SELECT type, term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT tf.item_id, tf.type, tf.term, CAST(c AS DOUBLE) / len * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) * CASE WHEN starts_with(tf.term, '__ch__') THEN CAST(0.4 AS DOUBLE) ELSE 1 END AS w FROM tf JOIN df ON df.type = tf.type AND df.term = tf.term),
v AS (SELECT item_id, type, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM w)""".format(cand)


_TFIDF = tfidf_sql(_CAND)


@query(f"{_TFIDF} SELECT item_id, term, round(w, 6) AS weight FROM v")
def tfidf_vectors(spark, sf_dir):
    return candidates.tfidf(_candidates(spark, sf_dir)).select("item_id", "term", F.round("w", 6).alias("weight"))


_SIM = f"{_TFIDF}, sim AS (SELECT a.item_id AS a, b.item_id AS b, round(sum(a.w * b.w), 6) AS cosine FROM v a JOIN v b ON a.type = b.type AND a.term = b.term AND a.item_id < b.item_id GROUP BY ALL)"


@query(f"{_SIM} SELECT a, b, cosine FROM sim")
def candidate_similarity(spark, sf_dir):
    return candidates.similarity(candidates.tfidf(_candidates(spark, sf_dir)))


_CLUSTER = f"""{_SIM.replace('WITH c AS', 'WITH RECURSIVE c AS', 1)}, ok AS (SELECT a, b FROM sim WHERE cosine >= 0.7), e AS (SELECT a, b FROM ok UNION SELECT b, a FROM ok),
reach AS (SELECT item_id AS x, item_id AS y FROM c UNION SELECT x, e.b FROM reach JOIN e ON e.a = reach.y), cl AS (SELECT x AS item_id, min(y) AS cluster FROM reach GROUP BY x)"""


@query(f"{_CLUSTER} SELECT item_id, cluster FROM cl")
def candidate_clusters(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    return candidates.clusters(rows, candidates.similarity(candidates.tfidf(rows)))


_AGREE = f"""{_CLUSTER}, odd AS (SELECT cluster FROM cl JOIN c USING (item_id) WHERE type = 'ordering' GROUP BY cluster HAVING count(DISTINCT tool_a) > 1),
ag AS (SELECT item_id, CASE WHEN cluster IN (SELECT cluster FROM odd) THEN item_id ELSE cluster END AS cluster FROM cl)"""


@query(f"""{_AGREE} SELECT cluster, arg_min(description, (-length(description), item_id)) AS description, max(support) AS support, max(consistency) AS consistency, count(*) AS n, CASE WHEN count(DISTINCT track) > 1 THEN 'both' ELSE min(track) END AS track,
  array_to_string(list_sort(list_distinct(flatten(list(['t' || CAST(item_id % 10 AS VARCHAR), 'u' || CAST(item_id % 3 AS VARCHAR)])))), ',') AS evidence FROM ag JOIN c USING (item_id) GROUP BY cluster""")
def cross_validate(spark, sf_dir):
    """Candidates of a cluster as one if all of its pairs agree, else each by itself: longest description, best support, `both` if both tracks found it."""
    rows = _candidates(spark, sf_dir)
    found = candidates.agreeing(rows, candidates.clusters(rows, candidates.similarity(candidates.tfidf(rows))))
    return candidates.merged(rows, found).select("cluster", "description", "support", "consistency", "n", "track", F.array_join(F.array_sort("evidence"), ",").alias("evidence"))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS c FROM x GROUP BY ALL),
s AS (SELECT x.vec_id, c.label, round(sum(x.x * c.c), 6) AS s FROM x JOIN c USING (i) GROUP BY ALL) SELECT vec_id, arg_max(label, (s, -label)) AS cluster FROM s GROUP BY vec_id""")
def route_by_centroid(spark, sf_dir):
    """Each vector's nearest class centroid by dot product; the centroids are one row for each label."""
    from rulequarry.operators import clustering

    return clustering.route(table(spark, sf_dir, "embeddings"))


_TOOL_CENTROIDS = f"""WITH {EVENTS}, v AS (SELECT * FROM tr WHERE version = 'v1'), n AS (SELECT count(*) AS n FROM v),
c AS (SELECT trace_id, segment, unnest(tools) AS tool, len(tools) AS size FROM v), df AS (SELECT tool, ln((1 + n) / CAST(1 + count(DISTINCT trace_id) AS DOUBLE)) + 1 AS idf FROM c, n GROUP BY tool, n),
w AS (SELECT segment, tool, sum(idf / size) / (SELECT count(*) FROM v WHERE v.segment = c.segment) AS weight FROM c JOIN df USING (tool) GROUP BY segment, tool)"""


@query(f"""{_TOOL_CENTROIDS}, s AS (SELECT t.trace_id, k.segment, round(coalesce(sum(w.weight), 0), 9) AS s FROM (SELECT trace_id, unnest(tools) AS tool FROM tr WHERE version = 'v2') t CROSS JOIN (SELECT DISTINCT segment FROM w) k
LEFT JOIN w ON w.segment = k.segment AND w.tool = t.tool GROUP BY t.trace_id, k.segment),
r AS (SELECT trace_id, segment, row_number() OVER (PARTITION BY trace_id ORDER BY s DESC, segment) AS i FROM s) SELECT trace_id, segment AS cluster FROM r WHERE i = 1""")
def route_by_tools(spark, sf_dir):
    """New traces sent to the cluster whose tool weights their calls sum to most; the clusters are the segments of older traces."""
    from rulequarry.operators import clustering

    rows = event_traces(spark, sf_dir)
    old = rows.filter("version = 'v1'").withColumn("cluster", F.col("segment"))
    return clustering.route_by_tools(rows.filter("version = 'v2'"), clustering.tool_centroids(old, clustering.fit_vectors(old)))


@query(f"""WITH {EVENTS}, n AS (SELECT count(*) AS n FROM tr), b AS (SELECT trace_id, len(tools) + 1 AS step_count, len(tools) AS tool_count, len(list_distinct(tools)) AS distinct_tools, list_sum(latencies) AS sum_latency, list_max(latencies) AS max_latency,
  len(list_filter(statuses, lambda x: x <> 'success')) AS error_count FROM tr),
l AS (UNPIVOT (SELECT trace_id, CAST(step_count AS DOUBLE) AS step_count, CAST(tool_count AS DOUBLE) AS tool_count, CAST(distinct_tools AS DOUBLE) AS distinct_tools, CAST(sum_latency AS DOUBLE) AS sum_latency, CAST(max_latency AS DOUBLE) AS max_latency, CAST(error_count AS DOUBLE) AS error_count FROM b)
  ON step_count, tool_count, distinct_tools, sum_latency, max_latency, error_count INTO NAME dim VALUE x),
z AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS sd FROM l GROUP BY dim), beh AS (SELECT trace_id, dim, (x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS w FROM l JOIN z USING (dim)),
words AS (SELECT trace_id, 'tool:' || tool AS dim, count(*) / CAST(max(k) AS DOUBLE) AS tf FROM (SELECT trace_id, unnest(tools) AS tool, len(tools) AS k FROM tr) GROUP BY ALL
  UNION ALL SELECT trace_id, 'kw:' || kw, CAST(1 AS DOUBLE) / 3 FROM tr, (VALUES ('visit'), ('from'), ('shop')) k(kw)),
df AS (SELECT dim, count(*) AS df FROM words GROUP BY dim), idf AS (SELECT dim, ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM df, n),
every AS (SELECT trace_id, dim, tf * idf AS w FROM words JOIN idf USING (dim) UNION ALL SELECT trace_id, dim, w FROM beh)
SELECT trace_id, dim, round(w / sqrt(sum(w * w) OVER (PARTITION BY trace_id)), 6) AS weight FROM every WHERE w <> 0""")
def trace_vectors(spark, sf_dir):
    """Each trace as a unit vector of scaled behaviour and of weighted tools and keywords."""
    from rulequarry.operators import clustering

    rows = event_traces(spark, sf_dir)
    out = clustering.vectors(rows, clustering.fit_vectors(rows))
    return clustering.parts(out).select("trace_id", "dim", F.round("w", 6).alias("weight"))


@query()
def cluster_vectors(spark, sf_dir):
    from rulequarry.operators import clustering

    return clustering.kmeans(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))


@query()
def isolation_inliers(spark, sf_dir):
    from rulequarry.operators import anomaly, features

    return anomaly.inliers(features.behavioral(event_traces(spark, sf_dir)))


@query()
def inlier_envelope(spark, sf_dir):
    """The usual range of each feature among the traces that the isolation forest doesn't single out."""
    from rulequarry.operators import anomaly, features

    return anomaly.envelopes(features.behavioral(event_traces(spark, sf_dir)))
