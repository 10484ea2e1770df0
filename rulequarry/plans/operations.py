"""Review bands, verification of the latest traces, packs, counts of what was mined, and mining by cluster."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.operators import candidates, certificates, packs
from rulequarry.operators import verify as V
from rulequarry.plans import clusters
from rulequarry.plans.checking import rules_table
from rulequarry.plans.mine import _ALL, union_of_miners
from rulequarry.plans.registry import ORACLES, query
from rulequarry.plans.scoring import clarity_sql
from rulequarry.plans.verification import _HOLDS
from rulequarry.schema import PARAMS
from rulequarry.sources.views import EVENTS, event_steps, event_traces, table


@query("""WITH RECURSIVE s AS (SELECT CAST(p_partkey * 37 % 1000 AS DOUBLE) / 1000 AS score FROM part),
b AS (SELECT 0 AS i, CAST(0.6 AS DOUBLE) AS lo, CAST(0.99 AS DOUBLE) AS hi, CAST(0 AS DOUBLE) AS mid, CAST(0 AS BIGINT) AS n
  UNION ALL SELECT i, lo, hi, mid, (SELECT count(*) FROM s WHERE score >= CAST(0.6 AS DOUBLE) AND score < mid) AS n FROM (
    SELECT i + 1 AS i, lo, hi, (lo + hi) / 2 AS mid FROM (
      SELECT i, CASE WHEN i > 0 AND n < 10 THEN mid ELSE lo END AS lo, CASE WHEN i > 0 AND n > 15 THEN mid ELSE hi END AS hi FROM b WHERE i < 20 AND (i = 0 OR n < 10 OR n > 15))))
SELECT arg_max(mid, i) AS threshold FROM b""")
def review_band(spark, sf_dir):
    """The end of a review band that holds 10 to 15 scores."""
    scores = table(spark, sf_dir, "part").select(((F.col("p_partkey") * 37 % 1000).cast("double") / 1000).alias("score"))
    return spark.createDataFrame([(certificates.review_band(scores, 10, 15),)], "threshold double")


_READ = {**_HOLDS, "r12": "len(list_filter(list_zip(tools, statuses), lambda x: x[1] = 'view' AND x[2] <> 'success')) = 0"}


@query(f"""WITH {EVENTS}, last AS (SELECT * FROM tr WHERE version = 'v2' ORDER BY started_at DESC, trace_id LIMIT 400), h AS ({' UNION ALL '.join(f"SELECT trace_id, started_at, '{k}' AS rule_id, {v} AS holds FROM last" for k, v in _READ.items())}),
k AS (SELECT *, row_number() OVER (PARTITION BY rule_id, holds ORDER BY started_at DESC, trace_id) AS k FROM h)
SELECT rule_id, count(*) AS sample_size, count(*) FILTER (WHERE holds) AS holds, count(*) FILTER (WHERE NOT holds) AS violates, round(count(*) FILTER (WHERE holds) / CAST(count(*) AS DOUBLE), 4) AS pass_rate,
  coalesce(string_agg(trace_id, ',' ORDER BY k) FILTER (WHERE NOT holds AND k <= 3), '') AS counter_examples FROM k GROUP BY rule_id""")
def verify_recent(spark, sf_dir):
    """The formal reading of each rule on the 400 latest traces of the new version, with three counter-examples at most."""
    rules = rules_table(spark).filter(F.col("rule_id").isin(*_READ))
    return V.verify_recent(event_traces(spark, sf_dir), rules, 400, 3, "v2").drop("signature")


@query(f"WITH {EVENTS} " + " UNION ALL ".join(f"SELECT trace_id, '{k}' AS rule_id, CASE WHEN {v} THEN 'pass' ELSE 'fail' END AS outcome FROM tr" for k, v in _READ.items()) + " UNION ALL SELECT trace_id, 'r13', 'not_applicable' FROM tr UNION ALL SELECT trace_id, 'r14', 'not_applicable' FROM tr")
def fol_outcomes(spark, sf_dir):
    """The formal reading as outcomes; rules without one don't apply."""
    return V.outcomes(event_traces(spark, sf_dir), rules_table(spark).filter(F.col("rule_id").isin(*_READ, "r13", "r14")))


def _nation_packs(spark, sf_dir) -> DataFrame:
    """A pack of each nation: its suppliers as ordering rules, of which every third has a name that no tool may have."""
    fields = [x.split(": ") for x in PARAMS[len("struct<") : -1].split(", ")]
    given = {"tool_a": F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.regexp_replace("s_name", "#", "_")), "tool_b": F.lit("ship")}
    params = F.struct(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("pack_id"), F.lit("Suppliers").alias("title"), F.lit("0.1.0").alias("version"),
        F.lit("ordering").alias("type"), F.concat(F.col("s_name"), F.lit(" ships")).alias("description"), F.when(F.col("s_suppkey") % 2 == 0, "").alias("formal_rule"), F.lit("high").alias("severity"), params.alias("params"),
    )


_PACKS = "WITH r AS (SELECT 'nation' || s_nationkey AS pack_id, s_name || ' ships' AS description, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE replace(s_name, '#', '_') END AS tool_a FROM supplier), ok AS (SELECT * FROM r WHERE regexp_full_match(tool_a, '[A-Za-z_][A-Za-z0-9_./-]{0,127}'))"


@query(f"{_PACKS} SELECT pack_id, 'Suppliers' AS title, '0.1.0' AS version, count(*) AS n_rules, 'ordering' AS types FROM ok GROUP BY pack_id")
def pack_catalog(spark, sf_dir):
    from rulequarry.schema import params_valid

    return packs.pack_catalog(_nation_packs(spark, sf_dir).filter(params_valid()))


@query(f"""{_PACKS} SELECT pack_id, '0.1.0' AS pack_version, description, tool_a, 'pack(' || pack_id || ').ordering' AS formal_rule, CAST(0.65 AS DOUBLE) AS confidence, CAST(0.7 AS DOUBLE) AS support, CAST(0.7 AS DOUBLE) AS consistency,
  CAST(0.85 AS DOUBLE) AS clarity, 'pending' AS status, 'pack' AS discovered_by FROM ok""")
def packs_installed(spark, sf_dir):
    """Valid rules of packs as pending rules with fixed scores."""
    return packs.install(_nation_packs(spark, sf_dir)).select("pack_id", "pack_version", "description", "params.tool_a", "formal_rule", "confidence", "support", "consistency", "clarity", "status", "discovered_by")


@query(f"""{_ALL}, j AS (SELECT type, CASE WHEN confidence < 0.6 THEN 'rejected' WHEN confidence < 0.8 THEN 'pending' ELSE 'active' END AS status FROM s)
SELECT 'status' AS field, v.status AS value, count(j.status) AS n FROM (VALUES ('pending'), ('active'), ('rejected')) v(status) LEFT JOIN j ON j.status = v.status GROUP BY v.status
UNION ALL SELECT 'type', type, count(*) FROM j GROUP BY type""")
def mined_counts(spark, sf_dir):
    """How many candidates of each status, zeros included, and of each type."""
    rows = candidates.scored(union_of_miners(spark, sf_dir)).groupBy("type", "status").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([("pending", 0), ("active", 0), ("rejected", 0)], "value string, n long")
    by_status = rows.select(F.col("status").alias("value"), "n").unionByName(every).groupBy("value").agg(F.sum("n").alias("n")).select(F.lit("status").alias("field"), "value", "n")
    return by_status.unionByName(rows.groupBy(F.col("type").alias("value")).agg(F.sum("n").alias("n")).select(F.lit("type").alias("field"), "value", "n"))


_D = "CAST({} AS DOUBLE)"


@query(f"""WITH {EVENTS}, n AS (SELECT segment AS cluster_id, count(*) AS n FROM tr GROUP BY ALL), f AS (SELECT segment AS cluster_id, trace_id, tool, min(ti) AS a FROM st GROUP BY ALL),
d AS (SELECT x.cluster_id, x.tool AS tool_a, y.tool AS tool_b, count(*) FILTER (WHERE x.a < y.a) AS forward, count(*) AS pairs, count(*) FILTER (WHERE x.a < y.a AND y.a - x.a <= 5) AS near FROM f x JOIN f y USING (trace_id) WHERE x.tool <> y.tool GROUP BY ALL),
lat AS (SELECT segment AS cluster_id, tool, CAST(ceil(quantile_cont(CAST(latency_ms AS DOUBLE), 0.99) / 50) * 50 AS BIGINT) AS threshold FROM st GROUP BY ALL HAVING count(latency_ms) >= 20),
found AS (
  SELECT cluster_id, 'ordering' AS type, 'The agent always calls `' || tool_a || '` before calling `' || tool_b || '`' AS description, round(CAST(forward AS DOUBLE) / n, 4) AS support, round(CAST(forward AS DOUBLE) / pairs, 4) AS consistency,
    CASE WHEN near >= 0.8 * forward THEN 'high' ELSE 'medium' END AS severity FROM d JOIN n USING (cluster_id) WHERE CAST(forward AS DOUBLE) / n >= {_D.format(0.6)} AND CAST(forward AS DOUBLE) / pairs >= {_D.format(0.9)}
  UNION ALL SELECT l.cluster_id, 'statistical', 'Latency of `' || l.tool || '` stays under ' || l.threshold || ' ms', {_D.format(1)}, round(avg(CASE WHEN s.latency_ms <= l.threshold THEN {_D.format(1)} ELSE {_D.format(0)} END), 4), 'low' FROM lat l JOIN st s ON s.segment = l.cluster_id AND s.tool = l.tool GROUP BY l.cluster_id, l.tool, l.threshold
  UNION ALL SELECT segment, 'statistical', '`' || tool || '` succeeds in 95% of its calls or more', {_D.format(1)}, round(avg(CASE WHEN status = 'success' THEN {_D.format(1)} ELSE {_D.format(0)} END), 4), 'medium' FROM st GROUP BY segment, tool
    HAVING count(*) >= 20 AND avg(CASE WHEN status = 'success' THEN {_D.format(1)} ELSE {_D.format(0)} END) >= {_D.format(0.95)}
  UNION ALL SELECT cluster_id, 'negative', 'The agent calls only these tools: `' || string_agg(tool, ', ' ORDER BY tool) || '`', {_D.format(1)}, {_D.format(1)}, 'high' FROM (
    SELECT cluster_id, tool, count(*) AS c, n FROM f JOIN n USING (cluster_id) GROUP BY ALL) WHERE n >= 30 AND c >= greatest(1, floor({_D.format(0.005)} * n)) GROUP BY cluster_id
  UNION ALL SELECT cluster_id, 'ordering', description, support, support, 'medium' FROM ({ORACLES['mine_chains_per_cluster']})
  UNION ALL SELECT cluster_id, 'statistical', 'The feature `' || feature || '` stays within its usual range', {_D.format(1)}, round(within_rate, 4), 'low' FROM ({ORACLES['mine_envelopes_per_cluster']})
  UNION ALL SELECT cluster_id, 'conditional', 'The agent calls `' || tool || '` when the input mentions `' || keyword || '`', round(lift, 4), round(lift, 4), 'medium' FROM ({ORACLES['mine_conditional_per_cluster']})),
s AS (SELECT *, CAST(round(CAST({_D.format(0.4)} * support + {_D.format(0.3)} * consistency + {_D.format(0.1)} * {clarity_sql('description')} AS DECIMAL(18, 9)), 4) AS DOUBLE) AS confidence FROM found)
SELECT cluster_id, type, description, support, consistency, severity, confidence, CASE WHEN confidence < 0.8 THEN 'pending' ELSE 'active' END AS status FROM s WHERE confidence >= 0.6""")
def mine_per_cluster(spark, sf_dir):
    """All miners on every cluster at once: the cluster is one more key of each aggregate, so no cluster is a job of its own.

    Orderings, latencies, success rates, repertoires, chains and envelopes of event traces, whose clusters are the segments, and
    conditionals of documents, whose clusters are the sources."""
    steps = event_steps(spark, sf_dir).withColumnRenamed("segment", "cluster_id")
    one = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    said = lambda *parts: F.concat(*[F.lit(p) if k % 2 == 0 else F.col(p).cast("string") for k, p in enumerate(parts)])

    def rule(rows, kind, text, support, consistency, severity):
        return rows.select("cluster_id", F.lit(kind).alias("type"), text.alias("description"), F.round(support, 4).alias("support"), F.round(consistency, 4).alias("consistency"), severity.alias("severity"))

    calls = F.sort_array(F.collect_list(F.struct("ts", "event_id", "tool")))
    traces = steps.groupBy("cluster_id", "trace_id").agg(calls.alias("calls")).select("cluster_id", F.expr("transform(calls, c -> c.tool)").alias("tools"))
    traces = traces.withColumn("firsts", F.expr("transform(array_distinct(tools), t -> named_struct('tool', t, 'a', array_position(tools, t)))"))
    n = traces.groupBy("cluster_id").agg(F.count("*").alias("n"))
    # of each pair of tools of a trace: which comes first, and how far apart
    pairs = traces.select("cluster_id", F.expr("explode(flatten(transform(firsts, x -> transform(filter(firsts, y -> y.tool <> x.tool), y -> named_struct('tool_a', x.tool, 'tool_b', y.tool, 'gap', y.a - x.a)))))").alias("p"))
    d = pairs.groupBy("cluster_id", "p.tool_a", "p.tool_b").agg(F.count_if(F.col("p.gap") > 0).alias("forward"), F.count("*").alias("pairs"), F.count_if(F.col("p.gap").between(1, 5)).alias("near")).join(n, "cluster_id")
    d = d.withColumns({"support": F.col("forward") / F.col("n"), "consistency": F.col("forward") / F.col("pairs")}).filter("support >= 0.6D AND consistency >= 0.9D")
    lat = steps.groupBy("cluster_id", "tool").agg(F.percentile("latency_ms", F.lit(0.99)).alias("p99"), F.count("latency_ms").alias("m")).filter("m >= 20")
    lat = lat.select("cluster_id", "tool", (F.ceil(F.col("p99") / 50) * 50).cast("long").alias("threshold"))
    within = steps.join(lat, ["cluster_id", "tool"]).groupBy("cluster_id", "tool", "threshold").agg(one(F.col("latency_ms") <= F.col("threshold")).alias("rate"))
    success = steps.groupBy("cluster_id", "tool").agg(F.count("*").alias("m"), one(F.col("status") == "success").alias("rate")).filter("m >= 20 AND rate >= 0.95D")
    used = traces.select("cluster_id", F.explode("firsts.tool").alias("tool")).groupBy("cluster_id", "tool").agg(F.count("*").alias("c")).join(n, "cluster_id")
    used = used.filter("n >= 30 AND c >= greatest(1, floor(0.005D * n))").groupBy("cluster_id").agg(F.array_join(F.sort_array(F.collect_list("tool")), ", ").alias("tools"))
    found = [
        rule(d, "ordering", said("The agent always calls `", "tool_a", "` before calling `", "tool_b", "`"), F.col("support"), F.col("consistency"), F.when(F.expr("near >= 0.8D * forward"), "high").otherwise("medium")),
        rule(within, "statistical", said("Latency of `", "tool", "` stays under ", "threshold", " ms"), F.lit(1.0), F.col("rate"), F.lit("low")),
        rule(success, "statistical", said("`", "tool", "` succeeds in 95% of its calls or more"), F.lit(1.0), F.col("rate"), F.lit("medium")),
        rule(used, "negative", said("The agent calls only these tools: `", "tools", "`"), F.lit(1.0), F.lit(1.0), F.lit("high")),
        rule(clusters.mine_chains_per_cluster(spark, sf_dir), "ordering", F.col("description"), F.col("support"), F.col("support"), F.lit("medium")),
        rule(clusters.mine_envelopes_per_cluster(spark, sf_dir), "statistical", said("The feature `", "feature", "` stays within its usual range"), F.lit(1.0), F.col("within_rate"), F.lit("low")),
        rule(clusters.mine_conditional_per_cluster(spark, sf_dir), "conditional", said("The agent calls `", "tool", "` when the input mentions `", "keyword", "`"), F.col("lift"), F.col("lift"), F.lit("medium")),
    ]
    rows = candidates.scored(reduce(DataFrame.unionByName, found).withColumn("track", F.lit("statistical"))).filter("status <> 'rejected'")
    return rows.select("cluster_id", "type", "description", "support", "consistency", "severity", "confidence", "status")
