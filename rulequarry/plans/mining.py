"""Mining queries: repertoires, distributions, associations, fingerprints, sessions, graphs, calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rulequarry.operators import by_cluster, features, graphs
from rulequarry.plans.projection import SHAPED, shaped
from rulequarry.plans.registry import query
from rulequarry.sources.views import EVENTS, document_traces, event_steps, event_traces, table

# ---- repertoire, deny list, distributions -----------------------------------------------------


@query(f"""WITH {EVENTS}, c AS (SELECT tool, count(DISTINCT trace_id) AS n_traces FROM st GROUP BY tool), n AS (SELECT count(*) AS n FROM tr)
SELECT tool, n_traces, n_traces >= greatest(1, CAST(floor(CAST(0.005 AS DOUBLE) * n) AS BIGINT)) AND n >= 30 AS allowed FROM c, n""")
def mine_repertoire(spark, sf_dir):
    steps = event_steps(spark, sf_dir).select("trace_id", "tool").distinct()
    per_tool = steps.groupBy("tool").agg(F.count("*").alias("n_traces"))
    n = steps.select("trace_id").distinct().agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(1), F.floor(F.lit(0.005) * F.col("n")))
    return per_tool.crossJoin(F.broadcast(n)).select("tool", "n_traces", ((F.col("n_traces") >= least) & (F.col("n") >= 30)).alias("allowed"))


@query(f"""WITH {EVENTS}, p AS (SELECT tool, quantile_cont(CAST(latency_ms AS DOUBLE), 0.99) AS p99, count(*) AS samples FROM st GROUP BY tool HAVING count(*) >= 20),
t AS (SELECT *, CAST(ceil(p99 / 50) * 50 AS BIGINT) AS threshold FROM p)
SELECT tool, round(p99, 6) AS p99, samples, threshold, avg(CASE WHEN latency_ms <= threshold THEN 1.0 ELSE 0.0 END) AS within_rate FROM t JOIN st USING (tool) GROUP BY ALL""")
def latency_p99(spark, sf_dir):
    steps = event_steps(spark, sf_dir).select("tool", "latency_ms").filter("latency_ms IS NOT NULL")
    # the exact percentile needs one buffer of distinct values for each tool; latencies are whole milliseconds, so it is bounded by their range
    p = steps.groupBy("tool").agg(F.percentile("latency_ms", F.lit(0.99)).alias("p99"), F.count("*").alias("samples")).filter("samples >= 20")
    p = p.withColumn("threshold", (F.ceil(F.col("p99") / 50) * 50).cast("long"))
    within = F.avg(F.when(F.col("latency_ms") <= F.col("threshold"), 1.0).otherwise(0.0)).alias("within_rate")
    return steps.join(p, "tool").groupBy("tool", F.round("p99", 6).alias("p99"), "samples", "threshold").agg(within)


@query(f"WITH {EVENTS} SELECT tool, count(*) AS calls, avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END) AS rate, count(*) >= 20 AND avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END) >= 0.95 AS kept FROM st GROUP BY tool")
def success_rate(spark, sf_dir):
    rate = F.avg(F.when(F.col("status") == "success", 1.0).otherwise(0.0))
    return event_steps(spark, sf_dir).groupBy("tool").agg(F.count("*").alias("calls"), rate.alias("rate")).withColumn("kept", (F.col("calls") >= 20) & (F.col("rate") >= 0.95))


_FEATURES = ("step_count", "tool_count", "distinct_tools", "user_chars", "response_chars", "sum_latency", "max_latency", "error_count")


@query(f"""WITH {EVENTS}, b AS (SELECT trace_id, count(*) + 1 AS step_count, count(*) AS tool_count, count(DISTINCT tool) AS distinct_tools, 18 AS user_chars, 0 AS response_chars, sum(latency_ms) AS sum_latency, max(latency_ms) AS max_latency,
  count(*) FILTER (WHERE status <> 'success') AS error_count FROM st GROUP BY trace_id),
u AS (UNPIVOT (SELECT trace_id, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in _FEATURES)} FROM b) ON {', '.join(_FEATURES)} INTO NAME feature VALUE v),
p AS (SELECT feature, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.99) AS p99, quantile_cont(v, 0.5) AS median FROM u GROUP BY feature)
SELECT feature, round(p1, 6) AS p1, round(p99, 6) AS p99, round(median, 6) AS median, avg(CASE WHEN v BETWEEN p1 AND p99 THEN 1.0 ELSE 0.0 END) AS within_rate FROM p JOIN u USING (feature) WHERE p99 - p1 >= 1e-6 AND NOT (median = 0 AND p99 < 5) GROUP BY ALL HAVING avg(CASE WHEN v BETWEEN p1 AND p99 THEN 1.0 ELSE 0.0 END) >= 0.95""")
def feature_envelope(spark, sf_dir):
    rows = features.behavioral(event_traces(spark, sf_dir)).withColumn("cluster_id", F.lit("all"))
    return by_cluster.envelopes(rows).select("feature", *[F.round(c, 6).alias(c) for c in ("p1", "p99", "median")], "within_rate")


# ---- associations -----------------------------------------------------------------------------

_ASSOC = """WITH kw AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_]{2,}'))) AS keyword FROM documents),
tl AS (SELECT doc_id, 'lang_' || lang AS tool FROM documents UNION ALL SELECT doc_id, source FROM documents),
n AS (SELECT count(*) AS n FROM documents),
k AS (SELECT keyword, count(*) AS nk FROM kw GROUP BY keyword HAVING count(*) >= 10), t AS (SELECT tool, count(*) AS nt FROM tl GROUP BY tool),
c AS (SELECT keyword, tool, count(*) AS n11 FROM kw JOIN tl USING (doc_id) GROUP BY ALL),
cont AS (SELECT keyword, tool, n11, nk - n11 AS n10, nt - n11 AS n01, n - nk - nt + n11 AS n00, n FROM c JOIN k USING (keyword) JOIN t USING (tool), n),
stat AS (SELECT *, CASE WHEN (n11+n10)*(n01+n00)*(n11+n01)*(n10+n00) = 0 THEN CAST(0 AS DOUBLE) ELSE n * pow(CAST(n11 AS DOUBLE)*n00 - CAST(n10 AS DOUBLE)*n01, 2) / (CAST(n11+n10 AS DOUBLE)*(n01+n00)*(n11+n01)*(n10+n00)) END AS chi2,
  greatest(CAST(0 AS DOUBLE), """ + " + ".join(
    f"CASE WHEN {a} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({a} AS DOUBLE) / n * log2(CAST(n AS DOUBLE) * {a} / (CAST({r} AS DOUBLE) * ({c}))) END"
    for a, r, c in (("n11", "n11+n10", "n11+n01"), ("n10", "n11+n10", "n10+n00"), ("n01", "n01+n00", "n11+n01"), ("n00", "n01+n00", "n10+n00"))
) + ") AS mi FROM cont)"


def contingency(rows, least=10):
    """(keywords, tools), distinct arrays of a trace -> counts of traces by keyword and tool, for keywords of `least` traces or more.

    One pass: traces are counted by keyword and set of tools, and an empty keyword stands for each trace itself, so what follows
    reads counts only: keywords are cut before sets are taken apart, and nothing is joined by trace. The counts are one
    exchange for all three uses; conditions on its keys name a count too, and sets are taken apart with their nulls, as they would else be moved before it.
    """
    c = rows.select(F.explode(F.concat("keywords", F.array(F.lit("")))).alias("keyword"), F.sort_array("tools").alias("tools")).groupBy("keyword", "tools").agg(F.count("*").alias("c"))
    own = F.when(F.col("keyword") == "", F.col("c")).otherwise(0)
    n = c.agg(F.sum(own).alias("n"))
    tools = c.select(F.explode_outer("tools").alias("tool"), own.alias("c")).groupBy("tool").agg(F.sum("c").alias("nt"))
    some = c.withColumn("nk", F.sum("c").over(Window.partitionBy("keyword"))).filter((F.col("nk") >= least) & ((F.col("keyword") != "") | (F.col("c") < 0)))
    both = some.select("keyword", "nk", F.explode_outer("tools").alias("tool"), "c").groupBy("keyword", "nk", "tool").agg(F.sum("c").alias("n11")).join(tools, "tool")
    return both.crossJoin(F.broadcast(n)).select("keyword", "tool", "n11", (F.col("nk") - F.col("n11")).alias("n10"), (F.col("nt") - F.col("n11")).alias("n01"), (F.col("n") - F.col("nk") - F.col("nt") + F.col("n11")).alias("n00"), "n")


def with_statistics(c):
    d = lambda e: F.expr(e)
    # the product of four margins is beyond a long from some 110,000 traces on, so it is made of doubles; it is zero if a factor is
    chi = d("CASE WHEN CAST(n11+n10 AS double)*(n01+n00)*(n11+n01)*(n10+n00) = 0 THEN 0D ELSE n * pow(CAST(n11 AS double)*n00 - CAST(n10 AS double)*n01, 2) / (CAST(n11+n10 AS double)*(n01+n00)*(n11+n01)*(n10+n00)) END")
    parts = [("n11", "n11+n10", "n11+n01"), ("n10", "n11+n10", "n10+n00"), ("n01", "n01+n00", "n11+n01"), ("n00", "n01+n00", "n10+n00")]
    mi = d("greatest(0D, " + " + ".join(f"CASE WHEN {a} = 0 THEN 0D ELSE CAST({a} AS double) / n * log2(CAST(n AS double) * {a} / (CAST({r} AS double) * ({k}))) END" for a, r, k in parts) + ")")
    return c.withColumns({"chi2": chi, "mi": mi})


def _contingency(spark, sf_dir):
    text = "steps[0].content"
    rows = document_traces(spark, sf_dir).select(features.user_tokens(text).alias("keywords"), F.array_distinct(features.tool_sequence()).alias("tools"))
    return contingency(rows)


@query(f"{_ASSOC} SELECT keyword, tool, n11, n10, n01, n00 FROM cont")
def assoc_contingency(spark, sf_dir):
    return _contingency(spark, sf_dir).drop("n")


@query(f"{_ASSOC} SELECT keyword, tool, round(mi, 6) AS mi, round(chi2, 6) AS chi2 FROM stat")
def assoc_mi(spark, sf_dir):
    return with_statistics(_contingency(spark, sf_dir)).select("keyword", "tool", F.round("mi", 6).alias("mi"), F.round("chi2", 6).alias("chi2"))


_LIFT = "CAST(n11 AS DOUBLE) / (n11 + n10) - CASE WHEN n01 + n00 = 0 THEN 0 ELSE CAST(n01 AS DOUBLE) / (n01 + n00) END"


@query(f"""{_ASSOC} SELECT keyword, tool, n11, round({_LIFT}, 6) AS lift, round(mi, 6) AS mi FROM stat
WHERE n11 + n10 < CAST(floor(CAST(0.8 AS DOUBLE) * n) AS BIGINT) AND CAST(n11 AS DOUBLE) / n >= 0.05 AND round(mi, 6) >= 0.05 AND round(chi2, 6) >= 6.63 AND round({_LIFT}, 6) >= 0.2""")
def mine_conditional(spark, sf_dir):
    lift = F.round(F.expr(_LIFT.replace("DOUBLE", "double")), 6)
    s = with_statistics(_contingency(spark, sf_dir)).withColumn("lift", lift)
    kept = s.filter("n11 + n10 < floor(0.8D * n) AND CAST(n11 AS double) / n >= 0.05D AND round(mi, 6) >= 0.05D AND round(chi2, 6) >= 6.63D AND lift >= 0.2D")
    return kept.select("keyword", "tool", "n11", "lift", F.round("mi", 6).alias("mi"))


# ---- fingerprints -----------------------------------------------------------------------------


@query(f"{SHAPED} SELECT version, fingerprint, count(*) AS n FROM fp GROUP BY ALL")
def fingerprint_counts(spark, sf_dir):
    return shaped(spark, sf_dir).groupBy("version", "fingerprint").agg(F.count("*").alias("n"))


_DRIFT = f"""{SHAPED}, o AS (SELECT fingerprint, count(*) AS o FROM fp WHERE version = 'v2' GROUP BY 1), b AS (SELECT fingerprint, count(*) AS b FROM fp WHERE version = 'v1' GROUP BY 1),
j AS (SELECT coalesce(o.fingerprint, b.fingerprint) AS fingerprint, coalesce(o, 0) AS o, coalesce(b, 0) AS b FROM o FULL JOIN b ON o.fingerprint = b.fingerprint),
t AS (SELECT sum(o) AS so, sum(b) AS sb, count(*) AS k FROM j),
q AS (SELECT *, (o + CAST(0.5 AS DOUBLE)) / (so + CAST(0.5 AS DOUBLE) * k) AS po, (b + CAST(0.5 AS DOUBLE)) / (sb + CAST(0.5 AS DOUBLE) * k) AS pb FROM j, t)"""


def _drift(spark, sf_dir):
    counts = shaped(spark, sf_dir).groupBy("fingerprint").agg(F.sum(F.when(F.col("version") == "v2", 1).otherwise(0)).alias("o"), F.sum(F.when(F.col("version") == "v1", 1).otherwise(0)).alias("b"))
    t = counts.agg(F.sum("o").alias("so"), F.sum("b").alias("sb"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(t)).withColumns({"po": F.expr("(o + 0.5D) / (so + 0.5D * k)"), "pb": F.expr("(b + 0.5D) / (sb + 0.5D * k)")})


@query(f"{_DRIFT} SELECT greatest(CAST(0 AS DOUBLE), round(sum(po * log2(po / pb)), 6)) AS kl, round(sum(pow(o - pb * so, 2) / (pb * so)), 6) AS chi2, CAST(max(so) AS BIGINT) AS n, max(so) >= 50 AND round(sum(pow(o - pb * so, 2) / (pb * so)), 6) > 13.82 AS drifting FROM q")
def fingerprint_drift(spark, sf_dir):
    out = _drift(spark, sf_dir).agg(F.greatest(F.lit(0.0), F.round(F.expr("sum(po * log2(po / pb))"), 6)).alias("kl"), F.round(F.expr("sum(pow(o - pb * so, 2) / (pb * so))"), 6).alias("chi2"), F.max("so").cast("long").alias("n"))
    return out.withColumn("drifting", (F.col("n") >= 50) & (F.col("chi2") > 13.82))


@query(f"{SHAPED} SELECT DISTINCT fingerprint FROM fp WHERE version = 'v2' AND fingerprint NOT IN (SELECT fingerprint FROM fp WHERE version = 'v1')")
def novel_fingerprints(spark, sf_dir):
    return shaped(spark, sf_dir).groupBy("fingerprint").agg(F.min("version").alias("low")).filter("low = 'v2'").select("fingerprint")


@query(f"{_DRIFT} SELECT fingerprint, CAST(o AS BIGINT) AS observed, CAST(b AS BIGINT) AS baseline FROM j ORDER BY o DESC, fingerprint LIMIT 10")
def top_fingerprints(spark, sf_dir):
    return _drift(spark, sf_dir).orderBy(F.desc("o"), "fingerprint").limit(10).select("fingerprint", F.col("o").cast("long").alias("observed"), F.col("b").cast("long").alias("baseline"))


# ---- sessions ---------------------------------------------------------------------------------

_SESS = f"{SHAPED}, o AS (SELECT session_id, fingerprint, started_at, trace_id, lead(fingerprint) OVER w AS next_fp, row_number() OVER (PARTITION BY session_id ORDER BY started_at DESC, trace_id DESC) AS back FROM fp WINDOW w AS (PARTITION BY session_id ORDER BY started_at, trace_id))"


def _sessions(spark, sf_dir):
    w = Window.partitionBy("session_id")
    return shaped(spark, sf_dir).select("session_id", "fingerprint", F.lead("fingerprint").over(w.orderBy("started_at", "trace_id")).alias("next_fp"), F.row_number().over(w.orderBy(F.desc("started_at"), F.desc("trace_id"))).alias("back"))


@query(f"{_SESS}, p AS (SELECT fingerprint, next_fp, count(*) AS n, count(DISTINCT session_id) AS sessions FROM o WHERE next_fp IS NOT NULL GROUP BY ALL) SELECT fingerprint, next_fp, n, sessions, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY fingerprint) AS probability FROM p")
def session_transitions(spark, sf_dir):
    p = _sessions(spark, sf_dir).filter("next_fp IS NOT NULL").groupBy("fingerprint", "next_fp").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))
    return p.withColumn("probability", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("fingerprint")))


@query(f"{_SESS} SELECT fingerprint, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(DISTINCT session_id) FROM fp) AS share FROM o WHERE back = 1 GROUP BY fingerprint")
def session_terminations(spark, sf_dir):
    last = _sessions(spark, sf_dir).filter("back = 1")
    total = last.agg(F.count("*").alias("total"))
    return last.groupBy("fingerprint").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("fingerprint", "n", (F.col("n").cast("double") / F.col("total")).alias("share"))


_CAPS = f"""WITH {EVENTS}, s AS (SELECT session_id, min(ts) AS t FROM st GROUP BY session_id), r AS (SELECT session_id, row_number() OVER (ORDER BY t, session_id) - 1 AS k FROM s), n AS (SELECT count(*) AS n FROM s),
c AS (SELECT session_id, tool, count(*) AS c FROM st GROUP BY ALL), f AS (SELECT tool, min(k) AS first_k FROM c JOIN r USING (session_id) GROUP BY tool),
g AS (SELECT f.tool, r.session_id, coalesce(c.c, 0) AS c FROM f JOIN r ON r.k >= f.first_k LEFT JOIN c ON c.tool = f.tool AND c.session_id = r.session_id),
a AS (SELECT tool, list(c ORDER BY c) AS cs, count(*) AS m FROM g GROUP BY tool HAVING count(*) >= 10),
u AS (SELECT tool, m, cs[least(m - 1, CAST(floor(CAST(0.99 AS DOUBLE) * m) AS BIGINT)) + 1] AS upper, cs[m // 2 + 1] AS median, cs FROM a)"""


@query(f"{_CAPS} SELECT tool, m AS n_sessions, CAST(upper AS BIGINT) AS upper, CAST(median AS BIGINT) AS median, CAST(len(list_filter(cs, lambda x: x <= upper)) AS DOUBLE) / m AS within_rate FROM u")
def session_tool_caps(spark, sf_dir):
    """How often a tool is called in a session, sessions from the first that calls it on; the counts are few, so a histogram of them gives every order statistic."""
    steps = event_steps(spark, sf_dir)
    s = steps.groupBy("session_id").agg(F.min("ts").alias("t")).withColumn("day", F.to_date("t"))
    c = steps.groupBy("session_id", "tool").agg(F.count("*").alias("c"))
    first = c.join(s, "session_id").groupBy("tool").agg(F.min(F.struct("t", "session_id")).alias("first"), F.count("*").alias("with_calls")).withColumn("day", F.to_date("first.t"))
    # sessions of later days come from counts by day, those of the same day from a join on it
    days = s.groupBy("day").agg(F.count("*").alias("n"))
    later = first.join(F.broadcast(days.select(F.col("day").alias("other"), "n")), F.col("other") > F.col("day"), "left").groupBy("tool").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("later"))
    same = s.join(first.select("day", "tool", "first"), "day").filter(F.struct("t", "session_id") >= F.col("first")).groupBy("tool").agg(F.count("*").alias("same"))
    f = first.select("tool", "with_calls").join(later, "tool").join(same, "tool").withColumn("m", F.col("later") + F.col("same"))
    zero = f.select("tool", F.lit(0).cast("long").alias("c"), (F.col("m") - F.col("with_calls")).alias("times"))
    h = c.groupBy("tool", "c").agg(F.count("*").alias("times")).unionByName(zero).filter("times > 0").join(f.select("tool", "m"), "tool").filter("m >= 10")
    h = h.withColumn("cum", F.sum("times").over(Window.partitionBy("tool").orderBy("c")))
    upper = F.min(F.when(F.col("cum") > F.least(F.col("m") - 1, F.floor(F.lit(0.99) * F.col("m"))), F.struct("c", "cum")))
    median = F.min(F.when(F.col("cum") > F.floor(F.col("m") / 2), F.col("c")))
    out = h.groupBy("tool", "m").agg(upper.alias("u"), median.alias("median"))
    return out.select("tool", F.col("m").alias("n_sessions"), F.col("u.c").alias("upper"), "median", (F.col("u.cum").cast("double") / F.col("m")).alias("within_rate"))


# ---- graphs -----------------------------------------------------------------------------------

_DAG = f"""WITH {EVENTS}, nodes AS (SELECT trace_id, ti AS node, tool FROM st),
edges AS (SELECT trace_id, ti - 1 AS source, ti AS target, CASE WHEN status = 'error' THEN 'conditional' ELSE 'sequential' END AS kind FROM st WHERE ti > 0
  UNION ALL SELECT trace_id, ti - 2, ti, CASE WHEN event_id % 5 = 0 THEN 'loop' ELSE 'spawn' END FROM st WHERE ti > 1 AND event_id % 3 = 0 UNION ALL SELECT trace_id, ti, ti + 100, 'data' FROM st WHERE event_id % 50 = 0),
et AS (SELECT e.*, a.tool AS source_tool, b.tool AS target_tool FROM edges e JOIN nodes a ON a.trace_id = e.trace_id AND a.node = e.source JOIN nodes b ON b.trace_id = e.trace_id AND b.node = e.target)"""


def _dag(spark, sf_dir):
    st = event_steps(spark, sf_dir).withColumn("ti", F.row_number().over(Window.partitionBy("trace_id").orderBy("ts", "event_id")) - 1)
    nodes = st.select("trace_id", F.col("ti").alias("node"), "tool")
    chain = st.filter("ti > 0").select("trace_id", (F.col("ti") - 1).alias("source"), F.col("ti").alias("target"), F.when(F.col("status") == "error", "conditional").otherwise("sequential").alias("kind"))
    skip = st.filter("ti > 1 AND event_id % 3 = 0").select("trace_id", (F.col("ti") - 2).alias("source"), F.col("ti").alias("target"), F.when(F.col("event_id") % 5 == 0, "loop").otherwise("spawn").alias("kind"))
    dangling = st.filter("event_id % 50 = 0").select("trace_id", F.col("ti").alias("source"), (F.col("ti") + 100).alias("target"), F.lit("data").alias("kind"))
    return nodes, chain.unionByName(skip).unionByName(dangling)


@query(f"{_DAG} SELECT source_tool, kind, target_tool, count(DISTINCT trace_id) AS n_traces FROM et WHERE kind <> 'loop' GROUP BY ALL")
def dag_edges(spark, sf_dir):
    nodes, edges = _dag(spark, sf_dir)
    return graphs.frequent_edges(graphs.edge_tools(edges, nodes))


@query(f"{_DAG} SELECT trace_id, CAST(source AS INTEGER) AS source, CAST(target AS INTEGER) AS target, kind, source_tool, target_tool FROM et")
def dag_edge_tools(spark, sf_dir):
    nodes, edges = _dag(spark, sf_dir)
    return graphs.edge_tools(edges, nodes).select("trace_id", "source", "target", "kind", "source_tool", "target_tool")


@query(f"""{_DAG.replace('WITH ', 'WITH RECURSIVE ', 1)}, walk AS (SELECT trace_id, node AS at, tool AS path, 0 AS d FROM nodes UNION ALL
  SELECT w.trace_id, e.target, w.path || '>' || e.target_tool, d + 1 FROM walk w JOIN et e ON e.trace_id = w.trace_id AND e.source = w.at WHERE d < 4 AND e.kind <> 'loop')
SELECT path, count(DISTINCT trace_id) AS n_traces FROM walk WHERE d > 0 GROUP BY path""")
def dag_paths(spark, sf_dir):
    nodes, edges = _dag(spark, sf_dir)
    return graphs.frequent_paths(edges, nodes)


@query(f"""{_DAG}, k AS (SELECT trace_id, source, source_tool, string_agg(target_tool, ',' ORDER BY target_tool) AS children FROM et WHERE kind <> 'loop' GROUP BY ALL HAVING count(*) >= 2)
SELECT source_tool, children, count(DISTINCT trace_id) AS n_traces FROM k GROUP BY ALL""")
def dag_forks(spark, sf_dir):
    nodes, edges = _dag(spark, sf_dir)
    return graphs.frequent_forks(graphs.edge_tools(edges, nodes))


@query(f"{_DAG}, k AS (SELECT trace_id, source, count(*) AS n, bool_or(kind = 'loop') AS l FROM edges GROUP BY ALL) SELECT trace_id, max(n) > 1 AS has_branching, bool_or(l) AS has_loops FROM k GROUP BY trace_id")
def dag_flags(spark, sf_dir):
    return graphs.flags(_dag(spark, sf_dir)[1])


@query(f"WITH {EVENTS} SELECT trace_id, CAST(ti AS INTEGER) AS source, CAST(ti + 1 AS INTEGER) AS target FROM st")
def dag_from_linear(spark, sf_dir):
    return graphs.lift(event_traces(spark, sf_dir))


_ROUTE = """WITH RECURSIVE n AS (SELECT l_orderkey AS o, l_linenumber AS id, strftime(l_shipdate, '%Y-%m-%d') AS at, l_partkey % 7 + 1 AS target, l_suppkey % 10 = 0 AS loop FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) = 1),
k AS (SELECT n.o, n.id, n.at, list(p.id) FILTER (WHERE p.id IS NOT NULL) AS needs FROM n LEFT JOIN n p ON p.o = n.o AND p.target = n.id AND NOT p.loop GROUP BY ALL),
r AS (SELECT DISTINCT o, CAST([] AS INTEGER[]) AS done, 0 AS i FROM n
  UNION ALL SELECT o, list_append(done, next), i + 1 FROM (
    SELECT r.o, r.done, r.i, arg_min(k.id, (k.at, k.id)) AS next FROM r JOIN k ON k.o = r.o
    WHERE NOT list_contains(r.done, k.id) AND (k.needs IS NULL OR len(list_filter(k.needs, lambda x: NOT list_contains(r.done, x))) = 0) GROUP BY r.o, r.done, r.i)),
f AS (SELECT o, arg_max(done, i) AS done FROM r GROUP BY o), a AS (SELECT o, list(id ORDER BY id) AS ids FROM n GROUP BY o)
SELECT CAST(o AS VARCHAR) AS trace_id, array_to_string(done || list_filter(ids, lambda x: NOT list_contains(done, x)), '>') AS steps FROM f JOIN a USING (o)"""


@query(_ROUTE)
def dag_linearise(spark, sf_dir):
    """An order's line numbers as a graph payload, each line pointing at one line, its steps in topological order by ship date; loops
    and dangling edges don't count, and what is on a cycle or behind one comes last in its own order."""
    first = F.min(F.struct("l_shipdate", "l_partkey", "l_suppkey")).alias("l")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(first).select("l_orderkey", "l_linenumber", "l.*").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("at"), (F.col("l_partkey") % 7 + 1).alias("target"), (F.col("l_suppkey") % 10 == 0).alias("loop"))
    node = F.struct(F.col("l_linenumber").alias("id"), F.col("at").alias("started_at"), F.struct(F.lit("tool_call").alias("type"), F.col("l_linenumber").cast("string").alias("tool")).alias("step"))
    edge = F.struct(F.col("l_linenumber").alias("source"), "target", F.when(F.col("loop"), "loop").otherwise("sequential").alias("kind"))
    graph = lines.groupBy(F.col("l_orderkey").cast("string").alias("trace_id")).agg(F.sort_array(F.collect_list(node)).alias("nodes"), F.sort_array(F.collect_list(edge)).alias("edges"))
    found = graphs.linearise(graph.select(F.to_json(F.struct("trace_id", "nodes", "edges")).alias("payload")))
    return found.select("trace_id", F.array_join(F.transform("steps", lambda s: s["tool"]), ">").alias("steps"))


# ---- calibration, versions --------------------------------------------------------------------


@query(f"""{SHAPED} SELECT count(*) AS n_traces, count(DISTINCT fingerprint) AS n_fingerprints, (SELECT count(DISTINCT tool) FROM st) AS n_tools, quantile_cont(CAST(len(tools) + 1 AS DOUBLE), 0.5) AS median_steps,
  round(quantile_cont(CAST(len(tools) + 1 AS DOUBLE), 0.99), 6) AS p99_steps, quantile_cont(CAST(len(tools) AS DOUBLE), 0.5) AS median_calls FROM fp""")
def calib_summary(spark, sf_dir):
    rows = shaped(spark, sf_dir)
    tools = event_steps(spark, sf_dir).agg(F.countDistinct("tool").alias("n_tools"))
    n = F.size("steps")
    out = rows.agg(F.count("*").alias("n_traces"), F.countDistinct("fingerprint").alias("n_fingerprints"), F.percentile(n, F.lit(0.5)).alias("median_steps"), F.round(F.percentile(n, F.lit(0.99)), 6).alias("p99_steps"), F.percentile(n - 1, F.lit(0.5)).alias("median_calls"))
    return out.crossJoin(F.broadcast(tools)).select("n_traces", "n_fingerprints", "n_tools", "median_steps", "p99_steps", "median_calls")


@query(f"""{SHAPED}, s AS (SELECT count(*) AS n, count(DISTINCT fingerprint) AS k, avg(CASE WHEN list_contains(statuses, 'error') THEN 1.0 ELSE 0.0 END) AS err, quantile_cont(CAST(len(tools) AS DOUBLE), 0.5) AS med FROM fp)
SELECT CAST(least(6, greatest(2, CAST(floor(med / 2) AS BIGINT))) AS BIGINT) AS max_path, CAST(greatest(5, CAST(floor(CAST(0.05 AS DOUBLE) * n) AS BIGINT)) AS BIGINT) AS min_keyword, round(8 * (1 + CAST(k AS DOUBLE) / n), 6) AS page_hinkley,
  round(4 * (1 + CAST(k AS DOUBLE) / n), 6) AS cusum, round(least(CAST(0.15 AS DOUBLE), greatest(CAST(0.01 AS DOUBLE), CAST(1.5 AS DOUBLE) * err)), 6) AS contamination FROM s""")
def calibrate(spark, sf_dir):
    """Thresholds that follow from how varied the traces are; with under 30 traces the defaults."""
    rows = shaped(spark, sf_dir)
    bad = F.avg(F.expr("CASE WHEN exists(steps, s -> s.result_status = 'error') THEN 1D ELSE 0D END"))
    s = rows.agg(F.count("*").alias("n"), F.countDistinct("fingerprint").alias("k"), bad.alias("err"), F.percentile(F.size("steps") - 1, F.lit(0.5)).alias("med"))
    few = F.col("n") < 30
    new = F.lit(1.0) + F.col("k").cast("double") / F.col("n")
    return s.select(
        F.when(few, 4).otherwise(F.least(F.lit(6), F.greatest(F.lit(2), F.floor(F.col("med") / 2)))).cast("long").alias("max_path"),
        F.when(few, 10).otherwise(F.greatest(F.lit(5), F.floor(F.lit(0.05) * F.col("n")))).cast("long").alias("min_keyword"),
        F.when(few, 8.0).otherwise(F.round(8 * new, 6)).alias("page_hinkley"),
        F.when(few, 4.0).otherwise(F.round(4 * new, 6)).alias("cusum"),
        F.when(few, 0.05).otherwise(F.round(F.least(F.lit(0.15), F.greatest(F.lit(0.01), 1.5 * F.col("err"))), 6)).alias("contamination"),
    )


@query("""WITH c AS (SELECT p_brand AS k, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, k) - 1 AS i, count(*) OVER () AS m, min(n) OVER () AS low, max(n) OVER () AS high FROM c),
d AS (SELECT *, round((n - low) / CAST(high - low AS DOUBLE) - (1 - i / CAST(m - 1 AS DOUBLE)), 6) AS d FROM r) SELECT CAST(min(i) AS BIGINT) AS elbow, CAST(arg_min(n, i) AS BIGINT) AS support FROM d WHERE d = (SELECT max(d) FROM d)""")
def calib_elbow(spark, sf_dir):
    """Where a falling curve of counts bends most above its chord."""
    c = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    e = c.agg(F.count("*").alias("m"), F.min("n").alias("low"), F.max("n").alias("high"))
    r = c.withColumn("i", F.row_number().over(Window.orderBy(F.desc("n"), "p_brand")) - 1).crossJoin(F.broadcast(e))
    d = r.withColumn("d", F.expr("round((n - low) / CAST(high - low AS double) - (1 - i / CAST(m - 1 AS double)), 6)"))
    return d.agg(F.max(F.struct("d", (-F.col("i")).alias("back"), "n")).alias("x")).select((-F.col("x.back")).cast("long").alias("elbow"), F.col("x.n").alias("support"))


@query("""WITH p AS (SELECT CAST(p_partkey % 97 AS DOUBLE) / 970 AS p, p_partkey AS k FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS m FROM p)
SELECT CAST(coalesce(max(i) FILTER (WHERE p <= i / CAST(m AS DOUBLE) * CAST(0.05 AS DOUBLE)), 0) AS BIGINT) AS rejected FROM r""")
def bh_fdr(spark, sf_dir):
    """How many p-values the Benjamini-Hochberg rule rejects, from cumulated counts of equal p-values."""
    p = table(spark, sf_dir, "part").select(((F.col("p_partkey") % 97).cast("double") / 970).alias("p"))
    counts = p.groupBy("p").agg(F.count("*").alias("c"))
    m = counts.agg(F.sum("c").alias("m"))
    r = counts.withColumn("i", F.sum("c").over(Window.orderBy("p"))).crossJoin(F.broadcast(m))
    return r.agg(F.coalesce(F.max(F.when(F.expr("p <= i / CAST(m AS double) * 0.05D"), F.col("i"))), F.lit(0)).cast("long").alias("rejected"))


#: The upper 1% points of chi-squared by degrees of freedom.
CHI2_01 = {1: 6.63, 2: 9.21, 3: 11.34, 4: 13.28, 5: 15.09, 6: 16.81, 7: 18.48, 8: 20.09, 9: 21.67, 10: 23.21, 15: 30.58, 20: 37.57, 25: 44.31, 30: 50.89}


_POINTS = "(1, 6.63), (2, 9.21), (3, 11.34), (4, 13.28), (5, 15.09), (6, 16.81), (7, 18.48), (8, 20.09), (9, 21.67), (10, 23.21), (15, 30.58), (20, 37.57), (25, 44.31), (30, 50.89)"


@query(f"""WITH t(k, v) AS (VALUES {_POINTS}), x AS (SELECT p_brand AS brand, greatest(1, (count(DISTINCT p_size) - 1) * (count(DISTINCT p_type) - 1)) AS df FROM part GROUP BY ALL
  UNION ALL SELECT 'nation ' || s_nationkey, count(*) FROM supplier GROUP BY ALL),
lo AS (SELECT brand, df, max(k) AS a, arg_max(v, k) AS va FROM x JOIN t ON k <= df GROUP BY ALL), hi AS (SELECT brand, min(k) AS b, arg_min(v, k) AS vb FROM x JOIN t ON k >= df GROUP BY ALL)
SELECT brand, df, round(CASE WHEN df > 30 THEN df * pow(1 - 2 / (9 * CAST(df AS DOUBLE)) + CAST(2.326348 AS DOUBLE) * sqrt(2 / (9 * CAST(df AS DOUBLE))), 3)
  ELSE CAST(va AS DOUBLE) + (CAST(vb AS DOUBLE) - CAST(va AS DOUBLE)) * (df - a) / greatest(1, b - a) END, 6) AS critical FROM lo LEFT JOIN hi USING (brand)""")
def chi2_critical(spark, sf_dir):
    """The 1% points for the degrees of freedom of each brand's table of sizes by types, and of as many as a nation has suppliers."""
    part = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.greatest(F.lit(1), (F.countDistinct("p_size") - 1) * (F.countDistinct("p_type") - 1)).alias("df"))
    nations = table(spark, sf_dir, "supplier").groupBy(F.format_string("nation %d", "s_nationkey").alias("brand")).agg(F.count("*").alias("df"))
    return part.unionByName(nations).select("brand", "df", F.round(chi2_point("df"), 6).alias("critical"))


def chi2_point(df: str):
    """The 1% point by degrees of freedom: table values, linear between them, Wilson and Hilferty's formula above 30."""
    known = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in CHI2_01.items()])
    n = F.col(df)
    low, high = F.element_at(F.filter(known, lambda t: t["k"] <= n), -1), F.coalesce(F.get(F.filter(known, lambda t: t["k"] >= n), F.lit(0)), F.element_at(known, -1))
    root = F.lit(2.0) / (F.lit(9.0) * n)
    return F.when(n > 30, n * F.pow(F.lit(1.0) - root + F.lit(2.326348) * F.sqrt(root), F.lit(3))).otherwise(low["v"] + (high["v"] - low["v"]) * (n - low["k"]) / F.greatest(F.lit(1), high["k"] - low["k"]))


@query(f"WITH {EVENTS} SELECT segment, tool, count(*) AS calls, count(DISTINCT trace_id) AS n_traces, round(quantile_cont(CAST(latency_ms AS DOUBLE), 0.99), 6) AS p99, avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END) AS rate FROM st GROUP BY ALL")
def mine_per_segment(spark, sf_dir):
    """All of a segment's distributions in one pass, with the segment among the keys."""
    return event_steps(spark, sf_dir).groupBy("segment", "tool").agg(F.count("*").alias("calls"), F.countDistinct("trace_id").alias("n_traces"), F.round(F.percentile("latency_ms", F.lit(0.99)), 6).alias("p99"), F.avg(F.when(F.col("status") == "success", 1.0).otherwise(0.0)).alias("rate"))


@query(f"WITH {EVENTS} SELECT version, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools, min(ts) AS first_seen, max(ts) AS last_seen FROM st GROUP BY version")
def version_registry(spark, sf_dir):
    return event_steps(spark, sf_dir).groupBy("version").agg(F.array_join(F.sort_array(F.collect_set("tool")), ",").alias("tools"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query(f"WITH {EVENTS} SELECT session_id, arg_max(version, ts) AS active_version FROM st GROUP BY session_id")
def active_version(spark, sf_dir):
    return event_steps(spark, sf_dir).groupBy("session_id").agg(F.max_by("version", "ts").alias("active_version"))
