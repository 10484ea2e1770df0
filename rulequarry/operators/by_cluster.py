"""Miners of all clusters at once: the cluster is a key of every aggregate, so none is a job of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sizes(sequences: DataFrame) -> DataFrame:
    return sequences.groupBy("cluster_id").agg(F.count("*").alias("n"))


def frequent_subsequences(sequences: DataFrame, min_support: float = 0.6, most: int = 3) -> DataFrame:
    """(cluster_id, tools), a row a trace -> cluster_id, pattern, n_traces, n: each cluster's patterns of up to `most` tools, gaps allowed.

    A pattern is frequent from max(1, floor(min_support * n)) of its cluster's n traces on. Patterns grow a tool at a time from
    where their first match in a trace ends, so a trace has each of them once; only frequent ones grow. A level is an aggregate by
    cluster and pattern with partial counts, which a hot cluster doesn't skew, and a join with the patterns kept, of which there
    are at most 1 / min_support times the tools of a trace in each cluster.
    """
    n = sizes(sequences)
    tools = F.filter("tools", lambda t: t.isNotNull())
    rows = sequences.select("cluster_id", tools.alias("tools"), F.array().cast("array<string>").alias("pattern"), F.lit(0).alias("end"))
    out = None
    for level in range(1, most + 1):
        rest = F.expr("slice(tools, end + 1, size(tools))")
        grown = rows.withColumn("rest", rest).withColumn("next", F.explode(F.array_distinct("rest")))
        rows = grown.select("cluster_id", "tools", F.concat("pattern", F.array("next")).alias("pattern"), (F.col("end") + F.array_position("rest", F.col("next"))).cast("int").alias("end"))
        counts = _beside(rows.groupBy("cluster_id", "pattern").agg(F.count("*").alias("n_traces")), n)
        kept = counts.filter(F.col("n_traces") >= F.greatest(F.lit(1), F.floor(F.lit(min_support) * F.col("n"))))
        out = kept if out is None else out.unionByName(kept)
        if level < most:
            known = kept.select(F.col("cluster_id").alias("__c"), F.col("pattern").alias("__p"))
            rows = rows.join(known, F.col("cluster_id").eqNullSafe(F.col("__c")) & (F.col("pattern") == F.col("__p")), "left_semi")
    return out


def _beside(rows: DataFrame, n: DataFrame) -> DataFrame:
    """Rows with their cluster's n; a null cluster is one."""
    return rows.join(n.withColumnRenamed("cluster_id", "__c"), F.col("cluster_id").eqNullSafe(F.col("__c"))).drop("__c")


def closed_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns of two tools or more that no longer one of their cluster with the same count contains."""
    long = patterns.filter("size(pattern) >= 2")
    other = long.select(F.col("cluster_id").alias("__c"), F.col("pattern").alias("larger"), F.col("n_traces").alias("__n"))
    contains = F.expr("cluster_id <=> __c AND n_traces = __n AND size(larger) > size(pattern) AND aggregate(larger, 0, (k, t) -> IF(k < size(pattern) AND t = get(pattern, k), k + 1, k)) = size(pattern)")
    return long.join(other, contains, "left_anti")


def envelopes(features: DataFrame, least: float = 0.95) -> DataFrame:
    """cluster_id, trace_id and numeric features -> cluster_id, feature, p1, p99, median, within_rate of those that are stable in a cluster.

    The 1st and 99th percentiles come from counts by value, cumulated in order, so no task holds a cluster's values in a buffer.
    """
    from pyspark.sql import Window

    names = [c for c in features.columns if c not in ("cluster_id", "trace_id")]
    u = features.select("cluster_id", F.expr(f"stack({len(names)}, {', '.join(f"'{f}', CAST({f} AS double)" for f in names)}) AS (feature, v)")).filter("v IS NOT NULL")
    counts = u.groupBy("cluster_id", "feature", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("cluster_id", "feature")
    ranked = counts.withColumns({"upto": F.sum("c").over(w.orderBy("v")), "n": F.sum("c").over(w)})

    def at(rank):
        """The value at a rank from 0 on."""
        return F.min(F.when(F.col("upto") > rank, F.col("v")))

    ranks = {q: F.lit(q) * (F.col("n") - 1) for q in (0.01, 0.99, 0.5)}
    ends = ranked.groupBy("cluster_id", "feature").agg(*[f.alias(f"{side}{k}") for k, q in enumerate(ranks) for side, f in (("low", at(F.floor(ranks[q]))), ("high", at(F.ceil(ranks[q]))))], F.max("n").alias("n"))
    between = lambda k, q: F.col(f"low{k}") + (F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))) * (F.col(f"high{k}") - F.col(f"low{k}"))
    p = ends.select(F.col("cluster_id").alias("__c"), F.col("feature").alias("__f"), *[between(k, q).alias(name) for k, (q, name) in enumerate(zip(ranks, ("p1", "p99", "median")))])
    p = p.filter("p99 - p1 >= 1e-6 AND NOT (median = 0 AND p99 < 5)")
    met = counts.join(p, F.col("cluster_id").eqNullSafe(F.col("__c")) & (F.col("feature") == F.col("__f")))
    inside = F.sum(F.when(F.col("v").between(F.col("p1"), F.col("p99")), F.col("c")).otherwise(0)) / F.sum("c")
    return met.groupBy("cluster_id", "feature", "p1", "p99", "median").agg(inside.alias("within_rate")).filter(F.col("within_rate") >= least)


def contingency(rows: DataFrame, least: int = 10) -> DataFrame:
    """cluster_id, keywords and tools (distinct arrays of a trace) -> counts of a cluster's traces by keyword and tool, for keywords of `least` of its traces or more.

    As for all traces together, a row of an empty keyword stands for each trace, and traces are counted by keyword and set of
    tools first; what follows reads counts.
    """
    from pyspark.sql import Window

    c = rows.select("cluster_id", F.explode(F.concat("keywords", F.array(F.lit("")))).alias("keyword"), F.sort_array("tools").alias("tools")).groupBy("cluster_id", "keyword", "tools").agg(F.count("*").alias("c"))
    each = c.filter("keyword = ''")
    n = each.groupBy("cluster_id").agg(F.sum("c").alias("n"))
    tools = each.select(F.col("cluster_id").alias("__c"), F.explode("tools").alias("__t"), "c").groupBy("__c", "__t").agg(F.sum("c").alias("nt"))
    some = c.filter("keyword <> ''").withColumn("nk", F.sum("c").over(Window.partitionBy("cluster_id", "keyword"))).filter(F.col("nk") >= least)
    both = some.select("cluster_id", "keyword", "nk", F.explode("tools").alias("tool"), "c").groupBy("cluster_id", "keyword", "nk", "tool").agg(F.sum("c").alias("n11"))
    both = both.join(tools, F.col("cluster_id").eqNullSafe(F.col("__c")) & (F.col("tool") == F.col("__t"))).drop("__c", "__t")
    return _beside(both, n).select("cluster_id", "keyword", "tool", "n11", (F.col("nk") - F.col("n11")).alias("n10"), (F.col("nt") - F.col("n11")).alias("n01"), (F.col("n") - F.col("nk") - F.col("nt") + F.col("n11")).alias("n00"), "n")
