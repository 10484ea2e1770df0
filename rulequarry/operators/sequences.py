"""Frequent subsequences of tools, closed patterns and ordering rules."""

from __future__ import annotations

from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulequarry.operators.candidates import checkpoint_dir


def frequent_subsequences(sequences: DataFrame, min_support: float = 0.6, most: int = 3) -> DataFrame:
    """(trace_id, tools) -> pattern and the number of traces that have it as a subsequence, gaps allowed.

    A pattern is frequent from max(1, floor(min_support * n)) traces on.
    """
    n = sequences.count()
    if not n:
        return sequences.sparkSession.createDataFrame([], "pattern array<string>, n_traces long")
    least = max(1, int(min_support * n))
    items = sequences.select(F.transform("tools", lambda t: F.array(t)).alias("sequence"))
    found = PrefixSpan(minSupport=(least - 0.5) / n, maxPatternLength=most, maxLocalProjDBSize=32_000_000).findFrequentSequentialPatterns(items)
    return found.select(F.transform("sequence", lambda s: s[0]).alias("pattern"), F.col("freq").alias("n_traces"))


def closed_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns of two tools or more that no longer pattern with the same count contains."""
    long = patterns.filter("size(pattern) >= 2")
    other = long.select(F.col("pattern").alias("larger"), "n_traces")
    contains = F.expr("size(larger) > size(pattern) AND aggregate(larger, 0, (k, t) -> IF(k < size(pattern) AND t = get(pattern, k), k + 1, k)) = size(pattern)")
    return long.join(other, (long["n_traces"] == other["n_traces"]) & contains, "left_anti")


def _last_matches(start: Column) -> Column:
    """Where each tool of the pattern is matched last, from its end back, all before start; start itself comes last. Positions count from 1."""
    before = lambda a, t: a[0] - F.array_position(F.reverse(F.slice("tools", 1, a[0] - 1)), t)
    return F.aggregate(F.reverse("pattern"), F.array(start.cast("long")), lambda a, t: F.concat(F.array(before(a, t)), a))


def closed_subsequences(sequences: DataFrame, min_support: float = 0.6) -> DataFrame:
    """(trace_id, tools) -> pattern, n_traces: the closed ones of all frequent subsequences of two tools or more, however long, gaps allowed.

    Frequent as in frequent_subsequences(); closed if no longer pattern with the same count contains it. Equal traces count as one with
    its copies. Patterns grow a tool at a time from where their first match ends, a level after another until none is frequent. A tool that
    every trace with the pattern has in the same gap, between the first match of what is before and the last of what is after, makes a longer pattern
    of the same count. If all have it within the first match too, whatever the pattern grows into has one as well, so it isn't grown: a pattern
    that recurs in few long traces stands for its parts. The number of closed patterns itself may grow as a power of the traces' length.
    """
    checkpoint_dir(sequences.sparkSession)
    same = sequences.groupBy(F.filter("tools", lambda t: t.isNotNull()).alias("tools")).agg(F.count("*").alias("w")).checkpoint()
    n = same.agg(F.sum("w")).first()[0] or 0
    least = max(1, int(min_support * n))
    rows = same.select("tools", "w", F.array().cast("array<string>").alias("pattern"), F.array().cast("array<long>").alias("at"))
    out = None
    while True:
        # at: where the first match has each tool of the pattern
        end = F.coalesce(F.try_element_at("at", F.lit(-1)), F.lit(0))
        grown = rows.withColumn("rest", F.slice("tools", end + 1, F.size("tools"))).withColumn("next", F.explode(F.array_distinct("rest")))
        grown = grown.select("tools", "w", F.concat("pattern", F.array("next")).alias("pattern"), F.concat("at", F.array(end + F.array_position("rest", F.col("next")))).alias("at"))
        counts = grown.groupBy("pattern").agg(F.sum("w").alias("n_traces")).filter(F.col("n_traces") >= least)
        rows = grown.join(counts, "pattern").checkpoint()
        gaps = rows.withColumns({"far": _last_matches(F.size("tools") + 1), "near": _last_matches(F.element_at("at", -1) + 1), "from": F.concat(F.array(F.lit(0).cast("long")), "at")})
        gap = lambda i, ends: F.slice("tools", F.get("from", i) + 1, F.get(ends, i) - F.get("from", i) - 1)
        tools = lambda i: F.transform(F.array_distinct(gap(i, "far")), lambda t: F.struct(i.alias("gap"), t.alias("tool"), F.array_contains(gap(i, "near"), t).alias("near")))
        met = gaps.select("pattern", "n_traces", "w", F.explode_outer(F.flatten(F.transform(F.sequence(F.lit(0), F.size("pattern")), tools))).alias("met"))
        met = met.groupBy("pattern", "n_traces", "met.gap", "met.tool").agg(F.sum(F.when(F.col("met").isNotNull(), F.col("w"))).alias("far"), F.sum(F.when(F.col("met.near"), F.col("w"))).alias("near"))
        under = lambda c: F.coalesce(F.max(c), F.lit(0)) < F.col("n_traces")
        level = met.groupBy("pattern", "n_traces").agg(under("far").alias("closed"), under("near").alias("grows")).checkpoint()
        found = level.filter("closed AND size(pattern) >= 2").select("pattern", "n_traces")
        out = found if out is None else out.unionByName(found)
        grows = level.filter("grows").select("pattern")
        if grows.isEmpty():
            return out
        rows = rows.join(grows, "pattern", "left_semi").drop("n_traces")


def pair_direction(calls: DataFrame, most_gap: int = 5) -> DataFrame:
    """(trace_id, tool, first): for each pair a, b in a trace, which comes first, and how close."""
    a = calls.select("trace_id", F.col("tool").alias("tool_a"), F.col("first").alias("fa"))
    b = calls.select("trace_id", F.col("tool").alias("tool_b"), F.col("first").alias("fb"))
    both = a.join(b, "trace_id").filter("tool_a <> tool_b")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    ahead = F.col("fa") < F.col("fb")
    out = both.groupBy("tool_a", "tool_b").agg(n(ahead).alias("forward"), n(~ahead).alias("backward"), n(ahead & (F.col("fb") - F.col("fa") <= most_gap)).alias("near"))
    return out.withColumns({"directionality": F.col("forward") / (F.col("forward") + F.col("backward")), "gap_consistency": F.when(F.col("forward") > 0, F.col("near") / F.col("forward")).otherwise(0.0)})


def evidence(sequences: DataFrame, patterns: DataFrame, most: int = 50) -> DataFrame:
    """(trace_id, tools), (pattern) -> pattern, ids: the first `most` traces by id that have the pattern as a subsequence.

    Patterns are joined on their first tool.
    """
    from pyspark.sql import Window

    by_first = patterns.select("pattern", F.col("pattern")[0].alias("tool"))
    rows = sequences.select("trace_id", "tools", F.explode(F.array_distinct("tools")).alias("tool")).join(by_first, "tool")
    has = F.expr("aggregate(tools, 0, (k, t) -> IF(k < size(pattern) AND t = get(pattern, k), k + 1, k)) = size(pattern)")
    ranked = rows.filter(has).select("pattern", "trace_id").withColumn("k", F.row_number().over(Window.partitionBy("pattern").orderBy("trace_id"))).filter(F.col("k") <= most)
    return ranked.groupBy("pattern").agg(F.sort_array(F.collect_list("trace_id")).alias("ids"))
