"""Trace graphs: lifting, flags, frequent edges, paths and forks, and linear order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lift(traces: DataFrame) -> DataFrame:
    """A linear trace as a chain: (trace_id, source, target) of neighbouring steps."""
    return traces.select("trace_id", F.explode(F.expr("transform(sequence(1, size(steps) - 1), i -> named_struct('source', i - 1, 'target', i))")).alias("e")).select("trace_id", "e.source", "e.target")


def flags(edges: DataFrame) -> DataFrame:
    """(trace_id, source, target, kind) -> whether a trace branches, and whether it has loops."""
    out = edges.groupBy("trace_id", "source").agg(F.count("*").alias("n"), F.max((F.col("kind") == "loop").cast("int")).alias("loop"))
    return out.groupBy("trace_id").agg((F.max("n") > 1).alias("has_branching"), (F.max("loop") == 1).alias("has_loops"))


def edge_tools(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the tools of both ends; dangling edges and ends that are no tool calls go."""
    a = nodes.select("trace_id", F.col("node").alias("source"), F.col("tool").alias("source_tool"))
    b = nodes.select("trace_id", F.col("node").alias("target"), F.col("tool").alias("target_tool"))
    return edges.join(a, ["trace_id", "source"]).join(b, ["trace_id", "target"]).filter("source_tool IS NOT NULL AND target_tool IS NOT NULL")


def frequent_edges(tools: DataFrame) -> DataFrame:
    """(source tool, kind, target tool) -> number of traces, loops left out."""
    return tools.filter("kind <> 'loop'").select("trace_id", "source_tool", "kind", "target_tool").distinct().groupBy("source_tool", "kind", "target_tool").agg(F.count("*").alias("n_traces"))


def frequent_paths(edges: DataFrame, nodes: DataFrame, most: int = 4) -> DataFrame:
    """Tool labels along rooted paths of up to `most` edges (nodes that are no tools pass through) -> number of traces."""
    start = nodes.select("trace_id", F.col("node").alias("at"), F.when(F.col("tool").isNotNull(), F.array("tool")).otherwise(F.array().cast("array<string>")).alias("path"))
    step = edges.filter("kind <> 'loop'").select("trace_id", F.col("source").alias("at"), F.col("target").alias("to"))
    label = nodes.select("trace_id", F.col("node").alias("to"), "tool")
    now, out = start, None
    for _ in range(most):
        now = now.join(step, ["trace_id", "at"]).join(label, ["trace_id", "to"]).select("trace_id", F.col("to").alias("at"), F.when(F.col("tool").isNotNull(), F.concat("path", F.array("tool"))).otherwise(F.col("path")).alias("path"))
        some = now.filter("size(path) >= 2").select("trace_id", F.array_join("path", ">").alias("path"))
        out = some if out is None else out.unionByName(some)
    return out.distinct().groupBy("path").agg(F.count("*").alias("n_traces"))


def frequent_forks(tools: DataFrame, arity: int = 2) -> DataFrame:
    """(parent tool, sorted child tools) of steps with several followers -> number of traces."""
    forks = tools.filter("kind <> 'loop'").groupBy("trace_id", "source", "source_tool").agg(F.sort_array(F.collect_list("target_tool")).alias("children")).filter(F.size("children") >= arity)
    return forks.select("trace_id", "source_tool", F.array_join("children", ",").alias("children")).distinct().groupBy("source_tool", "children").agg(F.count("*").alias("n_traces"))


def linear_order(nodes: list[dict], edges: list[dict]) -> list[int]:
    """Kahn's order by (start, place): loops and dangling edges ignored, nodes on cycles last in their own order."""
    place = {n["id"]: i for i, n in enumerate(nodes)}
    into, follow = [0] * len(nodes), [[] for _ in nodes]
    for e in edges:
        if e.get("kind") != "loop" and e.get("source") in place and e.get("target") in place:
            follow[place[e["source"]]].append(place[e["target"]])
            into[place[e["target"]]] += 1
    import heapq

    key = lambda i: (str(nodes[i].get("started_at") or ""), i)
    ready = [key(i) for i in range(len(nodes)) if not into[i]]
    heapq.heapify(ready)
    out = []
    while ready:
        i = heapq.heappop(ready)[1]
        out.append(i)
        for j in follow[i]:
            into[j] -= 1
            if not into[j]:
                heapq.heappush(ready, key(j))
    seen = set(out)
    return out + [i for i in range(len(nodes)) if i not in seen]


def linearise(payloads: DataFrame) -> DataFrame:
    """payload (nodes and edges as JSON) -> traces with steps in topological order."""
    import json

    import pandas as pd

    from rulequarry.schema import STEP, TRACE

    def order(batches):
        for batch in batches:
            out = []
            for payload in batch["payload"]:
                try:
                    given = json.loads(payload)
                    if not isinstance(given, dict):
                        raise ValueError("payload is no object")
                except (TypeError, ValueError):
                    out.append({"payload": payload, "steps": None})
                    continue
                nodes = given.get("nodes") or []
                steps = [nodes[i].get("step") or {"type": "system", "content": str(nodes[i].get("id"))} for i in linear_order(nodes, given.get("edges") or [])]
                out.append({"payload": payload, "steps": json.dumps(steps)})
            yield pd.DataFrame(out, columns=["payload", "steps"])

    flat = payloads.select("payload").mapInPandas(order, "payload string, steps string")
    names = [c.split(":")[0].strip().split(" ")[0] for c in TRACE.split(", steps")[0].split(", ")]
    made = F.coalesce(F.get_json_object("payload", "$.trace_id"), F.substring(F.sha2("payload", 256), 1, 32))
    return flat.select(made.alias(names[0]), F.get_json_object("payload", "$.session_id").alias("session_id"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("segment"), F.lit(None).cast("timestamp_ntz").alias("started_at"), F.from_json("steps", f"array<{STEP}>").alias("steps"), F.when(F.col("steps").isNull(), "payload is no graph").alias("error"))
