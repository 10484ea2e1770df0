"""JSON payloads of several shapes -> canonical traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulequarry.schema import STEP


def _has(payload: Column, key: str) -> Column:
    return F.get_json_object(payload, f"$.{key}").isNotNull()


def detect_format(payload: Column | str) -> Column:
    p = F.col(payload) if isinstance(payload, str) else payload
    return F.when(_has(p, "nodes") & _has(p, "edges"), "dag").when(_has(p, "run_type") | _has(p, "child_runs"), "langchain").otherwise("raw_json")


def timestamp(text: Column | str) -> Column:
    """ISO text (with Z or an offset) or seconds since 1970; null if neither."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.timestamp_micros((c.cast("double") * 1e6).cast("long"))), F.try_to_timestamp(c))


def user_input(inputs: Column) -> Column:
    """The first filled field of a request, or the last user message of a list."""
    fields = [F.nullif(F.get_json_object(inputs, f"$.{k}"), F.lit("")) for k in ("input", "question", "query", "prompt")]
    given = F.get_json_object(inputs, "$.messages")
    messages = F.from_json(given, "array<struct<role: string, content: string>>")
    last = F.try_element_at(F.filter(messages, lambda m: m["content"].isNotNull() & (m["role"].isNull() | m["role"].isin("user", "human"))), F.lit(-1))["content"]
    # messages as plain strings
    plain = F.try_element_at(F.from_json(given, "array<string>"), F.lit(-1))
    plain = F.when(~plain.startswith("{"), plain)
    text = F.when(~inputs.startswith("{") & ~inputs.startswith("["), inputs)
    return F.coalesce(*fields, last, plain, text)


def response(outputs: Column) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(outputs, f"$.{k}"), F.lit("")) for k in ("output", "answer", "result", "response", "content")])


def raw_json(payloads: DataFrame) -> DataFrame:
    """payload (JSON text with steps) -> traces; rows without steps have an error and no trace."""
    steps = F.from_json(F.get_json_object("payload", "$.steps"), f"array<{STEP}>")
    return payloads.select(
        F.coalesce(F.get_json_object("payload", "$.trace_id"), F.substring(F.sha2("payload", 256), 1, 32)).alias("trace_id"),
        F.get_json_object("payload", "$.session_id").alias("session_id"),
        F.get_json_object("payload", "$.metadata.version").alias("version"),
        F.get_json_object("payload", "$.metadata.user_segment").alias("segment"),
        timestamp(F.get_json_object("payload", "$.timestamp")).cast("timestamp_ntz").alias("started_at"),
        steps.alias("steps"),
        F.when(steps.isNull(), "payload has no steps").alias("error"),
    )


def langchain(payloads: DataFrame) -> DataFrame:
    """payload (a tree of runs as JSON) -> traces: request, then tools and thoughts by start time (equal or none: in their order), then response.

    A payload that is null or no JSON object has an error and no steps.
    """
    import json

    import pandas as pd

    def flatten(batches):
        for batch in batches:
            out = []
            for payload in batch["payload"]:
                try:
                    root = json.loads(payload)
                    if not isinstance(root, dict):
                        raise ValueError("payload is no object")
                except (TypeError, ValueError) as e:
                    out.append({"root": None, "runs": "[]", "payload": payload, "error": f"payload is no run tree: {type(e).__name__}"})
                    continue
                runs, stack = [], [root]
                while stack:  # a run before its children, children in their order
                    run = stack.pop()
                    runs.append(run)
                    stack.extend(r for r in reversed(run.get("child_runs") or []) if isinstance(r, dict))
                inner = sorted(runs[1:], key=lambda r: str(r.get("start_time") or ""))
                kept = [r for r in inner if r.get("run_type") in ("tool", "llm")]
                out.append({"root": json.dumps(root, default=str), "runs": json.dumps(kept, default=str), "payload": payload, "error": None})
            yield pd.DataFrame(out, columns=["root", "runs", "payload", "error"])

    run = "struct<name: string, run_type: string, start_time: string, end_time: string, error: string, outputs: string>"
    flat = payloads.select("payload").mapInPandas(flatten, "root string, runs string, payload string, error string").withColumn("runs", F.from_json("runs", f"array<{run}>"))
    millis = lambda r: F.greatest(F.lit(0), (F.unix_micros(timestamp(r["end_time"])) - F.unix_micros(timestamp(r["start_time"]))) / 1000).cast("int")

    def step(r):
        is_tool = r["run_type"] == "tool"
        return F.struct(
            F.when(is_tool, "tool_call").otherwise("agent_thought").alias("type"),
            F.when(~is_tool, response(r["outputs"])).alias("content"),
            F.when(is_tool, r["name"]).alias("tool"),
            F.when(is_tool, millis(r)).alias("latency_ms"),
            F.when(is_tool, F.when(r["error"].isNotNull(), "error").otherwise("success")).alias("result_status"),
        )

    def edge(kind: str, text: Column) -> Column:
        one = F.struct(F.lit(kind).alias("type"), text.alias("content"), F.lit(None).cast("string").alias("tool"), F.lit(None).cast("int").alias("latency_ms"), F.lit(None).cast("string").alias("result_status"))
        return F.filter(F.array(one), lambda s: s["content"].isNotNull())

    root = F.col("root")
    return flat.select(
        F.coalesce(F.get_json_object(root, "$.id"), F.substring(F.sha2("payload", 256), 1, 32)).alias("trace_id"),
        F.get_json_object(root, "$.session_id").alias("session_id"),
        F.lit(None).cast("string").alias("version"),
        F.lit(None).cast("string").alias("segment"),
        timestamp(F.get_json_object(root, "$.start_time")).cast("timestamp_ntz").alias("started_at"),
        F.when(F.col("error").isNull(), F.concat(edge("user_input", user_input(F.get_json_object(root, "$.inputs"))), F.transform("runs", step), edge("agent_response", response(F.get_json_object(root, "$.outputs"))))).alias("steps"),
        "error",
    )


def dag(payloads: DataFrame) -> DataFrame:
    from rulequarry.operators.graphs import linearise

    return linearise(payloads)


NORMALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {"raw_json": raw_json, "langchain": langchain, "dag": dag}


def normalise(payloads: DataFrame, kind: str = "auto") -> DataFrame:
    """Traces of all payloads; auto sends each to the normaliser of its detected format."""
    if kind != "auto":
        if kind not in NORMALISERS:
            raise ValueError(f"unknown format {kind!r}; known: {', '.join(NORMALISERS)}")
        return NORMALISERS[kind](payloads)
    found = payloads.withColumn("__format", detect_format("payload"))
    first, *rest = [f(found.filter(F.col("__format") == name).drop("__format")) for name, f in NORMALISERS.items()]
    for other in rest:
        first = first.unionByName(other)
    return first
