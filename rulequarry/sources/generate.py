"""Synthetic traces: every value follows from the row's number and a seed, so any partitioning gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _roll(seed: int, *parts: Column | int) -> Column:
    """A number in [0, 1) for each row and set of parts."""
    return F.pmod(F.xxhash64(F.lit(seed), *[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1_000_003)) / 1_000_003.0


def _call(tool: str | Column, roll: Column, base: int) -> Column:
    name = F.lit(tool) if isinstance(tool, str) else tool
    return F.struct(
        F.lit("tool_call").alias("type"), F.lit(None).cast("string").alias("content"), name.alias("tool"), (F.lit(base) + F.floor(roll * 100)).cast("int").alias("latency_ms"), F.when(roll > 0.97, "error").otherwise("success").alias("result_status")
    )


def _said(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("content"), F.lit(None).cast("string").alias("tool"), F.lit(None).cast("int").alias("latency_ms"), F.lit(None).cast("string").alias("result_status"))


def _traces(rows: DataFrame, steps: Column) -> DataFrame:
    return rows.select(
        F.concat(F.lit("trace-"), F.col("id").cast("string")).alias("trace_id"),
        F.concat(F.lit("session-"), F.floor(F.col("id") / 3).cast("string")).alias("session_id"),
        F.lit("v1").alias("version"),
        F.col("segment"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60).cast("timestamp_ntz").alias("started_at"),
        steps.alias("steps"),
    )


def booking_agent(ids: DataFrame, seed: int = 7) -> DataFrame:
    """A trace of a booking agent for each id: validation and session first, a refund branch, else a booking with a payment tool that follows the segment."""
    rows = ids.select("id").withColumns({"r": _roll(seed, F.col("id"), 1), "segment": F.element_at(F.array(F.lit("us"), F.lit("eu"), F.lit("jp")), F.floor(_roll(seed, F.col("id"), 2) * 3).cast("int") + 1)})
    refund = F.col("r") < 0.15
    text = F.when(refund, "I need a refund for my order").otherwise(F.element_at(F.array(*[F.lit(t) for t in ("Book a flight to Lisbon", "Find me a cheap hotel", "Reserve two seats")]), F.floor(F.col("r") * 3).cast("int") + 1))
    pay = F.when(F.col("segment") == "eu", "payments_v2").otherwise("payments_v1")
    call = lambda tool, k, base: _call(tool, _roll(seed, F.col("id"), k), base)
    head = [_said("user_input", text), call("validate_input", 11, 20), call("load_session", 12, 40)]
    tail = _said("agent_response", F.lit("Done."))
    steps = F.when(refund, F.array(*head, call("lookup_order", 13, 80), call("escalate_human", 14, 150), tail)).otherwise(F.array(*head, call("search_flights", 15, 200), call("check_inventory", 16, 90), call(pay, 17, 250), call("create_order", 18, 120), tail))
    return _traces(rows, steps)


def tool_loops(spark: SparkSession, n: int, tools: list[str], least: int = 1, most: int = 8, error_rate: float = 0.05, seed: int = 7) -> DataFrame:
    """Traces of an agent that loops over tools: least to most calls drawn from `tools`, some of them failing."""
    rows = spark.range(n).withColumns({"segment": F.lit(None).cast("string"), "k": (F.lit(least) + F.floor(_roll(seed, F.col("id"), 1) * (most - least + 1))).cast("int")})
    names = F.array(*[F.lit(t) for t in tools])

    def step(i: Column) -> Column:
        made = _call(F.element_at(names, F.floor(_roll(seed, F.col("id"), i) * len(tools)).cast("int") + 1), _roll(seed, F.col("id"), i, 3), 50)
        return made.withField("result_status", F.when(_roll(seed, F.col("id"), i, 4) < error_rate, "error").otherwise("success"))

    return _traces(rows, F.concat(F.array(_said("user_input", F.lit("Carry out the task"))), F.transform(F.sequence(F.lit(1), F.col("k")), step)))


def from_spec(spark: SparkSession, n: int, name: str, purpose: str, tools: list[str], inputs: list[str] | None = None, segments: list[str] | None = None, length: tuple[int, int] = (3, 8), seed: int = 13) -> DataFrame:
    """Traces of an agent described by its tools: a request drawn from inputs, then calls drawn from tools so that all steps
    number length[0] to length[1] (with no more calls than tools), one call in a hundred failing, and an answer."""
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), F.floor(_roll(seed, F.col("id"), k) * len(values)).cast("int") + 1)
    inputs, segments = inputs or [f"Help me with {purpose}"], segments or ["default"]
    calls = F.least(F.lit(len(tools)), F.lit(length[0]) + F.floor(_roll(seed, F.col("id"), 1) * (length[1] - length[0] + 1)) - 2).cast("int")
    rows = spark.range(n).withColumns({"segment": pick(segments, 2), "request": pick(inputs, 3), "k": calls})
    names = F.array(*[F.lit(t) for t in tools])

    def step(i: Column) -> Column:
        made = _call(F.element_at(names, F.floor(_roll(seed, F.col("id"), i, 4) * len(tools)).cast("int") + 1), _roll(seed, F.col("id"), i, 5), 0)
        late = (F.lit(30) + F.floor(_roll(seed, F.col("id"), i, 6) * 771)).cast("int")
        return made.withField("latency_ms", late).withField("result_status", F.when(_roll(seed, F.col("id"), i, 7) < 0.01, "error").otherwise("success"))

    middle = F.when(F.col("k") > 0, F.transform(F.sequence(F.lit(1), F.col("k")), step)).otherwise(F.array().cast("array<struct<type: string, content: string, tool: string, latency_ms: int, result_status: string>>"))
    out = _traces(rows, F.concat(F.array(_said("user_input", F.col("request"))), middle, F.array(_said("agent_response", F.lit(f"Done with {purpose}.")))))
    return out.withColumns({"session_id": F.lit(name.lower().replace(" ", "-")), "version": F.lit("synthetic-v1")})
