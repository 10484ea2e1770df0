"""Start and end callbacks of runs, paired to steps: the same function for tables and for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulequarry.schema import STEP

TIMEOUT_S = 3600


def numbered(callbacks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Callbacks (kind start, end or error) that carry no run id, with one: a start opens the next run of its key, ends belong to the last one opened.

    Ends before any start get none. A column run_id is replaced.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.count_if(F.col("kind") == "start").over(w)
    return callbacks.withColumn("run_id", F.when(run > 0, F.concat_ws(":", *[F.col(c).cast("string") for c in by], run.cast("string"))))


def paired(callbacks: DataFrame, timeout_s: int = TIMEOUT_S, late: str = "1 hour") -> DataFrame:
    """callbacks (run_id, kind, at, tool) -> run_id, tool, started_at, latency_ms, result_status: a row for each start.

    The first end or error of a run, not before its start and at most timeout_s after it, closes it; a run without one is a
    timeout, with null latency. Ends without a start give no row. On a stream, rows may come up to `late` late; a timeout is
    known once the watermark has passed it, and a repeated end is dropped by the run's state.
    """
    at = F.col("at").cast("timestamp")
    rows = callbacks.withColumn("at", at).filter("run_id IS NOT NULL")
    if callbacks.isStreaming:
        rows = rows.withWatermark("at", late)
    starts = rows.filter("kind = 'start'").select("run_id", "tool", F.col("at").alias("started_at"))
    ends = rows.filter("kind IN ('end', 'error')").select(F.col("run_id").alias("__run"), F.col("at").alias("__until"), F.col("kind").alias("__kind"))
    if callbacks.isStreaming:
        starts, ends = starts.dropDuplicatesWithinWatermark(["run_id"]), ends.dropDuplicatesWithinWatermark(["__run"])
    else:
        first = F.min(F.struct("__until", "__kind")).alias("e")
        starts = starts.groupBy("run_id").agg(F.min(F.struct("started_at", "tool")).alias("s")).select("run_id", "s.tool", "s.started_at")
        ends = ends.groupBy("__run").agg(first).select("__run", "e.*")
    within = (F.col("__until") >= F.col("started_at")) & (F.col("__until") <= F.col("started_at") + F.expr(f"INTERVAL {timeout_s} SECONDS"))
    found = starts.join(ends, (F.col("run_id") == F.col("__run")) & within, "left_outer")
    status = F.when(F.col("__kind") == "end", "success").when(F.col("__kind") == "error", "error").otherwise("timeout")
    latency = F.floor((F.unix_micros("__until") - F.unix_micros("started_at")) / 1000).cast("int")
    return found.select("run_id", "tool", "started_at", latency.alias("latency_ms"), status.alias("result_status"))


def traces(paired_runs: DataFrame, trace_of: Column) -> DataFrame:
    """Paired runs as traces: tool calls in order of their starts (equal ones by run), by a column that names the trace."""
    call = F.struct("started_at", "run_id", F.struct(F.lit("tool_call").alias("type"), F.lit(None).cast("string").alias("content"), "tool", "latency_ms", "result_status").cast(STEP).alias("step"))
    grouped = paired_runs.groupBy(trace_of.alias("trace_id")).agg(F.sort_array(F.collect_list(call)).alias("calls"))
    return grouped.select("trace_id", F.col("calls")[0]["started_at"].alias("started_at"), F.transform("calls", lambda c: c["step"]).alias("steps"))
