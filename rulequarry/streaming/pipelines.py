"""Structured Streaming forms: ingest, checks, checks by rules that change, windowed pass rates, fingerprint counts, drift state, alert sinks."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rulequarry.operators import checks, features
from rulequarry.operators.alerts import ATTEMPTS, BACKOFF_MS, MOST, SECONDS, TRIED, wait_ms
from rulequarry.operators.drift import EVENT, STATE, Detector
from rulequarry.schema import TRACE


def ingest(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """The traces of JSON-lines files as they come to a folder, at most `files` of them in a micro-batch; a line that is no trace is in _corrupt_record."""
    return spark.readStream.schema(TRACE + ", _corrupt_record string").option("maxFilesPerTrigger", files).json(folder)


def check_live(traces: DataFrame, load_rules, write, checkpoint: str, max_age: float = 30.0, **options):
    """Starts a query that checks each micro-batch by the rules of load_rules(), read again once they are max_age seconds old.

    write(results, number) gets the rows of check_stream() of a batch and must accept a batch again after a restart.
    Lines that were no traces have no results.
    """
    held = {}

    def each(batch: DataFrame, number: int) -> None:
        if not held or time.monotonic() - held["at"] >= max_age:
            held.update(rules=load_rules(), at=time.monotonic())
        rows = batch.filter("trace_id IS NOT NULL")
        write(check_stream(rows, held["rules"]), number)

    return traces.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**options).start()


def outcome_counts(results: DataFrame) -> DataFrame:
    """By rule: checks (those that didn't apply included), failures and warnings."""
    return results.groupBy("rule_id").agg(F.count("*").alias("checked"), F.count_if(F.col("outcome") == "fail").alias("failures"), F.count_if(F.col("outcome") == "warn").alias("warnings"))


def check_stream(traces: DataFrame, rules: DataFrame) -> DataFrame:
    """A stateless projection of a stream of traces: every rule on every trace."""
    return checks.with_each(features.with_features(traces), rules).select("trace_id", "session_id", "started_at", "rule_id", "severity", checks.outcome().alias("outcome"))


def windowed_pass_rate(results: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Pass rates by rule in event-time windows; rows later than `late` are dropped by the watermark."""
    timed = results.withColumn("at", F.col("started_at").cast("timestamp")).withWatermark("at", late).filter("outcome <> 'not_applicable'")
    rate = F.avg(F.when(F.col("outcome") == "pass", 1.0).otherwise(0.0))
    return timed.groupBy(F.window("at", width).alias("w"), "rule_id").agg(F.count("*").alias("n"), rate.alias("pass_rate")).select(F.col("w.start").alias("start"), "rule_id", "n", "pass_rate")


def session_activity(results: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    timed = results.withColumn("at", F.col("started_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap).alias("w"), "session_id").agg(F.count("*").alias("n")).select("session_id", F.col("w.start").alias("start"), "n")


def fingerprint_counts(traces: DataFrame) -> DataFrame:
    return traces.groupBy("version", features.fingerprint().alias("fingerprint")).agg(F.count("*").alias("n"))


def drift(observations: DataFrame) -> DataFrame:
    """(key, ord, x) stream -> drift events; the detectors of a key are its state, kept by the state store across restarts."""

    import pandas as pd

    def fold(key, batches, state: GroupState):
        d = Detector(*state.get) if state.exists else Detector()
        out = []
        # a micro-batch's rows of a key may fill several Arrow batches, which are in no order
        for x in pd.concat(list(batches)).sort_values("ord")["x"]:
            out += [(key[0], d.n, e) for e in d.add(float(x))]
        state.update(d.state())
        yield pd.DataFrame(out, columns=["key", "n", "detector"])

    return observations.groupBy("key").applyInPandasWithState(fold, EVENT, STATE, "append", GroupStateTimeout.NoTimeout)


def alerts(events: DataFrame, send, checkpoint: str):
    """Starts a query that gives each micro-batch's distinct alerts to send(rows); send must accept a batch again after a restart."""

    def each(batch: DataFrame, number: int) -> None:
        send(batch.dropDuplicates(["key", "detector"]))

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def ingest_once(traces: DataFrame, path: str, checkpoint: str, late: str = "1 day", **trigger):
    """Starts a query that puts each trace of a stream into a store exactly once: `path`/traces by version and day, `path`/rejected for lines that are none.

    A trace_id that comes again within `late` of its arrival, in the same file, another one or after a restart, is dropped by the
    query's state; the watermark follows arrival, so a trace is never too late, however old. Each micro-batch is written to folders of its own number and overwrites them, so a batch that is run again after a failure adds nothing.
    A trace without a time counts as of the day it comes.
    """
    rows = traces.withColumns({"__at": F.current_timestamp(), "__key": F.coalesce("trace_id", F.sha2(F.coalesce("_corrupt_record", F.lit("")), 256))})
    rows = rows.withWatermark("__at", late).dropDuplicatesWithinWatermark(["__key"])

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        good = held.filter("trace_id IS NOT NULL").withColumn("dt", F.to_date(F.coalesce(F.col("started_at").cast("timestamp"), "__at"))).drop("__at", "__key", "_corrupt_record")
        good.write.mode("overwrite").partitionBy("version", "dt").parquet(f"{path}/traces/batch={number}")
        held.filter("trace_id IS NULL").select("_corrupt_record").write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")
        held.unpersist()

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """The traces that ingest_once() has stored."""
    return spark.read.option("basePath", f"{path}/traces").parquet(f"{path}/traces/*/").drop("batch")


def drift_sessions(rows: DataFrame, idle: float, late: str = "10 minutes") -> DataFrame:
    """A stream of drift.OBSERVED rows -> drift.DRIFTED events, by state per (agent, rule) that a reset row clears and a timer removes `idle` seconds after its last row.

    A key's rows of a micro-batch are taken in event order; the state store of the session must be RocksDB's.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    from rulequarry.operators.drift import DRIFTED, KEPT, Session

    names = [c.split(" ")[0] for c in KEPT.split(", ")]
    columns = [c.split(" ")[0] for c in DRIFTED.split(", ")]

    class Drift(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.kept = handle, handle.getValueState("drift", KEPT)

        def handleInputRows(self, key, rows, timerValues):
            if self.kept.exists():
                *values, last, resets, expiries = self.kept.get()
                session = Session(Detector(*values), pd.Timestamp(last), resets, expiries)
            else:
                session = Session(Detector())
            out = []
            for _, _, at, _, x, control in pd.concat(list(rows)).sort_values(["at", "ord"]).itertuples(index=False):
                out += [(*key, at, session.detector.n, e) for e in session.row(at, x, control, idle)]
            self.kept.update((*session.detector.state(), session.last.to_pydatetime(), session.resets, session.expiries))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(session.last.timestamp() * 1000 + idle * 1000) + 1)
            yield pd.DataFrame(out, columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.kept.clear()
            yield pd.DataFrame([], columns=columns)

        def close(self) -> None:
            pass

    timed = rows.withWatermark("at", late).select("agent", "rule", "at", "ord", "x", "control")
    return timed.groupBy("agent", "rule").transformWithStateInPandas(statefulProcessor=Drift(), outputStructType=DRIFTED, outputMode="Append", timeMode="EventTime")


def deliver(alerts: DataFrame, send, late: str = "1 minute", most: int = MOST, seconds: float = SECONDS, attempts: int = ATTEMPTS, backoff_ms: int = BACKOFF_MS) -> DataFrame:
    """A stream of alerts (sink, agent, event_id, at, body) -> a row for each try (alerts.TRIED): sent, refused, or given up after `attempts`; and limited, with attempt 0, for those over the limit.

    send(sink, event_id, attempt, body) is called in the task and says whether the sink took it; an exception counts as no. The
    alerts that wait for another try, and the times of those accepted in the last `seconds`, are the state of a (sink, agent);
    timers of event time, which the watermark of `at` fires, bring the next try. Sinks must accept an alert again after a
    restart. Alerts of a micro-batch are taken in order of time and id. The state store of the session must be RocksDB's.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    columns = [c.split(" ")[0] for c in TRIED.split(", ")]

    class Queue(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getMapState("waiting", "event_id string", "attempt int, due long, body string")
            self.accepted = handle.getListState("accepted", "at long")

        def attempt(self, key, event_id, attempt, due, body) -> tuple:
            try:
                taken = bool(send(key[0], event_id, attempt, body))
            except Exception:  # a sink that fails is one that refuses
                taken = False
            if not taken and attempt < attempts:
                again = due + wait_ms(event_id, attempt, backoff_ms)
                self.waiting.updateValue((event_id,), (attempt + 1, again, body))
                self.handle.registerTimer(again)
            elif attempt > 1:
                self.waiting.removeKey((event_id,))
            return (*key, event_id, attempt, pd.Timestamp(due, unit="ms"), "sent" if taken else "refused" if attempt < attempts else "gave up")

        def handleInputRows(self, key, rows, timerValues):
            held = [t for (t,) in self.accepted.get()] if self.accepted.exists() else []
            out = []
            for row in pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples(index=False):
                due = row.at.value // 1_000_000 if row.at.unit == "ns" else int(row.at.timestamp() * 1000)
                held = [t for t in held if t >= due - seconds * 1000]
                if len(held) >= most:
                    out.append((*key, row.event_id, 0, pd.Timestamp(due, unit="ms"), "limited"))
                    continue
                held.append(due)
                out.append(self.attempt(key, row.event_id, 1, due, row.body))
            self.accepted.put([(t,) for t in held])
            yield pd.DataFrame(out, columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            # what is due by the watermark is tried now, a try that follows another one too
            now, out = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), []
            while ready := sorted((due, event_id, attempt, body) for (event_id,), (attempt, due, body) in list(self.waiting.iterator()) if due <= now):
                out += [self.attempt(key, event_id, attempt, due, body) for due, event_id, attempt, body in ready]
            yield pd.DataFrame(out, columns=columns)

        def close(self) -> None:
            pass

    timed = alerts.withWatermark("at", late).select("sink", "agent", "event_id", "at", "body")
    return timed.groupBy("sink", "agent").transformWithStateInPandas(statefulProcessor=Queue(), outputStructType=TRIED, outputMode="Append", timeMode="EventTime")
