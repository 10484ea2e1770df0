"""Streams against the batch forms of the same functions: callbacks, exactly-once ingest, drift sessions."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from rulequarry.operators import alerts, callbacks, drift
from rulequarry.streaming import pipelines

T0 = dt.datetime(2024, 1, 1)
CALLBACK = "run_id string, kind string, at timestamp, tool string"


def plain_pairs(rows, timeout):
    """Starts and the first end not before them, by run."""
    out = []
    for run in sorted({r[0] for r in rows if r[0] is not None and r[1] == "start"}):
        at, tool = min((r[2], r[3]) for r in rows if r[0] == run and r[1] == "start")
        end = min(((r[2], r[1]) for r in rows if r[0] == run and r[1] != "start"), default=None)
        closed = end is not None and 0 <= (end[0] - at).total_seconds() <= timeout
        out.append((run, tool, at, int((end[0] - at).total_seconds() * 1000) if closed else None, {"end": "success", "error": "error"}[end[1]] if closed else "timeout"))
    return out


def test_paired_callbacks_of_a_stream(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for k in range(120):
        at = T0 + dt.timedelta(seconds=30 * k)
        rows.append((f"r{k}", "start", at, rng.choice("xyz")))
        if rng.random() < 0.8:
            end = at + dt.timedelta(seconds=rng.choice([0, 1, 59, 60, 61, 300]))
            rows.append((f"r{k}", rng.choice(["end", "error"]), end, None))
    rows += [("stray", "end", T0, None), (None, "start", T0, "x")]
    want = plain_pairs(rows, 60)
    table = spark.createDataFrame(rows, CALLBACK)
    assert sorted(map(tuple, callbacks.paired(table, 60).collect())) == want and len({w[4] for w in want}) == 3
    for part in range(5):
        some = [r for k, r in enumerate(sorted(rows, key=lambda r: r[2])) if k * 5 // len(rows) == part]
        some += some[:7]  # repeated payloads
        if part == 4:
            some.append(("last", "start", T0 + dt.timedelta(days=1), "x"))  # moves the watermark on
        spark.createDataFrame(some, CALLBACK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(CALLBACK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = callbacks.paired(live, 60, "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).filter("run_id <> 'last'").collect()))
    assert got == want


def test_numbered_runs(spark):
    rows = [("a", 1, "end"), ("a", 2, "start"), ("a", 3, "start"), ("a", 4, "error"), ("a", 5, "end"), ("b", 1, "start")]
    got = callbacks.numbered(spark.createDataFrame(rows, "u string, i int, kind string"), ["u"], ["i"]).orderBy("u", "i").collect()
    assert [r.run_id for r in got] == [None, "a:1", "a:2", "a:2", "a:2", "b:1"]


def lines(names, day=1):
    return [json.dumps({"trace_id": n, "session_id": "s", "version": "v1", "started_at": f"2024-01-0{day}T00:00:00", "steps": [{"type": "tool_call", "tool": n}]}) for n in names]


def test_ingest_is_exactly_once(spark, tmp_path):
    """Repeated files and lines, a failure after a batch was written, and restarts add nothing."""
    inbox = tmp_path / "in"
    inbox.mkdir()

    def run():
        live = pipelines.ingest(spark, str(inbox), files=1)
        q = pipelines.ingest_once(live, str(tmp_path / "store"), str(tmp_path / "state"), availableNow=True)
        q.awaitTermination()

    def stored():
        return sorted((r.trace_id, r.version, str(r.dt), r.steps[0].tool) for r in pipelines.ingested(spark, str(tmp_path / "store")).collect())

    (inbox / "1.json").write_text("\n".join(lines(["a", "b", "a"]) + ["no trace", "no trace"]))
    (inbox / "2.json").write_text("\n".join(lines(["b", "c"])))
    run()
    want = [(n, "v1", "2024-01-01", n) for n in "abc"]
    assert stored() == want
    rejected = spark.read.parquet(str(tmp_path / "store" / "rejected"))
    assert [r._corrupt_record for r in rejected.collect()] == ["no trace"]
    (inbox / "3.json").write_text("\n".join(lines(["a", "b", "c", "d"])))  # after a restart
    run()
    want.append(("d", "v1", "2024-01-01", "d"))
    assert stored() == want
    # the last batch is run again, as after a failure between its write and its commit
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for path in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        path.unlink(missing_ok=True)
    run()
    assert stored() == want


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def observations():
    rng = random.Random(3)
    rows, ord_ = [], 0
    for agent in ("a", "b", "c"):
        at = T0
        for k in range(260):
            ord_ += 1
            at += dt.timedelta(minutes=1) if rng.random() > 0.02 else dt.timedelta(hours=3)
            good = 0.97 if k % 120 < 60 else 0.1
            control = "reset" if agent == "b" and k in (90, 91, 200) else None
            rows.append((agent, "r", at, ord_, None if control else float(rng.random() < good), control))
    return rows


def test_drift_sessions_of_a_stream(spark, tmp_path, rocks):
    rows = observations()
    idle = 3600.0
    want, kept = [], {}
    for agent, rule, at, _, x, control in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        d, last = kept.get(agent, (drift.Detector(), None))
        d = drift.Detector() if control or last is not None and (at - last).total_seconds() > idle else d
        want += [] if control else [(agent, rule, at, d.n, e) for e in d.add(x)]
        kept[agent] = (d, at)
    table = spark.createDataFrame(rows, drift.OBSERVED)
    assert sorted(map(tuple, drift.replay(table, idle).collect())) == sorted(want) and len(want) > 4
    found = {r.agent: (r.n, round(r.mean, 9)) for r in drift.stats(table, idle).collect()}
    assert found == {a: (d.n, round(d.mean, 9)) for a, (d, _) in kept.items()}
    assert {r.agent: r.resets for r in drift.stats(table, idle).collect()} == {"a": 0, "b": 3, "c": 0}
    for part in range(4):
        some = [r for k, r in enumerate(sorted(rows, key=lambda r: r[2])) if k * 4 // len(rows) == part]
        spark.createDataFrame(some, drift.OBSERVED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(drift.OBSERVED).parquet(str(tmp_path / "in"))
        q = pipelines.drift_sessions(live, idle, "1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(want)


def test_controls_for_every_rule(spark):
    rows = spark.createDataFrame([("a", "r1", T0, 1, 1.0, None), ("a", None, T0, 2, None, "reset"), ("b", "r2", T0, 3, None, "reset")], drift.OBSERVED)
    got = drift.for_rules(rows, spark.createDataFrame([("r1",), ("r2",)], "rule string")).select("agent", "rule", "control").collect()
    assert set(map(tuple, got)) == {("a", "r1", None), ("a", "r1", "reset"), ("a", "r2", "reset"), ("b", "r2", "reset")} and len(got) == 4


def test_long_histories_in_blocks(spark):
    """Histories cut into blocks give what one fold gives, whatever the blocks, with a key that has most rows and a null key."""
    rng = random.Random(11)
    rows = []
    for key, n, turn in (("hot", 900, 500), ("low", 80, 30), (None, 60, 20), ("calm", 200, 999), ("one", 1, 9)):
        at = rng.randrange(1000)
        for k in range(n):
            at += rng.choice((1, 1, 2, 40))
            rows.append((key, at, round(rng.random() * (1.0 if k < turn else 0.2), 6)))
    obs = spark.createDataFrame(rows, "key string, ord long, x double").repartition(3)
    for detect in (
        lambda size: drift.page_hinkley(obs, "key", 1.5, rows=size).select("key", "n", "fired_at", F.round("cumulated", 4)),
        lambda size: drift.cusum(obs, "key", 0.5, rows=size),
    ):
        whole = set(map(tuple, detect(10**6).collect()))
        assert len(whole) == 5 and sum(r[2] > 0 for r in whole) >= 2
        for size in (500, 100, 17, 3):
            assert set(map(tuple, detect(size).collect())) == whole
    plain = []
    for key in ("hot", "low", None, "calm", "one"):
        d = drift.Detector()
        plain += [(key, d.n, e) for _, x in sorted((o, x) for k, o, x in rows if k == key) for e in d.add(x)]
    assert sorted(map(tuple, drift.drift_events(obs, "key").collect()), key=str) == sorted(plain, key=str) and plain
    none = obs.limit(0)
    assert drift.page_hinkley(none, "key").count() == drift.cusum(none, "key").count() == drift.drift_events(none, "key").count() == 0


def test_deliveries_of_a_stream(spark, tmp_path, rocks):
    """Tries of a stream with limits, refusals and a failing sink are those of a plain replay, and of the batch form."""
    rng = random.Random(5)
    schema = "sink string, agent string, event_id string, at timestamp, body string"
    rows = [("hook", rng.choice("ab"), f"e{k}", T0 + dt.timedelta(milliseconds=k * 700 + rng.randrange(600)), rng.choice(["ok", "later", "never", "broken"])) for k in range(120)]
    taken = {"ok": 1, "later": 3, "never": 9, "broken": 9}

    def send(sink, event_id, attempt, body):
        if body == "broken":
            raise OSError("no route")
        return attempt >= taken[body]

    want, through, held = [], set(), {}
    for sink, agent, event, at, body in sorted(rows, key=lambda r: (r[3], r[2])):
        near = [t for t in held.get(agent, []) if t >= at - dt.timedelta(seconds=20)]
        held[agent] = near
        if len(near) >= 10:
            want.append((agent, event, 0, at, "limited"))
            continue
        near.append(at)
        through.add(event)
        for k in range(1, 4):
            status = "sent" if k >= taken[body] else "refused" if k < 3 else "gave up"
            want.append((agent, event, k, at, status))
            if status == "sent":
                break
            at += dt.timedelta(milliseconds=alerts.wait_ms(event, k))
    end = [("hook", "z", "end", T0 + dt.timedelta(days=1), "ok")]
    for part in (rows[:40], rows[40:80], rows[80:], end):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = pipelines.deliver(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), send, most=10, seconds=20)
        live.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).filter("agent <> 'z'")
    assert sorted((r.agent, r.event_id, r.attempt, r.at, r.status) for r in got.collect()) == sorted(want)
    assert {s for *_, s in want} == {"sent", "refused", "gave up", "limited"}
    table = spark.createDataFrame(rows, schema).filter(F.col("event_id").isin(*through))
    done = alerts.deliveries(table, lambda k: (F.col("body") == "ok") | (F.col("body") == "later") & (k >= 3))
    last = {e: (k, status == "sent", at) for _, e, k, at, status in want if status in ("sent", "gave up")}
    assert {r.event_id: (r.attempts, r.delivered, r.done_at) for r in done.collect()} == last


def test_cusum_of_steps_in_blocks(spark):
    """Sums of fixed steps, which meet the limit to the last bits: blocks give what one fold in doubles gives, with ties of time in order of `tie`."""
    rng = random.Random(3)
    rows = [(f"k{k}", i // 2, -i, 1.0 if rng.random() < 0.9 else 0.0) for k in range(60) for i in range(240)]
    obs = spark.createDataFrame(rows, "key string, ord long, tie long, x double").repartition(3)
    want = set()
    for key in {r[0] for r in rows}:
        up, down, fired, direction = 0.0, 0.0, 0, ""
        for n, (_, _, x) in enumerate(sorted(r[1:] for r in rows if r[0] == key), 1):
            up, down = max(0.0, up + (x - 0.95) - 0.05), min(0.0, down + (x - 0.95) + 0.05)
            if not fired and n >= 20 and (up > 4.0 or down < -4.0):
                fired, direction = n, "up" if up > 4.0 else "down"
        want.add((key, 240, fired, direction))
    for size in (1000, 90, 20):
        assert set(map(tuple, drift.cusum(obs, "key", rows=size).collect())) == want
    events = {(r.key, r.n) for r in drift.drift_events(obs, "key").collect()}
    assert events == {(r.key, r.n) for r in drift.drift_events(obs.orderBy(F.desc("tie")), "key").collect()}
