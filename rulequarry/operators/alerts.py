"""Alert sinks' limits and payloads."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulequarry.functions.text import sampling_roll

#: A delivery is tried so often, with so many milliseconds before the second try and twice as many before each next one.
ATTEMPTS, BACKOFF_MS = 3, 250
#: An agent's alerts to one sink: at most so many accepted in any so many seconds.
MOST, SECONDS = 60, 60


def limited(alerts: DataFrame, key: str = "agent", at: str = "at", order: str = "event_id", most: int = MOST, seconds: float = SECONDS) -> DataFrame:
    """The alerts that are accepted: those with fewer than `most` accepted ones of the same key in the `seconds` before.

    What is refused doesn't count against later ones. Rows of a key come in time order to one task, which holds
    the last `most` times only; a null key is a key of its own.
    """
    columns = alerts.columns
    n = int(alerts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = alerts.withColumn("__at", F.unix_micros(F.col(at).cast("timestamp"))).repartition(n, key).sortWithinPartitions(key, "__at", order)
    k, t = columns.index(key), len(columns)

    def judge(batches):
        import pyarrow as pa

        now, accepted = object(), deque()
        for batch in batches:
            keep = []
            for name, micros in zip(batch.column(k).to_pylist(), batch.column(t).to_pylist()):
                if name != now:
                    now, accepted = name, deque()
                while accepted and accepted[0] < micros - seconds * 1_000_000:
                    accepted.popleft()
                ok = len(accepted) < most
                if ok:
                    accepted.append(micros)
                keep.append(ok)
            yield batch.filter(pa.array(keep, pa.bool_())).select(columns)

    return rows.mapInArrow(judge, alerts.schema)


#: Rows of streaming.pipelines.deliver(): what became of a try.
TRIED = "sink string, agent string, event_id string, attempt int, at timestamp, status string"


def wait_ms(event_id: str, attempt: int, backoff_ms: int = BACKOFF_MS) -> int:
    """Milliseconds from a refused try to the next one; delays() adds these up in columns."""
    from hashlib import sha1

    base = backoff_ms * 2 ** (attempt - 1)
    return base + int(int(sha1(f"{event_id}:{attempt}".encode()).hexdigest()[:8], 16) / 4294967295.0 * base)


def delays(event: str = "event_id", attempts: int = ATTEMPTS, backoff_ms: int = BACKOFF_MS) -> Column:
    """Milliseconds from an alert to each of its tries: doubling waits, each with as much again at most of jitter, which hangs on the alert and the try only."""
    waits = [F.lit(0).cast("long")]
    for k in range(1, attempts):
        base = backoff_ms * 2 ** (k - 1)
        jitter = F.floor(sampling_roll(F.concat(F.col(event).cast("string"), F.lit(f":{k}"))) * base)
        waits.append((waits[-1] + base + jitter).cast("long"))
    return F.array(*waits)


def deliveries(alerts: DataFrame, accepts, event: str = "event_id", at: str = "at", attempts: int = ATTEMPTS, backoff_ms: int = BACKOFF_MS) -> DataFrame:
    """alerts -> their columns, attempts (those made), delivered, done_at: what streaming.pipelines.deliver() comes to, for alerts that limited() has let through.

    accepts(k), a condition on a row's columns and the number of the try as a column, says whether the sink takes it; null means no. No shuffle.
    """
    taken = F.array(*[F.coalesce(accepts(F.lit(k)), F.lit(False)) for k in range(1, attempts + 1)])
    first = F.array_position(taken, True)
    made = F.when(first > 0, first).otherwise(attempts).cast("int")
    done = F.timestamp_millis(F.unix_millis(F.col(at).cast("timestamp")) + F.element_at(delays(event, attempts, backoff_ms), made))
    return alerts.withColumns({"attempts": made, "delivered": first > 0, "done_at": done})


def signature(secret: str, body):
    """`sha256=` and the keyed digest of a body, as web hooks send it: HMAC of two hashes, from built-in functions only."""
    key = secret.encode()
    if len(key) > 64:
        import hashlib

        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(body, "UTF-8")), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(F.lit(outer), first), 256))
