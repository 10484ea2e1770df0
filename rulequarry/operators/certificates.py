"""Signed statements of what was checked."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sign(evidence: dict, key: bytes) -> dict:
    """The evidence with an HMAC-SHA256 over its sorted JSON."""
    body = json.dumps(evidence, sort_keys=True, separators=(",", ":")).encode()
    return evidence | {"signature": hmac.new(key, body, hashlib.sha256).hexdigest()}


def verify(signed: dict, key: bytes) -> bool:
    evidence = {k: v for k, v in signed.items() if k != "signature"}
    return hmac.compare_digest(sign(evidence, key)["signature"], str(signed.get("signature", "")))


#: Scores of the review band start at LOW; its upper end lies below HIGH; with no scores at all it is EMPTY.
LOW, HIGH, EMPTY = 0.6, 0.99, 0.8
_LEVELS = 5


def review_band(scores: DataFrame, queue_min: int, queue_max: int, rounds: int = 20, score: str = "score") -> float:
    """The upper end of the review band: bisection until queue_min to queue_max scores lie in [LOW, end), or `rounds` are over.

    One pass over the scores counts for the next five rounds at once, whichever way they turn. Null scores are in no band.
    """
    low, high, mid, left = LOW, HIGH, EMPTY, rounds
    while left > 0:
        nodes, level = {}, [("", low, high)]
        for _ in range(min(_LEVELS, left)):
            nodes |= {name: (a, b, (a + b) / 2) for name, a, b in level}
            level = [x for name, a, b in level for x in ((name + "u", (a + b) / 2, b), (name + "d", a, (a + b) / 2))]
        counts = [F.count_if((F.col(score) >= LOW) & (F.col(score) < m)).alias(f"n_{name}") for name, (_, _, m) in nodes.items()]
        found = scores.agg(F.count("*").alias("n"), *counts).first()
        if not found["n"]:
            return EMPTY
        name = ""
        while name in nodes:
            low, high, mid = nodes[name]
            n = found[f"n_{name}"]
            if queue_min <= n <= queue_max:
                return mid
            low, high, name = (mid, high, name + "u") if n < queue_min else (low, mid, name + "d")
            left -= 1
    return mid
