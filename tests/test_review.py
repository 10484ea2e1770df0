"""Decisions replayed one by one, judges that answer badly, and envelopes of inliers."""

import datetime as dt
import json
import random

import numpy as np
from pyspark.sql import functions as F

from rulequarry.operators import anomaly, review

DECISION = "item_id string, decision string, decided_by string, decided_at timestamp, edit_notes string, replacement string, seq int"


def test_decisions(spark):
    rng = random.Random(8)
    kinds = ["approved", "rejected", "edited", "edited", "pending", None]
    rows = [(rng.choice(["a", "b", "c", "gone"]), rng.choice(kinds), rng.choice("xy"), dt.datetime(2024, 1, rng.randrange(1, 4)), None, rng.choice([None, f"t{k}"]), k) for k in range(40)]
    items = spark.createDataFrame([(i, f"own {i}") for i in "abcd"], "item_id string, trace string")
    want = {i: ["pending", None, f"own {i}", 0] for i in "abcd"}
    for item, decision, by, at, _, replacement, _ in sorted(rows, key=lambda r: (r[3], r[6])):
        if item in want and decision in review.DECISIONS:
            w = want[item]
            w[0], w[1], w[3] = decision, by, w[3] + 1
            if decision == "edited" and replacement:
                w[2] = replacement
    given = spark.createDataFrame(rows, DECISION)
    got = review.decide(items, given, ["decided_at", "seq"]).collect()
    assert {r.item_id: [r.decision, r.decided_by, r.trace, r.n_decisions] for r in got} == want and len(got) == 4
    assert review.unknown(items, given).count() == sum(r[0] == "gone" for r in rows)
    assert {r.decision for r in review.decide(items, given.limit(0), ["seq"]).collect()} == {"pending"}


def test_judges(spark):
    step = "array<struct<type: string, content: string>>"
    traces = spark.createDataFrame([(str(k), [("user_input", "no"), ("agent_response", t), ("agent_response", None), ("agent_response", "end")]) for k, t in enumerate(["good", "bad", "mute", "x" * 3000])] + [("none", None)], f"trace_id string, steps {step}")
    rules = spark.createDataFrame([("r", "output_format", "high", "Be good"), ("s", "ordering", "low", "Other")], "rule_id string, type string, severity string, description string")
    seen = {"good  end": '{"verdict": "PASS"}', "bad  end": 'Well {"verdict": "fail", "reason": ""} so', "mute  end": "{verdict}"}

    def ask(prompts):
        given = [json.loads(p) for p in prompts]
        assert all(g["rule"] == "Be good" and len(g.get("agent_response", "")) <= 2000 for g in given)
        return [seen.get(g.get("agent_response", ""), '{"verdict": "maybe"}') for g in given]

    got = {r.trace_id: (r.outcome, r.expected, r.observed) for r in review.judged(traces, rules, ask).collect()}
    na = ("not_applicable", None, None)
    assert got == {"0": ("pass", None, None), "1": ("fail", "Be good", "judged to fail without a reason"), "2": na, "3": na, "none": na}
    for bad in (None, lambda prompts: 1 / 0, lambda prompts: []):
        assert {r.outcome for r in review.judged(traces, rules, bad).collect()} == {"not_applicable"}


def test_envelopes_of_inliers(spark):
    rng = random.Random(9)
    rows = [(f"t{k}", float(rng.randrange(50)) if k % 20 else 5000.0 + k, float(k % 7)) for k in range(400)]
    given = spark.createDataFrame(rows, "trace_id string, a double, b double")
    kept = {r.trace_id for r in anomaly.inliers(given).filter("inlier").collect()}
    assert 370 <= len(kept) < 400
    got = {r.feature: r for r in anomaly.envelopes(given).collect()}
    for k, name in ((1, "a"), (2, "b")):
        v = [r[k] for r in rows if r[0] in kept]
        assert np.allclose([got[name].p1, got[name].p99], np.quantile(v, [0.01, 0.99])) and got[name].within_rate >= 0.95
    assert got["a"].p99 < 5000 and anomaly.envelopes(given.limit(10)).count() == 0
    assert anomaly.envelopes(given.withColumn("a", F.lit(1.0))).filter("feature = 'a'").count() == 0
