"""Miners of all clusters at once against each cluster mined alone, and a rule for null clusters, names and empty tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulequarry.operators import by_cluster, sequences
from rulequarry.plans.mining import contingency

CLUSTERS = ["a", "b", None]


def traces():
    rng = random.Random(2)
    return [(c, k, [rng.choice("pqrst"[: 3 + i]) for _ in range(rng.randrange(6))]) for i, c in enumerate(CLUSTERS) for k in range(40 * (i + 1))]


@pytest.mark.parametrize("support", [0.01, 0.3])
def test_patterns(spark, support):
    rows = spark.createDataFrame(traces(), "cluster_id string, trace_id int, tools array<string>")
    found = by_cluster.frequent_subsequences(rows, support).persist()
    closed = by_cluster.closed_patterns(found)
    for c in CLUSTERS:
        mine = F.col("cluster_id").eqNullSafe(F.lit(c))
        alone = sequences.frequent_subsequences(rows.filter(mine), support).persist()
        for here, there in ((found, alone), (closed, sequences.closed_patterns(alone))):
            want = {(tuple(r.pattern), r.n_traces) for r in there.collect()}
            assert {(tuple(r.pattern), r.n_traces) for r in here.filter(mine).collect()} == want
            assert want or support > 0.1 and there is not alone
    assert by_cluster.frequent_subsequences(rows.limit(0)).count() == 0


def test_associations(spark):
    rng = random.Random(4)
    rows = [(c, sorted(rng.sample(["k1", "k2", "k3"], rng.randrange(4))), rng.sample(["x", "y", "z"], rng.randrange(4))) for c in CLUSTERS for _ in range(60)]
    given = spark.createDataFrame(rows, "cluster_id string, keywords array<string>, tools array<string>")
    found = by_cluster.contingency(given, 5)
    for c in CLUSTERS:
        mine = F.col("cluster_id").eqNullSafe(F.lit(c))
        want = Counter(map(tuple, contingency(given.filter(mine), 5).collect()))
        assert Counter(map(tuple, found.filter(mine).drop("cluster_id").collect())) == want and len(want) == 9


def test_envelopes(spark):
    rng = random.Random(6)
    rows = [(c, f"t{k}", rng.randrange(100), rng.choice([0.0, 0.5, 2.25]), 7, None if k % 3 else 10.0 * k) for c in CLUSTERS for k in range(150)]
    given = spark.createDataFrame(rows, "cluster_id string, trace_id string, n int, half double, same int, some double")
    got = {(r.cluster_id, r.feature): r for r in by_cluster.envelopes(given).collect()}
    for c in CLUSTERS:
        for k, name in ((2, "n"), (5, "some")):
            v = [float(r[k]) for r in rows if r[0] == c and r[k] is not None]
            r = got[c, name]
            assert np.allclose([r.p1, r.p99, r.median], np.quantile(v, [0.01, 0.99, 0.5]), atol=1e-9)
            assert abs(r.within_rate - np.mean([(r.p1 <= x <= r.p99) for x in v])) < 1e-12
        assert (c, "same") not in got and got[c, "half"].within_rate == 1
    assert by_cluster.envelopes(given.limit(0)).count() == 0
