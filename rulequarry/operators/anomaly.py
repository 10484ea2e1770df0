"""Outlying traces by an isolation forest: each tree draws its rows from all traces, and the cut is a quantile of all scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES, SAMPLE, MIN_TRACES, CONTAMINATION = 128, 256, 30, 0.05
#: Decimals of a score, so that the quantile comes from counts of at most 100,001 values.
DECIMALS = 5


def _tree(x: np.ndarray, rng, depth: int, most: int):
    if depth >= most or len(x) < 2 or (x.max(0) == x.min(0)).all():
        return len(x)
    k = rng.choice(np.flatnonzero(x.max(0) > x.min(0)))
    cut = rng.uniform(x[:, k].min(), x[:, k].max())
    left = x[:, k] < cut
    return int(k), float(cut), _tree(x[left], rng, depth + 1, most), _tree(x[~left], rng, depth + 1, most)


def _c(n: float) -> float:
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def _path(tree, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    stack = [(tree, np.arange(len(x)), 0)]
    while stack:
        node, rows, depth = stack.pop()
        if not isinstance(node, tuple):
            out[rows] = depth + _c(node)
            continue
        left = x[rows, node[0]] < node[1]
        stack += [(node[2], rows[left], depth + 1), (node[3], rows[~left], depth + 1)]
    return out


def drawn(features: DataFrame, n: int, seed: int = 17) -> dict[int, np.ndarray]:
    """By tree, the features of the min(SAMPLE, n) traces of least hash for that tree; about twice as many reach the driver."""
    names = [c for c in features.columns if c != "trace_id"]
    h = f"pmod(xxhash64(trace_id, {seed}, t), 1073741824)"
    rate = min(1.0, 2 * SAMPLE / n)
    hits = F.expr(f"filter(transform(sequence(0, {TREES - 1}), t -> struct(t, {h} AS h)), x -> x.h < {rate * 2**30!r}D)")
    rows = features.withColumn("x", F.explode(hits)).select("x.t", "x.h", "trace_id", *names).collect()
    by_tree = {t: [] for t in range(TREES)}
    for r in sorted(rows, key=lambda r: (r.t, r.h, r.trace_id)):
        by_tree[r.t].append(tuple(r)[3:])
    return {t: np.array(x[:SAMPLE], float).reshape(-1, len(names)) for t, x in by_tree.items()}


def inliers(features: DataFrame, seed: int = 17) -> DataFrame:
    """trace_id and numeric features -> trace_id, score, inlier."""
    names = [c for c in features.columns if c != "trace_id"]
    n = features.count()
    if n < MIN_TRACES:
        return features.select("trace_id", F.lit(0.0).alias("score"), F.lit(True).alias("inlier"))
    rng = np.random.default_rng(seed)
    size = min(SAMPLE, n)
    trees = [_tree(x, rng, 0, int(np.ceil(np.log2(size)))) for x in drawn(features, n, seed).values()]

    def judge(batches):
        for b in batches:
            x = b[names].to_numpy(float)
            yield b[["trace_id"]].assign(score=np.round(2.0 ** (-np.mean([_path(t, x) for t in trees], axis=0) / _c(size)), DECIMALS))

    scored = features.mapInPandas(judge, "trace_id string, score double")
    cut = scored.agg(F.percentile("score", F.lit(1 - CONTAMINATION))).first()[0]
    return scored.withColumn("inlier", F.col("score") <= cut)


def envelopes(features: DataFrame, least: float = 0.95, seed: int = 17) -> DataFrame:
    """trace_id and numeric features -> feature, p1, p99, median, within_rate (of the inliers) for the stable ones; the percentiles are of inliers only, fewer than MIN_TRACES traces have none."""
    from rulequarry.operators import by_cluster

    if features.limit(MIN_TRACES).count() < MIN_TRACES:
        features = features.limit(0)
    kept = inliers(features, seed).filter("inlier").select("trace_id")
    return by_cluster.envelopes(features.join(kept, "trace_id", "left_semi").withColumn("cluster_id", F.lit("all")), least).drop("cluster_id")
