"""Vector codes against plain arithmetic and the DuckDB statement."""

import hashlib
import math
import random

import numpy as np
import pytest

import compare
from rulequarry.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=16, size=64, rounds=2):
    """The contract in Python's integers."""
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    kept = [(i, [math.floor(v * 256) for v in vec], label) for i, vec, label in kept]
    start = sorted((r for r in kept if r[0] is not None and r[1] and len(r[1]) % parts == 0))
    if not start:
        return [(i, None, None, None, hashlib.sha256(b"").hexdigest()) for i, _, _ in kept]
    width = len(start[0][1])
    first = {}
    for i, vec, _ in start:
        if len(vec) == width:
            first.setdefault(i, vec)
    w = width // parts
    cut = lambda vec: [vec[p * w : p * w + w] for p in range(parts)]
    books = [list(b) for b in zip(*(cut(v) for _, v in sorted(first.items())[:size]))]
    fits = [r for r in kept if len(r[1]) == width]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in fits:
                part = cut(r[1])[p]
                groups.setdefault(near(part, books[p])[1], []).append(part)
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    coded, by_label = [], {}
    for i, vec, label in kept:
        if len(vec) != width:
            coded.append((i, None, None, label))
            continue
        found = [near(part, books[p]) for p, part in enumerate(cut(vec))]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        coded.append((i, "".join("%02x" % k for _, k in found), min(error, 2**63 - 1), label))
    return [(i, c, e, by_label.get(label) if by_label.get(label, 0) < 2**63 else None, digest) for i, c, e, label in coded]


@pytest.mark.parametrize("wide", [False, True])
def test_partial_distances_find_the_nearest(wide):
    """Ties, repeated entries and one entry; 64-bit and Python's integers."""
    rng = np.random.default_rng(3)
    for n, k, w, span in [(200, 64, 4, 5), (50, 1, 3, 9), (300, 40, 1, 30), (100, 20, 8, 1000)]:
        x, book = rng.integers(-span, span, (n, w)), rng.integers(-span, span, (k, w))
        if wide:
            x, book = x.astype(object) * 2**60, book.astype(object) * 2**60
        index, best = vector_codes.nearest(x, book, vector_codes.by_variance(book))
        every = ((x[:, None] - book[None]) ** 2).sum(2)
        assert index.tolist() == [min(range(k), key=lambda e: (row[e], e)) for row in every.tolist()]
        assert best.tolist() == every.min(1).tolist()


def test_statement(spark):
    sf = "/root/testdata/sf0.001"
    assert compare.differences(spark, compare.connection(sf), queries.op11_vector_codes, vector_codes.ORACLE, sf) == ""


def odd():
    rng = random.Random(5)
    vec = lambda d, s=1.0: [rng.uniform(-s, s) for _ in range(d)]
    rows = [(i * 3 % 97, vec(32), i % 4 if i % 5 else None) for i in range(90)]
    rows += [(200, None, 1), (201, [None] + vec(31), 1), (202, [float("nan")] + vec(31), 1), (203, [float("inf")] + vec(31), 1), (204, [], 1), (205, vec(16), 7), (206, vec(33), 7)]
    rows += [(None, vec(32), 2), (3, vec(32), 2), (3, vec(32), 2), (3, rows[1][1], 2)] + [rows[7]] * 5
    return rows


@pytest.mark.parametrize("kind", ["odd", "few", "huge", "empty", "none fits"])
def test_query_is_the_contract(spark, tmp_path, kind):
    rows = {"odd": odd(), "few": odd()[:5], "huge": odd() + [(300, [1e30] * 32, 8), (301, [-3e6] * 32, 9), (302, [3e6] * 32, 9)], "empty": [], "none fits": [(1, [1.0] * 7, 1), (None, [1.0] * 16, 1)]}[kind]
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS code", "2 AS error", "3 AS label_error", "4 AS n").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    table = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    clip = lambda v: None if v is None else max(-(2.0**54), min(2.0**54, v))
    want = plain([(r.vec_id, r.embedding and [clip(v) if v is not None and math.isfinite(v) else v for v in r.embedding] if r.embedding is not None else None, r.label) for r in table.collect()])
    assert sorted(map(tuple, queries.op11_vector_codes(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_labels_by_join(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "MAX_LABELS", 0)
    rows = spark.createDataFrame(odd(), SCHEMA)
    assert sorted(map(tuple, vector_codes.vector_codes(rows).collect()), key=str) == sorted(plain([tuple(r) for r in rows.collect()]), key=str)
