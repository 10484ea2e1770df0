"""Attention-based multiple-instance learning: gradients, pooling, features and held-out accuracy."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa

from rulequarry.llm import attention_quality as mil
from rulequarry.llm import queries
from rulequarry.llm._text import Words, buffers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def random_model(seed=1):
    rng = np.random.default_rng(seed)
    model = mil.Model.fresh(seed)
    model.p = {k: v + rng.normal(size=v.shape) * 0.3 for k, v in model.p.items()}
    return model


def plain_score(model, bag):
    """Gated attention passage by passage."""
    p, hs, logits = model.p, [], []
    for row in bag:
        h = np.tanh(((row - model.mean) / model.scale) @ p["W"] + p["b"])
        gate = [np.tanh(h @ p["V"][:, k]) / (1 + np.exp(-(h @ p["U"][:, k]))) for k in range(mil.GATES)]
        hs.append(h)
        logits.append(sum(w * g for w, g in zip(p["w"], gate)))
    weights = [np.exp(e) for e in logits]
    z = sum(w * h for w, h in zip(weights, hs)) / sum(weights)
    return 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))


def test_gradient_is_the_slope():
    rng = np.random.default_rng(2)
    x, first, y = rng.normal(size=(12, mil.N_FEATURES)), np.array([0, 1, 4, 9]), np.array([1.0, 0, 1, 0])
    model = random_model()
    _, grad = model.loss(x, first, y, 1e-2)
    for name, value in model.p.items():
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in value.shape)
            old = value[at]
            value[at] = old + 1e-5
            up = model.loss(x, first, y, 1e-2)[0]
            value[at] = old - 1e-5
            down = model.loss(x, first, y, 1e-2)[0]
            value[at] = old
            assert abs((up - down) / 2e-5 - grad[name][at]) < 1e-6, name


def test_pooling_is_attention():
    rng = np.random.default_rng(3)
    x, first = rng.normal(size=(20, mil.N_FEATURES)), np.array([0, 1, 8, 15])
    model = random_model()
    _, sums, weighted = model.pooled(x, first)
    assert np.allclose(model.score(sums, weighted), [plain_score(model, b) for b in np.split(x, first[1:])])


def test_attention_finds_the_passage_that_counts():
    """One marked passage anywhere makes a bag positive: the mean hardly shows it, the gates learn it."""
    rng = np.random.default_rng(4)

    def bags(n):
        xs, ys = [], []
        for k in range(n):
            x = rng.normal(size=(int(rng.integers(3, 12)), mil.N_FEATURES))
            x[:, 0] = -1
            if k % 2:
                x[rng.integers(len(x)), 0] = 3
            xs.append(x)
            ys.append(k % 2)
        return np.concatenate(xs), np.cumsum([0, *map(len, xs)])[:-1], np.array(ys, float)

    model = mil.Model.fit(*bags(400))
    x, first, y = bags(200)
    _, sums, weighted = model.pooled(x, first)
    assert ((model.score(sums, weighted) > 0.5) == y).mean() > 0.95


def test_features_of_a_passage():
    text = "AB cd!! 12 cd cd\n" + "été | x," * 1 + " y" * 70
    x, n = mil.features(Words(*buffers(pa.array([text, None, "", "one"])), 0, 4))
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert n.tolist() == [2, 0, 0, 1] and len(x) == 3
    part = words[:64]
    size = sum(len(w.encode()) for w in part)
    joined = "".join(part)
    assert np.isclose(x[0, 1], joined.count("|") / size) and np.isclose(x[0, 2], joined.count("!") / size) and np.isclose(x[0, 3], 2 / size)
    at = len(mil._CLASSES)
    upper, lower = len(re.findall("[A-Z]", joined)), len(re.findall("[a-z]", joined))
    assert np.isclose(x[0, at], upper / (upper + lower + 1)) and np.isclose(x[0, at + 1], lower / size)
    assert np.isclose(x[0, at + 6], sum(a == b for a, b in zip(part, part[1:])) / 64) and np.isclose(x[0, at + 7], 1 / 64) and np.isclose(x[0, at + 8], len(set(part)) / 64)
    assert np.allclose(x[:, mil.N_DENSE :].sum(1), 1)


def test_blocks_and_batches_give_the_same_scores():
    rng = random.Random(6)
    model = random_model()
    texts = ["".join(rng.choice(["word ", "ÄÖ! ", "x\n", " \t", "12|3 ", "y" * 700 + " "]) for _ in range(rng.choice([0, 3, 70, 900, 4000]))) for _ in range(30)] + [None, "", " \n", "z" * 50_000, " " * 9000 + "a b", "a" + " " * 9000]
    whole = mil.scores(model, pa.array(texts), 1 << 24)
    for block in (500, 5000, 100_000):
        assert np.array_equal(whole, mil.scores(model, pa.array(texts), block))
    assert np.array_equal(whole[::-1], mil.scores(model, pa.array(texts[::-1]), 7000))
    for text, score in zip(texts, whole):
        x, _ = mil.features(Words(*buffers(pa.array([text], pa.string())), 0, 1))
        assert abs(score - (plain_score(model, x) if len(x) else 0)) < 1e-5


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op12_attention_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7)
    held = [r for r in rows if r.held_out]
    assert len(held) > 60
    for quality in (0, 1):
        assert np.mean([r.predicted == quality for r in held if r.quality == quality]) > 0.97, quality


def test_odd_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    odd = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t", None, None, 3), (4, "word", "en", "b", 4), (4, "word", "en", "b", 4), (None, "Null id " * 30, "en", None, 240), (5, "x" * 300_000, "de", "b", 300_000)], SCHEMA)
    extra = docs.unionByName(odd).selectExpr("*", "1 AS score", "2 AS held_out", "3 AS predicted", "4 AS quality", "5 AS turn")
    more = labels.unionByName(spark.createDataFrame([(None, 1, 0), (4, None, 0), (7, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")).selectExpr("*", "'a' AS text", "6 AS turn")
    found = mil.quality_scores(extra, mil.train(extra, more)).collect()
    assert len(found) == 207 and all(0 <= r.score <= 1 for r in found)
    assert [r.score for r in found if r.doc_id in (2, 3)].count(0.0) >= 2
    assert len({r.score for r in found if r.doc_id is None}) == 1 and not any(r.held_out for r in found if r.doc_id is None)
    empty = docs.limit(0)
    assert mil.quality_scores(empty, mil.train(empty, labels)).collect() == []
    assert {r.score for r in mil.quality_scores(docs, mil.train(docs, labels.limit(0))).collect()} == {0.5}
