"""The pipeline's stages one by one against plain versions, each on what the stage before has kept."""

import os
import shutil
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rulequarry.llm import decontaminate, mixing, quality_rules, secret_scan
from test_pair_ops import plain_components
from test_simple_ops import COLUMNS, ODD, plain_tiles


@pytest.fixture(scope="module")
def sf(tmp_path_factory, spark):
    """The smallest tables with odd rows, contaminated texts and secrets added."""
    to = tmp_path_factory.mktemp("sf")
    for t in ("benchmark", "labels"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", to)
    item = spark.read.parquet(f"{to}/benchmark.parquet").orderBy("item_id").first().text
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = docs.filter("n_chars BETWEEN 900 AND 1500").orderBy("doc_id").limit(4).collect()
    more = [(-1 - k, f"{r.text}\n{item}" if k % 2 else f'{r.text}\npassword = "hunter2hunter2"', r.lang, r.source, 0) for k, r in enumerate(plain)]
    docs.unionByName(spark.createDataFrame(ODD + more, COLUMNS)).write.parquet(f"{to}/documents.parquet")
    return str(to)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.select("doc_id", "text", "lang", "source", "n_chars").collect()
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = docs.collect()
        after = [tuple(r)[:5] for r in kept[name]]
        if k == 0:
            model = quality_rules.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
            want = Counter()
            for r in before:
                n, _, _, _, repeats = quality_rules.base((r.text or "").encode())
                x, sizes = quality_rules.line_features((r.text or "").encode())
                if n >= 50 and 2 * repeats <= n and 2 * int((model.viterbi(x) * sizes).sum()) >= n:
                    want[tuple(r)] += 1
            assert Counter(after) == want and want
        elif k == 1:
            groups = defaultdict(list)
            for doc_id, n, component in plain_components([(r.doc_id, r.text) for r in before]).elements():
                groups[component if n else (doc_id, "alone")].append(doc_id)
            assert len(after) == len(groups)
            assert sorted(r[0] for r in after if r[0] is not None) == sorted(min(x for x in g if x is not None) for g in groups.values() if any(x is not None for x in g))
            assert set(after) <= {tuple(r) for r in before}
        elif k == 2:
            items = [decontaminate._tokens(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            want = Counter()
            for r in before:
                doc = decontaminate._tokens(r.text).tolist()
                own = [i.tolist() for i in items if len(set(i.tolist()) & set(doc)) >= 0.5 * len(set(i.tolist()))]
                if not any(plain_tiles(doc, i, min(5, len(i))) >= 0.5 * len(i) for i in own):
                    want[tuple(r)] += 1
            assert Counter(after) == want and len(before) > len(after)
        elif k == 3:
            found = {(r.doc_id, r.text): r.found for r in secret_scan.secret_scan(spark.createDataFrame([(r.doc_id, r.text) for r in before], "doc_id long, text string")).collect()}
            want = Counter()
            for r in before:
                gone = {i for s in found[(r.doc_id, r.text)] for i in range(s.start, s.end)}
                text = "".join(("[SECRET]" if i - 1 not in gone else "") if i in gone else c for i, c in enumerate(r.text))
                want[(r.doc_id, text, r.lang, r.source, len(text))] += 1
            assert Counter(after) == want and any("[SECRET]" in r[1] for r in after)
        else:
            rows = spark.createDataFrame(before, COLUMNS)
            rate = {r.source: r.cdf for r in mixing.rates(rows).collect()}
            u = {(r.doc_id, r.text): r.u for r in rows.select("doc_id", "text", mixing.uniform(F.lit("17"), "doc_id", F.md5(F.coalesce("text", F.lit("")))).alias("u")).collect()}
            want = Counter()
            for r in before:
                want[tuple(r)] += sum(c <= u[(r.doc_id, r.text)] for c in rate[r.source])
            assert Counter(after) == +want
            assert all(r.copy >= 1 for r in kept[name])
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    ran = corpus_pipeline.run(spark, sf)
    left = sorted(x.partition("-")[0] for x in set(os.listdir(shared)) - before)
    assert left == ["rates", "stage4"]  # what the last stage reads
    assert Counter(tuple(r)[:5] for r in ran.collect()) == Counter(after)


def test_empty_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
