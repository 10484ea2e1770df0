"""The operators that compare documents, against plain versions, and their edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulequarry.llm import fingerprint_index, jaccard_join, suffix_dedup
from rulequarry.llm._graph import components

SF = "/root/testdata/sf0.001"


def corpus(seed=5):
    """Copies, near copies, shared passages, periodic texts, odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, texts = text(60), [text(rng.randint(5, 300)) for _ in range(25)]
    base = text(200).split()
    for k in range(20):
        near = list(base)
        for _ in range(k // 2):
            near[rng.randrange(len(near))] = word()
        texts.append(" ".join(near))
    texts += [texts[3]] * 5 + [text(30) + " " + passage + "\n" + text(30) for _ in range(8)]
    texts += ["ab" * 400, "a " * 300, "b" * 199, "b" * 200, "c" * 201, "", None, " \n", "one two", "One Two", "one two three four", "x" * 30_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[0], (None, texts[0]), (None, texts[1])]


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.createDataFrame(corpus(), "doc_id long, text string")
    return given.unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text"))


@pytest.mark.parametrize("few", [0, 10_000])
def test_components(spark, few):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, k) for k in range(1001, 1300)] + [(k, k + 1) for k in range(2000, 2100)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), few).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    want = defaultdict(list)
    for x in list(parent):
        want[find(x)].append(x)
    assert got == {x: min(g) for g in want.values() for x in g}


def test_merged_transforms_sort_all_suffixes():
    rng = random.Random(9)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(30)] + [b"ab" * 30, b"ab" * 30]
    shards = [suffix_dedup.Shard(pieces[k : k + 7], 40) for k in range(0, len(pieces), 7)]
    z, lcp = suffix_dedup.interleave(shards, 40)
    text, at = [], [0] * len(shards)
    for k in z:
        s = shards[k]
        place = s.suffixes[at[k]]
        at[k] += 1
        piece = np.searchsorted(s.starts, place, side="right") - 1
        text.append(pieces[7 * k + piece][place - s.starts[piece] :][:40].ljust(40, b"\0") if place - s.starts[piece] < s.sizes[piece] else b"")
    assert text == sorted(text)
    for i in range(1, len(text)):
        if text[i - 1]:
            same = next((j for j in range(40) if text[i][j] != text[i - 1][j]), 40)
            assert lcp[i] == same // 8 * 8 and (lcp[i] < 40) == (same < 40)
    got = suffix_dedup.repeated_windows(pieces, 16, 200)
    count = Counter(p[i : i + 16] for p in pieces for i in range(len(p) - 15))
    assert [g.tolist() for g in got] == [[count[p[i : i + 16]] > 1 for i in range(max(0, len(p) - 15))] for p in pieces]


def test_repeated_in_groups():
    """Pieces around one anchor, cut and merged, against all windows."""
    rng = random.Random(13)
    core = bytes(rng.choice(b"xyz") for _ in range(400))
    held = []
    for _ in range(120):
        a, b = rng.randint(0, 168), rng.randint(232, 400)
        body = bytearray(core[a:b])
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(body))
            if not 168 - a <= k < 232 - a:
                body[k] = rng.choice(b"xyz")
        held.append((7, 200 - a, rng.choice((1, 1, 1, 2)), bytes(body)))
    held = list({h[3]: h for h in held if len(h[3]) >= 200}.values())
    other = bytes(rng.choice(b"uvw") for _ in range(250))
    held += [(9, 100, 1, other), (9, 100, 1, other[:240])]
    count = Counter()
    for _, place, copies, body in held:
        for i in range(len(body) - 199):
            count[(body[i : i + 200])] += copies
    got = suffix_dedup.repeated_in_groups(held)
    for (anchor, place, copies, body), found in zip(held, got):
        flags = [any(a <= i < b for a, b in zip(found[0::2], found[1::2])) for i in range(len(body) - 199)]
        inside = [i + 200 > place and i <= place for i in range(len(body) - 199)]
        assert [f for f, x in zip(flags, inside) if x] == [count[body[i : i + 200]] > 1 for i, x in enumerate(inside) if x]


@pytest.mark.parametrize("max_pieces", [suffix_dedup.MAX_PIECES, 1])
def test_suffix_dedup(spark, docs, max_pieces):
    rows = docs.filter("doc_id IS NULL OR doc_id < 1100")
    texts = [(r.doc_id, (r.text or "").encode()) for r in rows.collect()]
    count = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    want = Counter()
    for doc_id, t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[(doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(tuple(r)[:5] for r in suffix_dedup.suffix_dedup(rows, max_pieces).collect()) == want


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_incremental_dedup(spark, docs, batches):
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in docs.collect()]
    least = {}
    for doc_id, w in rows:
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            least[key] = min(least.get(key, 1 << 63), 1 << 62 if doc_id is None else doc_id)
    want = Counter()
    for doc_id, w in rows:
        mine = 1 << 62 if doc_id is None else doc_id
        gone = {j for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < mine for j in range(i, i + 13)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want[(doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    got = Counter(tuple(r)[:4] for r in fingerprint_index.incremental_dedup(docs, batches).collect())
    assert got == want


def test_index_is_kept_between_calls(spark, docs, tmp_path):
    """Two calls, the second with an index opened anew, give what one gives; earlier documents win whatever their ids."""
    cut = sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)[docs.count() // 2]
    parts = [docs.filter(F.col("doc_id") <= cut), docs.filter((F.col("doc_id") > cut) | F.col("doc_id").isNull())]
    index = fingerprint_index.FingerprintIndex(spark)
    got = Counter(tuple(r)[:4] for r in fingerprint_index.incremental_dedup(parts[0], 2, index=index).collect())
    index.save(str(tmp_path / "index"))
    for table in index.runs:  # as in a session whose catalogue doesn't know them
        spark.sql(f"DROP TABLE {table._scratch_table}")
    index = fingerprint_index.FingerprintIndex.open(spark, str(tmp_path / "index"))
    got += Counter(tuple(r)[:4] for r in fingerprint_index.incremental_dedup(parts[1], 2, index=index).collect())
    assert got == Counter(tuple(r)[:4] for r in fingerprint_index.incremental_dedup(docs, 1).collect())
    words = [f"w{k}" for k in range(30)]
    early = spark.createDataFrame([(9, " ".join(words))], "doc_id long, text string")
    late = spark.createDataFrame([(1, " ".join(words[5:25])), (2, " ".join(["x", *words[:14], "y"]))], "doc_id long, text string")
    index = fingerprint_index.FingerprintIndex(spark)
    assert [r.n_removed for r in fingerprint_index.incremental_dedup(early, 1, index=index).collect()] == [0]
    assert {r.doc_id: r.n_removed for r in fingerprint_index.incremental_dedup(late, 1, index=index).collect()} == {1: 20, 2: 14}


def plain_components(rows):
    sets = []
    for doc_id, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            by[t].append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, both in Counter(j for t in s for j in by[t] if j > i).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = Counter()
    for g in groups.values():
        least = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
        out.update((rows[i][0], len(sets[i]), least if len(sets[i]) else rows[i][0]) for i in g)
    return out


def test_jaccard_classes(spark, docs):
    want = plain_components([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert Counter(tuple(r)[:3] for r in jaccard_join.jaccard_classes(docs).collect()) == want


@pytest.mark.parametrize("dense", [8, 256])
def test_jaccard_near_copies_at_the_border(spark, monkeypatch, dense):
    """Chains and groups around J = 0.8, with several rounds of stars."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(1000)}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "FREQUENT_FROM", 20)
    monkeypatch.setattr(jaccard_join, "DENSE", dense)
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r)[:3] for r in got.collect()) == plain_components(rows)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, rid long, x int")
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert fingerprint_index.incremental_dedup(empty).count() == 0
    assert jaccard_join.jaccard_classes(empty).count() == 0


def test_index_rows_read_where_nothing_else_imports_compute(monkeypatch):
    """A worker in which pyarrow's functions aren't loaded as a side effect reads a group's rows."""
    import pyarrow as pa

    table = pa.Table.from_batches([fingerprint_index._rows([fingerprint_index._row(0, fingerprint_index.BATCH, docs=[7])])])
    monkeypatch.delattr(pa, "compute", raising=False)
    assert fingerprint_index._read(table, fingerprint_index.BATCH)["docs"].tolist() == [7]
