"""Substring dedup over a log-structured fingerprint index.

A window is 13 consecutive words. Its fingerprint is the least hash of the nine 5-word runs in it,
so equal windows have equal fingerprints, and neighbours mostly share one: windows next to each other with one
fingerprint are a stretch, about a fifth as many as words. Runs of words that are frequent in a bounded sample count as larger than all
others, so the edges of a common passage don't gather the different windows around it under one fingerprint.

The index is a list of immutable runs. A run has, for each fingerprint, the hashes of its windows that no earlier run has, in
arrays sorted by fingerprint and dealt into groups by its low bits; rows of a group are stored together. A batch of documents is
dealt into the same groups, merge-joined there with every run, and what shares a fingerprint is verified: a window
is equal to another if fingerprint and a hash of all its words, made from other tables, are (128 bits). What is new becomes a
run. Runs are compacted in tiers, two of one tier into one of the next, when a further batch comes, so an entry is rewritten as often as
the logarithm of the batches. The index holds all that verifying needs: no earlier text is read again, and a batch
costs its own size and one pass over the runs.

A task first resolves what its own documents share, and sends of each window those of its least document only, so a passage that
very many documents have comes once from each task. Windows to remove go back to their documents as places, keyed by doc_id and a hash of the text.

Null or empty text has no words. Rows of one doc_id in a batch never remove each other's windows; a null
doc_id counts as larger than all others, and its rows in a batch as one document. Documents of earlier batches
count as smaller than all of a later one, whatever their ids.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulequarry.llm._scratch import bucketed, drop, opened, written
from rulequarry.llm._text import OTHER, Words, buffers, grams, slices, sliding_min

WINDOW, GRAM = 13, 5
BATCHES = 4
LAST = (1 << 63) - 1  # stands for a null doc_id
EARLIER = -(1 << 63)  # stands for any document of an earlier batch
#: Documents of the sample (expected) in which runs of words are counted, the share of them that makes a run frequent, and the most such runs.
SAMPLE, FREQUENT, MAX_FREQUENT = 4096, 0.004, 200_000
#: Bytes of a batch's text that make a group; stretches that a task holds; fingerprints in a row of a run.
GROUP_BYTES, HELD, ROW = 32 << 20, 1 << 19, 1 << 16
_SIEVE = (1 << 20) - 1

#: Rows of a group. BATCH: stretches of a batch; GONE: places of windows to remove; RUN: an index run's fingerprints, numbers of windows and windows.
BATCH, GONE, RUN = 0, 1, 2
_ARRAYS = {"prints": np.uint64, "docs": np.int64, "hashes": np.int64, "words": np.uint32, "sizes": np.uint32, "windows": np.uint64}
_SCHEMA = "bucket int, kind int, " + ", ".join(f"{c} binary" for c in _ARRAYS)
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in _ARRAYS)])


def _row(bucket: int, kind: int, **arrays: np.ndarray) -> tuple:
    return (bucket, kind, *(np.ascontiguousarray(arrays[c], t).tobytes() if c in arrays else None for c, t in _ARRAYS.items()))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def _read(table: pa.Table, kind: int) -> dict[str, np.ndarray]:
    """The arrays of all rows of a kind, end to end."""
    rows = table.filter(pc.equal(table["kind"], kind))
    return {c: np.frombuffer(b"".join(x for x in rows[c].to_pylist() if x is not None), t) for c, t in _ARRAYS.items()}


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each size, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Order:
    """The order of 5-word runs in which a window's least is taken: by hash, frequent ones last."""

    def __init__(self, often: np.ndarray):
        self.often = np.sort(often.astype(np.uint64))
        self.sieve = np.zeros(_SIEVE + 1, bool)
        self.sieve[(self.often & np.uint64(_SIEVE)).astype(np.int64)] = True

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        out = grams(hashes, GRAM) >> np.uint64(1)
        if len(self.often):
            at = np.flatnonzero(self.sieve[(out & np.uint64(_SIEVE)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.often, out[at]), len(self.often) - 1)
            at = at[self.often[place] == out[at]]
            out[at] |= np.uint64(1 << 63)
        return out


def _stretches(words: Words, order: Order) -> tuple[np.ndarray, ...]:
    """Of the stretches of a slice: fingerprint, row, first word in the row and windows, and then the hashes of all windows."""
    at = np.flatnonzero(words.windows(WINDOW))
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    prints = sliding_min(order.ranks(words.hashes()), WINDOW - GRAM + 1)[at]
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[at]
    new = np.r_[True, (prints[1:] != prints[:-1]) | (row[1:] != row[:-1])]
    k = np.flatnonzero(new)
    return prints[k], row[k], at[k] - words.first[row[k]], np.diff(np.r_[k, len(at)]), grams(words.hashes(OTHER), WINDOW)[at]


def _later(prints: np.ndarray, windows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether each window is in a smaller document too; then, of each different (fingerprint, window) in their order, both and its least document."""
    by = np.lexsort((docs, windows, prints))
    p, w, d = prints[by], windows[by], docs[by]
    first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (w[1:] != w[:-1])]) if len(by) else by
    later = np.zeros(len(by), bool)
    later[by] = d > np.repeat(d[first], np.diff(np.r_[first, len(by)]))
    return later, p[first], w[first], d[first]


def _places(gone: np.ndarray, stretch: np.ndarray, word: np.ndarray, docs: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """Windows to remove, as runs of neighbours; stretch and word of each window, docs and hashes of each stretch."""
    at = np.flatnonzero(gone)
    d, h, w = docs[stretch[at]], hashes[stretch[at]], word[at]
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (w[1:] != w[:-1] + 1)]) if len(at) else at
    return {"docs": d[first], "hashes": h[first], "words": w[first], "sizes": np.diff(np.r_[first, len(at)])}


def _scan(rows: DataFrame, order: Order, groups: int) -> DataFrame:
    """(order_id, hash, text) -> the batch's stretches by group, and what is to be removed by documents of one task alone."""

    def flush(held):
        p, d, h, w, n, u = map(np.concatenate, zip(*held))
        starts = np.cumsum(n) - n
        stretch = np.repeat(np.arange(len(n)), n)
        word = _spread(w, n)
        by = np.argsort(p, kind="stable")
        same = p[by][1:] == p[by][:-1]
        again = by[np.r_[False, same] | np.r_[same, False]]
        windows = _spread(starts[again], n[again])
        gone = np.zeros(len(u), bool)
        gone[windows] = _later(p[stretch[windows]], u[windows], d[stretch[windows]])[0]
        out = [_row(int(p[0]) & (groups - 1), GONE, **_places(gone, stretch, word, d, h))] if gone.any() else []
        # what is left of each stretch, in runs of windows, by group
        new = np.r_[True, (stretch[1:] != stretch[:-1]) | (gone[1:] != gone[:-1])]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(u)])
        left = ~gone[first]
        first, size = first[left], size[left]
        group = (p[stretch[first]] & np.uint64(groups - 1)).astype(np.int64)
        by = np.argsort(group, kind="stable")
        first, size, group = first[by], size[by], group[by]
        of = stretch[first]
        p, d, h, w, u = p[of], d[of], h[of], word[first], u[_spread(first, size)]
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else group
        ends = np.r_[0, np.cumsum(size)]
        for a, b in zip(cuts.tolist(), np.r_[cuts[1:], len(group)].tolist()):
            out.append(_row(int(group[a]), BATCH, prints=p[a:b], docs=d[a:b], hashes=h[a:b], words=w[a:b], sizes=size[a:b], windows=u[ends[a] : ends[b]]))
        return _rows(out)

    def judge(batches):
        held, n = [], 0
        for batch in batches:
            raw, offsets = buffers(batch.column(2))
            docs, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, last in slices(offsets):
                prints, row, word, size, windows = _stretches(Words(raw, offsets, first, last), order)
                if len(prints):
                    held.append((prints, docs[row + first], hashes[row + first], word, size, windows))
                    n += len(prints)
                if n >= HELD:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return rows.select("order_id", "hash", "text").mapInArrow(judge, _SCHEMA)


def _run_rows(bucket: int, prints: np.ndarray, sizes: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> list[tuple]:
    """Rows of a run: segments of windows by fingerprint, those of one fingerprint joined."""
    by = np.argsort(prints, kind="stable")
    prints, sizes, starts = prints[by], sizes[by], starts[by]
    out = []
    first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(prints) else by
    for a in range(0, len(first), ROW):
        low, high = first[a], first[a + ROW] if a + ROW < len(first) else len(prints)
        out.append(_row(bucket, RUN, prints=prints[first[a : a + ROW]], sizes=np.add.reduceat(sizes[low:high].astype(np.int64), first[a : a + ROW] - low), windows=windows[_spread(starts[low:high], sizes[low:high])]))
    return out


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes, dtype=np.int64) - sizes


def _merged(table: pa.Table) -> pa.Table:
    """A group of a batch with that of all runs -> its places to remove, and its rows of the batch's run."""
    bucket = table["bucket"][0].as_py()
    new, old, gone = _read(table, BATCH), _read(table, RUN), _read(table, GONE)
    out = [_row(bucket, GONE, **{c: gone[c] for c in ("docs", "hashes", "words", "sizes")})] if len(gone["docs"]) else []
    p, n, u = new["prints"], new["sizes"].astype(np.int64), new["windows"]
    if not len(p):
        return pa.Table.from_batches([_rows(out)])
    starts, stretch = _starts(n), np.repeat(np.arange(len(n)), n)
    by = np.argsort(p, kind="stable")
    s = p[by]
    same = s[1:] == s[:-1]
    # to verify: stretches whose fingerprint another has, or a run; and those so long that a window may be in them twice
    verify = np.r_[False, same] | np.r_[same, False] | (n[by] > WINDOW - GRAM + 1)
    if len(old["prints"]):
        known = np.unique(old["prints"])
        verify |= known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s
    again, alone = by[verify], by[~verify]
    windows = _spread(starts[again], n[again])
    prints = np.unique(p[again])
    old_n = old["sizes"].astype(np.int64)
    if len(prints) and len(old_n):
        hit = np.flatnonzero(prints[np.minimum(np.searchsorted(prints, old["prints"]), len(prints) - 1)] == old["prints"])
    else:
        hit = np.zeros(0, np.int64)
    old_windows = _spread(_starts(old_n)[hit], old_n[hit])
    later, q, v, least = _later(
        np.concatenate([p[stretch[windows]], np.repeat(old["prints"][hit], old_n[hit])]),
        np.concatenate([u[windows], old["windows"][old_windows]]),
        np.concatenate([new["docs"][stretch[windows]], np.full(len(old_windows), EARLIER)]),
    )
    flags = np.zeros(len(u), bool)
    flags[windows] = later[: len(windows)]
    if flags.any():
        out.append(_row(bucket, GONE, **_places(flags, stretch, _spread(new["words"].astype(np.int64), n), new["docs"], new["hashes"])))
    fresh = least != EARLIER
    q, v = q[fresh], v[fresh]
    out += _run_rows(bucket, np.concatenate([p[alone], q]), np.concatenate([n[alone], np.ones(len(q), np.int64)]), np.concatenate([starts[alone], len(u) + np.arange(len(q))]), np.concatenate([u, v]))
    return pa.Table.from_batches([_rows(out)])


def _compacted(table: pa.Table) -> pa.Table:
    old = _read(table, RUN)
    n = old["sizes"].astype(np.int64)
    return pa.Table.from_batches([_rows(_run_rows(table["bucket"][0].as_py(), old["prints"], n, _starts(n), old["windows"]))])


class FingerprintIndex:
    """Runs, each a table stored by group, with their tiers; how many groups there are, and which 5-word runs count as frequent.

    Both are settled by the first documents, as later ones must be dealt alike; any choice gives the same results.
    """

    def __init__(self, spark: SparkSession, groups: int | None = None, often: list[int] | None = None):
        self.spark, self.groups, self.often = spark, groups, often
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[DataFrame] = []
        self.tiers: list[int] = []
        self._noted: set[str] = set()  # tables that a note of save() names; they stay until the next one
        self._stale: list[DataFrame] = []

    def prepare(self, rows: DataFrame, n_rows: int, batch_bytes: int) -> None:
        """Settle groups and frequent runs of words, if they aren't yet."""
        if self.groups is None:
            least = max(4 * self.buckets, batch_bytes // GROUP_BYTES)
            self.groups = 1 << (least - 1).bit_length()
        if self.often is None:
            share = 10**6 if n_rows <= SAMPLE else max(1, 10**6 * SAMPLE // n_rows)
            sample = rows.filter(F.pmod(F.xxhash64("order_id", "hash"), F.lit(10**6)) < share)
            counts = _grams(sample).groupBy("gram").agg(F.count("*").alias("c")).filter(F.col("c") >= max(8, FREQUENT * min(n_rows, SAMPLE)))
            self.often = counts.orderBy(F.desc("c"), "gram").limit(MAX_FREQUENT).select("gram").toArrow().column("gram").to_pylist()

    def add(self, rows: DataFrame) -> DataFrame:
        """A batch (order_id, hash, text) -> (order_id, hash, starts): the windows to remove of its rows that have any, written; afterwards the batch is in the index."""
        self.compact()
        dealt = _scan(rows, Order(np.array(self.often or [], np.uint64)), self.groups).repartition(self.buckets, "bucket")
        every = reduce(DataFrame.unionByName, [r.filter(F.col("kind") == RUN) for r in self.runs], dealt)
        run = bucketed(every.groupBy("bucket").applyInArrow(_merged, _SCHEMA), "bucket", "run", self.buckets)
        self.runs.append(run)
        self.tiers.append(0)
        places = _unpacked(run.filter(F.col("kind") == GONE).select("docs", "hashes", "words", "sizes"))
        return written(places.groupBy("order_id", "hash").agg(F.collect_list(F.struct("word", "n")).alias("starts")), "gone")

    def compact(self) -> None:
        """Merge the last two runs while they are of one tier."""
        while len(self.runs) > 1 and self.tiers[-1] == self.tiers[-2]:
            pair, tier = self.runs[-2:], self.tiers[-1] + 1
            rows = pair[0].unionByName(pair[1]).filter(F.col("kind") == RUN)
            merged = bucketed(rows.groupBy("bucket").applyInArrow(_compacted, _SCHEMA), "bucket", "run", self.buckets)
            for old in pair:
                if old._scratch_path in self._noted:
                    self._stale.append(old)
                else:
                    drop(old)
            self.runs[-2:], self.tiers[-2:] = [merged], [tier]

    def save(self, path: str) -> None:
        """Note in a new folder which tables make up the index; they stay where they are.

        Until the next save() no table that a note names is dropped: if a session ends between add() and
        save(), the last note opens the index as it was, and what came since is to be added again.
        """
        runs = [(x._scratch_table, x._scratch_path, x.schema.simpleString()) for x in self.runs]
        note = {"runs": runs, "tiers": self.tiers, "groups": self.groups, "often": self.often, "buckets": self.buckets}
        self.spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.text(path)
        for old in self._stale:
            drop(old)
        self._stale, self._noted = [], {x[1] for x in runs}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index that was noted in a folder, also in another session."""
        note = json.loads(spark.read.text(path).first().value)
        index = cls(spark, note["groups"], note["often"])
        index.buckets, index.tiers = note["buckets"], note["tiers"]
        index.runs = [opened(spark, *x, ["bucket"], index.buckets) for x in note["runs"]]
        index._noted = {x[1] for x in note["runs"]}
        return index

    def drop(self) -> None:
        for table in (*self.runs, *self._stale):
            drop(table)
        self.runs, self.tiers, self._stale = [], [], []


def _grams(rows: DataFrame) -> DataFrame:
    """(gram), once for each text: the ranks of its 5-word runs."""

    def judge(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            for first, last in slices(offsets):
                words = Words(raw, offsets, first, last)
                ranks = Order(np.zeros(0, np.uint64)).ranks(words.hashes())
                at = np.flatnonzero(words.windows(GRAM))
                row = np.repeat(np.arange(last - first), np.diff(words.first))[at]
                ranks = ranks[at]
                by = np.lexsort((ranks, row))
                row, ranks = row[by], ranks[by]
                new = np.r_[True, (row[1:] != row[:-1]) | (ranks[1:] != ranks[:-1])] if len(by) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(ranks[new].view(np.int64))], names=["gram"])

    return rows.select("text").mapInArrow(judge, "gram long")


def _unpacked(rows: DataFrame) -> DataFrame:
    """Places of windows as rows (order_id, hash, word, n)."""
    names = {"docs": "order_id", "hashes": "hash", "words": "word", "sizes": "n"}

    def judge(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                arrays = [np.frombuffer(batch.column(c)[k].as_py(), _ARRAYS[c]).astype(np.int64) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=list(names.values()))

    return rows.select(*names).mapInArrow(judge, ", ".join(f"{c} long" for c in names.values()))


def _kept(rows: DataFrame, texts: bool) -> DataFrame:
    """(doc_id, text, starts) -> the digest and the kept words; starts: of the windows to remove."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 5 if texts else 4]

    def judge(batches):
        for batch in batches:
            starts = batch.column(2)
            offsets = np.r_[0, np.cumsum(np.nan_to_num(starts.value_lengths().to_numpy(zero_copy_only=False).astype(float)))].astype(np.int64)
            flat = starts.flatten()
            word, n = (flat.field(c).to_numpy() for c in ("word", "n"))
            out = []
            for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist())):
                words = (text or b"").split()
                total, a, b = len(words), offsets[k], offsets[k + 1]
                if b > a:
                    steps = np.bincount(word[a:b], minlength=total + 1)[: total + 1] - np.bincount(word[a:b] + n[a:b] + WINDOW - 1, minlength=total + 1)[: total + 1]
                    words = list(compress(words, (np.cumsum(steps)[:total] == 0).tolist()))
                out.append((doc_id, total, total - len(words), b" ".join(words)))
            ids, totals, removed, kept = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode() for k in kept] if texts else [None] * len(kept), pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            ).select(names)

    return rows.select("doc_id", "text", "starts").mapInArrow(judge, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)


def incremental_dedup(docs: DataFrame, batches: int = BATCHES, texts: bool = True, index: FingerprintIndex | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256 and, if texts, kept_text.

    The documents come to the index in `batches` batches by rising doc_id; the result is the same for any number.
    A given index has earlier documents already and keeps these too; without one, an index is made and dropped.
    """
    own = index is None
    index = index or FingerprintIndex(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("order_id"), F.xxhash64("text").alias("hash"), "text")
    share = F.array(*[F.lit(k / batches) for k in range(1, max(2, batches))])
    facts = rows.agg(F.percentile_approx("order_id", share, 1000).alias("q"), F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    index.prepare(rows, facts.n, facts.size // batches)
    cuts = sorted(set(facts.q or [])) if batches > 1 else []
    gone = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        batch = rows
        if low is not None:
            batch = batch.filter(F.col("order_id") > low)
        if high is not None:
            batch = batch.filter(F.col("order_id") <= high)
        gone.append(index.add(batch))
    if own:
        index.drop()
    return _kept(rows.join(reduce(DataFrame.unionByName, gone), ["order_id", "hash"], "left"), texts)
