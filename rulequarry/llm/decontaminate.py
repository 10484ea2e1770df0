"""Benchmark decontamination by greedy string tiling.

Tokens are the words of a text with A-Z as a-z and without punctuation at either end. A document
and a benchmark item that share a run of five tokens (a seed) are tiled: the longest common run of
unmarked tokens is found by running Karp-Rabin sums, marked in both, and so on until no
common run of five is left. The share of the item's tokens in tiles is its coverage, which does not
depend on the order in which passages were copied. An item shorter than five tokens is one tile
or none. Coverage of 0.5 or more of an item's tokens makes a document contaminated.

Null or empty texts, and items without tokens, match nothing. Repeated rows are judged one by one, and so are
repeated items; an item without id is matched under a null id. The result's `matches` replaces a column of that name.
Tokens and seeds of the benchmark are made into arrays once and shipped to the tasks while its text is at most MAX_SHIPPED bytes,
which is checked; a larger benchmark is cut into parts of that size, each judged in a pass of its own that leaves matches only.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rulequarry.llm._scratch import written
from rulequarry.llm._text import FOLD, Words, buffers, grams, mix, powers, slices

SEED_LENGTH, MIN_COVERAGE = 5, 0.5
MAX_SHIPPED = 32 << 20
#: Fixed set of bytes stripped from the ends of words.
EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_IS_EDGE = np.zeros(256, bool)
_IS_EDGE[list(EDGE)] = True


def strip_edges(words: Words) -> None:
    """Narrow each word by the punctuation at its ends; drop words of punctuation only."""
    raw, s, e = words.raw, words.starts.copy(), words.ends.copy()
    todo = np.flatnonzero(s < e)
    while len(todo):
        todo = todo[_IS_EDGE[raw[s[todo]]]]
        s[todo] += 1
        todo = todo[s[todo] < e[todo]]
    todo = np.flatnonzero(s < e)
    while len(todo):
        todo = todo[_IS_EDGE[raw[e[todo] - 1]]]
        e[todo] -= 1
        todo = todo[s[todo] < e[todo]]
    kept = s < e
    words.first = np.concatenate([[0], np.cumsum(kept)])[words.first]
    words.starts, words.ends = s[kept], e[kept]


class Running:
    """Karp-Rabin sums of an array of token hashes: that of any run of k tokens comes from two prefix sums."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.up, self.down = powers(len(x) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x.copy()) * self.up[: len(x)])])

    def runs(self, k: int) -> np.ndarray:
        """The sums of the runs of k tokens, by where they start."""
        n = len(self.x) - k + 1
        return (self.sums[k:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED_LENGTH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of token hashes: (start in doc, start in item, length), longest first.

    Of runs of one length, that which starts first in doc and then first in item is marked first.
    """
    least = min(least, len(item))
    out: list[tuple[int, int, int]] = []
    if not least or len(doc) < least:
        return out
    free_doc, free_item = np.isin(doc, item), np.isin(item, doc)
    in_doc, in_item = Running(doc), Running(item)

    def common(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and sums of the unmarked runs of k tokens, in doc those whose sum is in item too, and in item."""
        at_item = np.flatnonzero(_all_free(free_item, k))
        known = in_item.runs(k)[at_item]
        at_doc = np.flatnonzero(_all_free(free_doc, k))
        sums = in_doc.runs(k)[at_doc]
        hit = np.isin(sums, known)
        return at_doc[hit], sums[hit], at_item, known

    high = min(len(doc), len(item))
    while high >= least and len(common(least)[0]):
        low = least
        while low < high:  # the longest run: a longer one implies all shorter ones
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(common(mid)[0]) else (low, mid - 1)
        k = low
        at_doc, sums, at_item, known = common(k)
        where: dict[int, list[int]] = {}
        for j, h in zip(at_item[::-1].tolist(), known[::-1].tolist()):
            where.setdefault(h, []).append(j)
        for i, h in zip(at_doc.tolist(), sums.tolist()):
            left = where.get(h)
            if not left or not free_doc[i : i + k].all():
                continue
            while left and not free_item[left[-1] : left[-1] + k].all():
                left.pop()  # marked for good
            for j in reversed(left):
                if free_item[j : j + k].all() and np.array_equal(doc[i : i + k], item[j : j + k]):
                    out.append((i, j, k))
                    free_doc[i : i + k] = free_item[j : j + k] = False
                    break
        high = k - 1
    return out


def _all_free(free: np.ndarray, k: int) -> np.ndarray:
    if len(free) < k:
        return np.zeros(0, bool)
    sums = np.concatenate([[0], np.cumsum(free)])
    return sums[k:] - sums[:-k] == k


def _tokens(text: str | None) -> np.ndarray:
    raw, offsets = buffers(pa.array([text], pa.string()))
    words = Words(raw, offsets, 0, 1)
    strip_edges(words)
    return words.hashes(FOLD)


class Benchmark:
    """Token hashes of the items end to end, and the seeds that lead to them: runs of `least` tokens, or all of a shorter item.

    It is made once, of all items at a time, and holds arrays only, so a task that gets it by broadcast has it at once.
    """

    def __init__(self, items: list[tuple[int | None, str]], least: int):
        raw, offsets = buffers(pa.array([text for _, text in items], pa.large_string()))
        words = Words(raw, offsets, 0, len(items))
        strip_edges(words)
        full = np.flatnonzero(np.diff(words.first))
        self.ids = [items[k][0] for k in full.tolist()]
        self.tokens, self.first = words.hashes(FOLD), np.append(words.first[full], len(words))
        sizes = np.diff(self.first)
        self.index = {}
        for n in sorted({min(least, k) for k in np.unique(np.minimum(sizes, least)).tolist()}):
            sums, owner = grams(self.tokens, n), np.repeat(np.arange(len(full)), sizes)
            starts = np.flatnonzero((np.arange(len(owner)) + n <= np.repeat(self.first[1:], sizes)) & (np.minimum(sizes, least)[owner] == n))
            s, o = sums[starts], owner[starts]
            order = np.lexsort((o, s))
            s, o = s[order], o[order]
            new = np.r_[True, (s[1:] != s[:-1]) | (o[1:] != o[:-1])]
            sieve = np.zeros(1 << 20, bool)
            sieve[(s & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.index[n] = s[new], o[new], sieve

    def item(self, k: int) -> np.ndarray:
        return self.tokens[self.first[k] : self.first[k + 1]]

    def candidates(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) pairs that share a seed."""
        found: set[tuple[int, int]] = set()
        for n, (seeds, owners, sieve) in self.index.items():
            sums = grams(words, n)
            if not len(sums):
                continue
            row_end = np.repeat(first[1:], np.diff(first))[: len(sums)]
            inside = np.arange(len(sums)) + n <= row_end
            at = np.flatnonzero(sieve[(sums & np.uint64((1 << 20) - 1)).astype(np.int64)] & inside)
            a, b = np.searchsorted(seeds, sums[at]), np.searchsorted(seeds, sums[at], side="right")
            hit = b > a
            for i, x, y in zip(at[hit].tolist(), a[hit].tolist(), b[hit].tolist()):
                row = int(np.searchsorted(first, i, side="right")) - 1
                found.update((row, int(k)) for k in owners[x:y])
        return sorted(found)


def coverage(docs: DataFrame, benchmark: DataFrame, least: int = SEED_LENGTH) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> docs' columns and matches, an array of (item_id, covered, length, tiles)."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").filter(F.octet_length("text") > 0)
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(size) // MAX_SHIPPED))

    def shipped(part: int):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        return spark.sparkContext.broadcast(Benchmark(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r)), least))

    if parts == 1:
        return _judged(docs, shipped(0), least)
    # the documents are written once, with a number; a part's pass leaves only the rows that match it
    columns = [c for c in docs.columns if c != "matches"]
    numbered = written(docs.select(*columns, F.monotonically_increasing_id().alias("__row")), "numbered")
    found = []
    for part in range(parts):
        known = shipped(part)
        found.append(written(_judged(numbered.select("__row", "text"), known, least).filter(F.size("matches") > 0).select("__row", "matches"), "matches"))
        known.unpersist()
    every = reduce(DataFrame.unionByName, found).groupBy("__row").agg(F.flatten(F.collect_list("matches")).alias("matches"))
    none = F.array().cast(every.schema["matches"].dataType)
    return numbered.join(every, "__row", "left").select(*columns, F.coalesce("matches", none).alias("matches"))


MATCHES = "array<struct<item_id: bigint, covered: bigint, length: bigint, tiles: array<struct<doc_start: bigint, item_start: bigint, length: bigint>>>>"


def _judged(docs: DataFrame, shipped, least: int) -> DataFrame:
    docs = docs.drop("matches")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"matches {MATCHES}").fields])
    at = docs.columns.index("text")

    def judge(batches):
        known = shipped.value
        arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("covered", pa.int64()), ("length", pa.int64()), ("tiles", pa.list_(pa.struct([("doc_start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())])))]))
        for batch in batches:
            raw, offsets = buffers(batch.column(at))
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for first, last in slices(offsets):
                words = Words(raw, offsets, first, last)
                strip_edges(words)
                hashes = words.hashes(FOLD)
                for row, k in known.candidates(hashes, words.first):
                    doc = hashes[words.first[row] : words.first[row + 1]]
                    item = known.item(k)
                    found = tiles(doc, item, least)
                    if found:
                        out[first + row].append({"item_id": known.ids[k], "covered": sum(t[2] for t in found), "length": len(item), "tiles": [dict(zip(("doc_start", "item_start", "length"), t)) for t in found]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, "matches"])

    return docs.mapInArrow(judge, schema)


def contaminated(min_coverage: float = MIN_COVERAGE):
    """Of coverage()'s rows: whether an item's tokens are covered to min_coverage or more."""
    return F.exists("matches", lambda m: m["covered"] >= F.lit(min_coverage) * m["length"])
