"""Language identification by cross parsing: a text is cut into the longest phrases that occur in a language's sample.

A suffix automaton of each language's sample accepts exactly its substrings, so reading a text
through it and starting again at the root wherever it has no way on gives the greedy parse into
longest matches. The language that needs fewest phrases, each costing the logarithm of its sample's
size over the text's bytes, wins; equal costs go to the first name. Letters A-Z count as a-z, and a run of
other ASCII characters as one space, so punctuation and markup tell nothing. Texts are cut into blocks that are
parsed in lockstep by array lookups; a block is then read on from the state of the one before it, so that phrases
are those of the whole text.

Null text and text without a letter give `und` and score 0. A text whose bytes occur in no sample
goes to the first name with score 0. Without training rows everything is `und`.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulequarry.llm._text import buffers, slices

#: Bounds of each language's sample: rows drawn, bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 48, 24_000
#: Languages whose tables stay in memory; those of others are laid out from their ways when used.
LAID_OUT = 16
BLOCK, LANES = 1024, 4096
#: A-Z as a-z; any other ASCII byte that isn't a letter as a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)
_LETTER = re.compile(r"[^\W\d_]")
_built: dict[str, "Automata"] = {}


def letters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' letters, with one space for each run of other ASCII bytes."""
    folded = _FOLD[raw]
    kept = folded != 32
    kept[1:] |= folded[:-1] != 32
    ends = np.concatenate([[0], np.cumsum(kept)])
    return folded[kept], ends[offsets]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions by state, of the smallest automaton of the substrings of `text` (Blumer et al.)."""
    to, link, length, last = [{}], [-1], [0], 0
    for c in text:
        cur = len(to)
        to.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = cur
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(to)
                to.append(dict(to[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return to


class Automata:
    """The automata of all languages as one table: next state by state and byte class; a restart is a negative number."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        used = sorted({b for s in samples.values() for b in s})
        self.cls = np.zeros(256, np.int64)
        self.cls[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        self.ways, self.tables, self.cost = [], [], []
        for k, lang in enumerate(self.langs):
            to = suffix_automaton(samples[lang])
            at = np.array([state * self.width + self.cls[c] for state, ways in enumerate(to) for c in ways], np.int64)
            self.ways.append((len(to), at, np.array([t for ways in to for t in ways.values()], np.int32)))
            if k < LAID_OUT:
                self.tables.append(self._table(k))
            self.cost.append(np.log2(max(2, len(samples[lang]))))

    def _table(self, k: int) -> np.ndarray:
        states, at, to = self.ways[k]
        table = np.full(states * self.width, -1, np.int32)
        table[at] = to
        table = table.reshape(states, self.width)
        root = np.where(table[0] >= 0, table[0], 0)
        # no way on: the phrase ends and the byte starts the next one, if any holds it
        table = np.where(table >= 0, table, -1 - root[None, :]).astype(np.int32)
        table[0] = -1 - root
        return table.ravel()

    def phrases(self, k: int, lanes: np.ndarray, length: np.ndarray, before: np.ndarray, carried: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of language k that end in each lane, and the state after it.

        lanes: (step, lane) byte classes, longest lanes first; before: the lane that a lane goes on from, -1 for a text's
        first, -2 for one that goes on from state `carried`. All lanes are first read from the root at once; then each
        is read again from where the lane before it ended, until both ways are in the same state and so stay together.
        """
        table = self.tables[k] if k < len(self.tables) else self._table(k)
        steps, n = lanes.shape
        trace, ended = np.zeros((steps, n), np.int32), np.zeros((steps, n), bool)
        state = np.zeros(n, np.int64)
        for t, w in enumerate(np.searchsorted(-length, -np.arange(steps), side="left").tolist()):
            step = table[state[:w] * self.width + lanes[t, :w]]
            ended[t, :w] = step < 0
            trace[t, :w] = state[:w] = np.where(step < 0, -1 - step, step)
        end = trace[length - 1, np.arange(n)].astype(np.int64)
        todo = np.flatnonzero(before != -1)
        while len(todo):
            on, state, t = todo, np.where(before[todo] == -2, carried, end[before[todo]]), 0
            was = end.copy()
            while len(on):
                step = table[state * self.width + lanes[t, on]]
                over = step < 0
                state = np.where(over, -1 - step, step).astype(np.int64)
                apart = state != trace[t, on]
                trace[t, on], ended[t, on] = state, over
                last = length[on] == t + 1
                end[on[last]] = state[last]
                on, state, t = on[apart & ~last], state[apart & ~last], t + 1
            moved = np.flatnonzero(end != was)
            todo = np.flatnonzero((before >= 0) & np.isin(before, moved)) if len(moved) else moved
        return ended.sum(0), end


def automata(samples: dict[str, bytes]) -> Automata:
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Automata(samples)
    return _built[key]


def held_out() -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2


def samples(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Up to `size` bytes of text for each language, from documents that aren't held out.

    Rows are drawn by a hash of the id at a rate that gives about `rows` of a language, so what
    reaches the driver is bounded by `rows` documents of a language on average; each language's rows are used in hash order.
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & (F.octet_length("text") > 0) & ~F.coalesce(held_out(), F.lit(False)))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, rows / n))])[F.col("lang")]
    h = F.xxhash64("doc_id", F.length("text"))
    drawn = known.withColumn("h", h).filter((F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) < rate)
    # no more of a text than a sample has room for, and rows repeated in full once
    drawn = drawn.select("lang", "h", F.left("text", F.lit(size)).alias("text")).distinct().collect()
    out = {k: b"" for k in counts}
    for r in sorted(drawn, key=lambda r: (r.h, r.text)):
        if len(out[r.lang]) < size:
            out[r.lang] += letters(np.frombuffer(r.text.encode(), np.uint8), np.zeros(1, np.int64))[0].tobytes()[:size]
    return {k: v[:size] for k, v in out.items() if v}


def identify(docs: DataFrame, learned: dict[str, bytes]) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score: one less the winner's cost over the next one's."""

    def judge(batches):
        known = automata(learned) if learned else None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            raw, offsets = buffers(texts)
            pred, score = ["und"] * len(ids), [0.0] * len(ids)
            for first, last in slices(offsets, 1 << 22):
                if known is None:
                    break
                folded, own = letters(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                cls = known.cls[folded]
                sizes = np.diff(own)
                blocks = -(-sizes // BLOCK)
                row = np.repeat(np.arange(last - first), blocks)
                number = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                at = own[:-1][row] + number * BLOCK
                length = np.minimum(BLOCK, own[1:][row] - at)
                if not len(row):
                    continue
                total = np.zeros((len(known.langs), last - first))
                carried = [0] * len(known.langs)
                for a in range(0, len(row), LANES):
                    b = min(len(row), a + LANES)
                    order = np.argsort(-length[a:b], kind="stable")
                    lane = np.empty(b - a, np.int64)
                    lane[order] = np.arange(b - a)
                    goes_on = number[a:b] > 0
                    before = np.where(goes_on, np.concatenate([[-2], lane[:-1]]), -1)[order]
                    steps = int(length[a:b].max())
                    lanes = cls[np.minimum(at[a:b][order] + np.arange(steps)[:, None], len(cls) - 1)]
                    for k in range(len(known.langs)):
                        counts, end = known.phrases(k, lanes, length[a:b][order], before, carried[k])
                        total[k] += np.bincount(row[a:b][order], counts, last - first)
                        carried[k] = int(end[lane[-1]])
                total *= np.array(known.cost)[:, None]
                best = total.argmin(0)
                ranked = np.sort(total, 0)
                for i in range(last - first):
                    text = raw[offsets[first + i] : offsets[first + i + 1]].tobytes().decode("utf-8", "replace")
                    if sizes[i] and _LETTER.search(text):
                        pred[first + i] = known.langs[best[i]]
                        score[first + i] = float(1 - ranked[0, i] / ranked[1, i]) if len(ranked) > 1 else 1.0
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, lang_pred string, score double")
