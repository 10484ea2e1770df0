"""Quality rules: a linear-chain CRF labels each line as content or boilerplate, and the share of content decides.

Lines of a document form one chain. Each line has a few features read from its bytes; weights
and transitions are learned from the labelled documents, whose lines take the label of their
document except that a line repeated from above is boilerplate. Viterbi gives the best labels;
a document stays if at least half of its words stand in content lines.

Null or empty text has no words, so it fails the base rule. Repeated rows are judged one by one;
columns other than the id and the text pass through untouched.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
NOT_CHARS = SPACE + bytes(range(0x80, 0xC0))
UPPER, LOWER, DIGITS = (bytes(range(a, b)) for a, b in ((65, 91), (97, 123), (48, 58)))
N_FEATURES = 12
#: Bounds of the sample that the weights are learned from: documents, bytes of a document, and lines of all.
MAX_TRAIN_DOCS, MAX_TRAIN_BYTES, MAX_TRAIN_LINES = 1500, 20_000, 100_000
MIN_WORDS, MIN_SHARE = 50, 0.5


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated 3-word windows."""
    words = text.split()
    n = len(words)
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line.strip(SPACE):
            if line in seen:
                dup += 1
            seen.add(line)
    repeats = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            reach = 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeats += i + 3 - max(i, reach)
                    reach = i + 3
    return n, len(text.translate(None, NOT_CHARS)), len(text) - len(text.translate(None, SYMBOLS)), dup, repeats


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A row of features and a number of words for each line that has a word."""
    rows, sizes, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        without = len(line.translate(None, SYMBOLS))
        upper, lower = size - len(line.translate(None, UPPER)), size - len(line.translate(None, LOWER))
        digits = size - len(line.translate(None, DIGITS))
        repeated = line in seen
        seen.add(line)
        end = words[-1][-1:]
        rows.append(
            (
                1.0,
                min(1.0, (size - without) / n),
                min(1.0, line.count(b"|") / n),
                min(1.0, line.count(b"!") / n),
                upper / (upper + lower + 1),
                digits / size,
                float(repeated),
                float(n < 3),
                float(n < 10),
                float(end in b".?\"'"),
                min(2.0, size / n / 8),
                len(set(words)) / n,
            )
        )
        sizes.append(n)
    return np.array(rows, dtype=np.float64).reshape(-1, N_FEATURES), np.array(sizes, dtype=np.int64)


class Crf:
    """Two labels (0 boilerplate, 1 content): weights of content by feature, scores of label pairs, scores of the first label."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray, first: np.ndarray):
        self.weights, self.pairs, self.first = weights, pairs, first

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The labels of highest total score; equal scores give content."""
        n = len(x)
        if not n:
            return np.zeros(0, np.int8)
        (p00, p01), (p10, p11) = self.pairs.tolist()
        back = []
        emit = (x @ self.weights).tolist()
        a, b = float(self.first[0]), float(self.first[1]) + emit[0]
        for e in emit[1:]:
            to0, to1 = b + p10 >= a + p00, b + p11 >= a + p01
            back.append((to0, to1))
            a, b = (b + p10 if to0 else a + p00), (b + p11 if to1 else a + p01) + e
        label = int(b >= a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return np.array(out[::-1], np.int8)

    @staticmethod
    def fit(chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = 150, rate: float = 0.5, decay: float = 1e-3) -> "Crf":
        """Maximum likelihood by gradient ascent; forward and backward sums run over chains of like length at once, padded."""
        chains = sorted((c for c in chains if len(c[1])), key=lambda c: len(c[1]))
        weights, pairs, first = np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(2)
        if not chains:
            return Crf(np.eye(N_FEATURES)[0], pairs, first)
        total = sum(len(y) for _, y in chains)
        groups: list[list] = []
        for c in chains:  # padding at most doubles a chain
            if not groups or len(c[1]) > 2 * len(groups[-1][0][1]):
                groups.append([])
            groups[-1].append(c)
        padded = [Padded(g) for g in groups]
        for _ in range(rounds):
            by_weight, by_pair, by_first = np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(2)
            for p in padded:
                content, likely = p.expected(weights, pairs, first)
                by_weight += np.einsum("dt,dtf->f", np.where(p.on, p.y - content, 0), p.x)
                by_pair += p.seen_pairs - likely
                start = (p.y[:, 0] - content[:, 0]).sum()
                by_first += (-start, start)
            weights = weights + rate * (by_weight / total * 4 - decay * weights)
            pairs = pairs + rate * (by_pair / total - decay * pairs)
            first = first + rate * (by_first / total - decay * first)
        return Crf(weights, pairs, first)


class Padded:
    """Chains of like length side by side, for the forward and backward sums of all at once."""

    def __init__(self, chains: list[tuple[np.ndarray, np.ndarray]]):
        longest = max(len(y) for _, y in chains)
        self.x = np.zeros((len(chains), longest, N_FEATURES))
        self.y = np.zeros((len(chains), longest), int)
        self.on = np.zeros((len(chains), longest), bool)
        for i, (a, b) in enumerate(chains):
            self.x[i, : len(b)], self.y[i, : len(b)], self.on[i, : len(b)] = a, b, True
        self.both, self.last = self.on[:, 1:], self.on.sum(1) - 1
        self.seen_pairs = np.array([[(self.both & (self.y[:, :-1] == a) & (self.y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])

    def expected(self, weights: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chance of content of each line, and how many of each pair of labels to expect."""
        on, both, longest = self.on, self.both, self.on.shape[1]
        emit = np.stack([np.zeros(on.shape), self.x @ weights], -1)
        fwd = np.zeros(emit.shape)
        fwd[:, 0] = first + emit[:, 0]
        for t in range(1, longest):
            fwd[:, t] = np.logaddexp(fwd[:, t - 1, 0, None] + pairs[0], fwd[:, t - 1, 1, None] + pairs[1]) + emit[:, t]
        bwd = np.zeros(emit.shape)
        for t in range(longest - 2, -1, -1):
            to = bwd[:, t + 1] + emit[:, t + 1]
            step = np.logaddexp(pairs[:, 0] + to[:, 0, None], pairs[:, 1] + to[:, 1, None])
            bwd[:, t] = np.where(on[:, t + 1, None], step, 0)
        end = fwd[np.arange(len(on)), self.last]
        log_z = np.logaddexp(end[:, 0], end[:, 1])
        content = np.where(on, np.exp(fwd[..., 1] + bwd[..., 1] - log_z[:, None]), 0)
        likely = np.array(
            [[np.where(both, np.exp(fwd[:, :-1, a] + pairs[a, b] + emit[:, 1:, b] + bwd[:, 1:, b] - log_z[:, None]), 0).sum() for b in (0, 1)] for a in (0, 1)]
        )
        return content, likely


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_bytes: int = MAX_TRAIN_BYTES, max_lines: int = MAX_TRAIN_LINES) -> Crf:
    """Weights from at most max_docs labelled documents and max_lines of their lines, in order of an id hash, without texts of over max_bytes bytes.

    Of an id's rows the least label and the least text count; rows with a null id, text or label are
    not used. With none left, every line counts as content.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    fit = docs.filter(F.octet_length("text").between(1, max_bytes)).select("doc_id", "text")
    # ids first: of them at most max_docs leave a task, and texts are only read for those that were chosen
    chosen = known.join(fit.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()
    if not chosen:
        return Crf.fit([])
    ids = docs.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(chosen)], [*known.columns, "turn"])
    rows = fit.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality", "turn").agg(F.min("text").alias("text")).collect()
    chains, lines = [], 0
    for r in sorted(rows, key=lambda r: r.turn):
        x, _ = line_features(r.text.encode())
        lines += len(x)
        if lines > max_lines and chains:
            break
        chains.append((x, np.full(len(x), int(r.quality)) * (x[:, 6] == 0)))
    return Crf.fit(chains)


def quality_rules(docs: DataFrame, model: Crf, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """docs (doc_id, text) -> one row per row: the base counts, content_share, base_failed and kept."""
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"

    def judge(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                text = text or b""
                found = base(text)
                x, sizes = line_features(text)
                content = int((model.viterbi(x) * sizes).sum())
                share = content / found[0] if found[0] else 0.0
                failed = found[0] < min_words or 100 * found[4] > 50 * found[0]
                out.append((doc_id, *found, share, failed, not failed and share >= min_share))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 6 + [pa.float64(), pa.bool_(), pa.bool_()])] if out else [pa.array([], t) for t in [pa.int64()] * 6 + [pa.float64(), pa.bool_(), pa.bool_()]],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "base_failed", "kept"],
            )

    return docs.select("doc_id", "text").mapInArrow(judge, schema)


def kept_rows(docs: DataFrame, model: Crf, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of docs that quality_rules() keeps, with all their columns."""
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            verdict = []
            for text in batch.column(at).cast(pa.large_binary()).to_pylist():
                text = text or b""
                found = base(text)
                ok = found[0] >= min_words and 100 * found[4] <= 50 * found[0]
                if ok:
                    x, sizes = line_features(text)
                    ok = int((model.viterbi(x) * sizes).sum()) >= min_share * found[0]
                verdict.append(ok)
            yield batch.filter(pa.array(verdict, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
