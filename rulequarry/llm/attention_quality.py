"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of 64 words (the last may be shorter). Each passage has figures read from its bytes and words
(classes of characters, repeats, lengths, and a bag of hashed words); a tanh layer encodes it as h. Gated attention gives
it the weight softmax(w · (tanh(V h) * sigmoid(U h))) among its document's passages, and the weighted mean of h
is scored by a logistic output. Encoder, gates and output are learned together from labels of whole documents, by Adam on
the mean cross entropy; gradients are written out. Passages of a long text are encoded in blocks, whose softmax
sums are merged, so a text of any length is scored whole.

The fit reads a bounded sample: MAX_DOCS documents and MAX_PASSAGES of their passages, in order of a hash of the id, without texts over
MAX_BYTES. Everything else is one pass over the texts without a shuffle.

A document without words (null, empty, white space) has score 0. Rows with a null id are scored and not learned from; repeated rows are
scored one by one, and learned once (least label, least text). Without any label all texts with words have 0.5. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulequarry.llm._text import SPACE, Words, buffers, slices

#: Words of a passage.
PASSAGE = 64
MAX_DOCS, MAX_BYTES, MAX_PASSAGES = 2000, 20_000, 20_000
BUCKETS, HIDDEN, GATES = 64, 16, 8
THRESHOLD = 0.7
#: Bytes of a long text that are encoded at once.
BLOCK = 1 << 21


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(members)] = 1
    return out


_UPPER, _LOWER = _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))
#: Other classes of bytes, as shares of a passage's bytes.
_CLASSES = [_table(x) for x in (b"#*$%&<>", b"|", b"!", b"0123456789", b".?", b",;:", b"\"'()[]{}/\\_-+=@~^`", bytes(range(0x80, 0x100)))]
_SYMBOL = _table(b"#*$%&|<>!")
N_DENSE = len(_CLASSES) + 9
N_FEATURES = N_DENSE + BUCKETS


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A row for each passage, and how many passages each text has."""
    counts = np.diff(words.first)
    n_passages = -(-counts // PASSAGE)
    total = len(words)
    if not total:
        return np.zeros((0, N_FEATURES)), n_passages
    within = np.arange(total) - np.repeat(words.first[:-1], counts)
    starts = np.flatnonzero(within % PASSAGE == 0)
    sizes = np.diff(np.r_[starts, total])
    passage = np.repeat(np.arange(len(starts)), sizes)
    lengths = words.ends - words.starts
    size = np.add.reduceat(lengths, starts).astype(np.float64)
    n = sizes.astype(np.float64)
    hashes = words.hashes()
    at = words.starts[starts]

    def share(table):
        return np.add.reduceat(table[words.raw], at, dtype=np.int64)

    def of_words(mask):
        return np.add.reduceat(mask.astype(np.int64), starts) / n

    upper, lower = share(_UPPER), share(_LOWER)
    again = np.zeros(total, bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[starts] = False
    broken = np.zeros(total, bool)
    broken[1:] = words.raw[words.starts[1:] - 1] == 10
    broken[starts] = False
    keys = np.sort(passage.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    new = np.r_[True, keys[1:] != keys[:-1]]
    distinct = np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=len(starts))
    dense = [share(t) / size for t in _CLASSES]
    dense += [upper / (upper + lower + 1), lower / size, size / n / 8, of_words(lengths < 3), of_words(lengths > 12), of_words(_SYMBOL[words.raw[words.ends - 1]] > 0), of_words(again), of_words(broken), distinct / n]
    bags = np.bincount(passage * BUCKETS + (hashes >> np.uint64(58)).astype(np.int64), minlength=len(starts) * BUCKETS).reshape(-1, BUCKETS)
    return np.column_stack([*dense, bags / n[:, None]]), n_passages


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """Encoder, gated attention and output. Parts of `p`: W, b (encoder), V, U, w (gates), c, d (output)."""

    def __init__(self, p: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.p, self.mean, self.scale = p, mean, scale

    @staticmethod
    def fresh(seed: int = 7) -> "Model":
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(size=shape) / np.sqrt(shape[0])
        p = {"W": draw(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES), "w": draw(GATES), "c": draw(HIDDEN), "d": np.zeros(1)}
        return Model(p, np.zeros(N_FEATURES), np.ones(N_FEATURES))

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of raw features: h, the two gates and the attention's logit."""
        p = self.p
        h = np.tanh((x - self.mean) / self.scale @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, t, g, (t * g) @ p["w"]

    def pooled(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of bags that start at `first`: the greatest logit, and the sums of exp(logit - greatest) and of it times h."""
        h, _, _, e = self.encoded(x)
        top = np.maximum.reduceat(e, first)
        bag = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(x)]))
        weight = np.exp(e - top[bag])
        return top, np.add.reduceat(weight, first), np.add.reduceat(weight[:, None] * h, first)

    def score(self, sums: np.ndarray, weighted: np.ndarray) -> np.ndarray:
        return _sigmoid(weighted / sums[:, None] @ self.p["c"] + self.p["d"])

    def loss(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, decay: float) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy with a penalty on all weights, and its gradient."""
        p = self.p
        h, t, g, e = self.encoded(x)
        bag = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(x)]))
        weight = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = weight / np.add.reduceat(weight, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        s = _sigmoid(z @ p["c"] + p["d"])
        loss = -np.mean(np.log(np.where(y == 1, s, 1 - s) + 1e-12)) + decay / 2 * sum((v**2).sum() for k, v in p.items() if k not in "bd")
        out = (s - y) / len(y)
        to_z = out[bag, None] * p["c"]
        to_a = (to_z * h).sum(1)
        to_e = a * (to_a - np.add.reduceat(a * to_a, first)[bag])
        to_gate = to_e[:, None] * p["w"]
        to_t, to_g = to_gate * g * (1 - t**2), to_gate * t * g * (1 - g)
        to_h = (a[:, None] * to_z + to_t @ p["V"].T + to_g @ p["U"].T) * (1 - h**2)
        grad = {"W": ((x - self.mean) / self.scale).T @ to_h, "b": to_h.sum(0), "V": h.T @ to_t, "U": h.T @ to_g, "w": (t * g).T @ to_e, "c": z.T @ out, "d": out.sum(keepdims=True)}
        return float(loss), {k: v + (decay * p[k] if k not in "bd" else 0) for k, v in grad.items()}

    @staticmethod
    def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.02, decay: float = 2e-3) -> "Model":
        model = Model.fresh()
        # figures that hardly vary in the sample keep their scale, so that a rare value doesn't swamp the rest
        model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 0.02)
        at = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
        for k in range(1, rounds + 1):
            _, grad = model.loss(x, first, y, decay)
            for name, g in grad.items():
                m, v = at[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model.p[name] = model.p[name] - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return model


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a row is kept from the fit: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, max_passages: int = MAX_PASSAGES) -> Model | None:
    """A model of the labelled documents that are not held out; none where no row can be learned from."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = docs.filter(F.octet_length("text").between(1, max_bytes)).select("doc_id", "text")
    # ids first: of them at most max_docs leave a task, and texts are only read for those that were chosen
    chosen = known.join(texts.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()
    if not chosen:
        return None
    ids = docs.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(chosen)], [*known.columns, "turn"])
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality", "turn").agg(F.min("text").alias("text")).collect()
    xs, ys, n = [], [], 0
    for r in sorted(rows, key=lambda r: r.turn):
        x, _ = features(Words(*buffers(pa.array([r.text])), 0, 1))
        if not len(x):
            continue
        n += len(x)
        if n > max_passages and xs:
            break
        xs.append(x)
        ys.append(int(r.quality))
    if not xs:
        return None
    first = np.cumsum([0, *map(len, xs)])[:-1]
    return Model.fit(np.concatenate(xs), first, np.array(ys, float))


def _long(model: Model, raw: np.ndarray, block: int) -> float:
    """The score of one long text, from blocks of whole passages."""
    found, at = [], 0
    end = len(raw)
    size = block
    while at < end:
        to = min(end, at + size)
        if to < end:  # not inside a word
            piece = raw[at:to].tobytes()
            to = at + max(piece.rfind(c) for c in map(bytes, zip(SPACE))) + 1
        words = Words(raw, np.array([at, to]), 0, 1)
        n = len(words)
        if to < end:
            n -= n % PASSAGE
            if not n:
                if to > at and not len(words):  # white space only
                    at = to
                else:
                    size *= 2
                continue
            if n < len(words):
                to = at + int(words.starts[n])
                words = Words(raw, np.array([at, to]), 0, 1)
        if n:
            found.append(model.pooled(features(words)[0], np.zeros(1, np.int64)))
        at, size = to, block
    if not found:
        return 0.0
    top = max(f[0][0] for f in found)
    by = [np.exp(f[0] - top) for f in found]
    return float(model.score(sum(b * f[1] for b, f in zip(by, found)), sum(b * f[2] for b, f in zip(by, found)))[0])


def scores(model: Model | None, column: pa.Array, block: int = BLOCK) -> np.ndarray:
    """The score of each text of a batch."""
    raw, offsets = buffers(column)
    out = np.zeros(len(offsets) - 1)
    for first, last in slices(offsets, block):
        if last == first + 1 and offsets[last] - offsets[first] > block:
            text = raw[offsets[first] : offsets[last]]
            out[first] = _long(model, text, block) if model else 0.5 * (len(Words(raw, offsets, first, last)) > 0)
            continue
        words = Words(raw, offsets, first, last)
        full = np.flatnonzero(np.diff(words.first))
        if model is None:
            out[first + full] = 0.5
        elif len(full):
            x, n = features(words)
            n = n[full]
            _, sums, weighted = model.pooled(x, np.cumsum(np.r_[0, n])[:-1])
            out[first + full] = model.score(sums, weighted)
    return np.round(out, 6)  # beyond that, sums depend on how rows fall into batches


def quality_scores(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, held_out, score, predicted), a row for each row."""

    def judge(batches):
        for batch in batches:
            found = scores(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    found = docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
