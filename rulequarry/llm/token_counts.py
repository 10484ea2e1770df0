"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word with a word mark before it. The distinct pre-tokens of a slice of text form a
trie: at each depth, words with the same bytes so far are one node, and the best score of a node
(over its last piece of 1..L bytes, ending there, plus the best score of the ancestor that far
up) is computed once for all words below it. The token count of the best path is kept beside the
score and read at the node where a word ends. Equal scores go to the fewer tokens.

The pieces are a public vocabulary's; its ranks stand for log-probabilities by Zipf's law,
-ln(rank + 1). A byte in no piece costs one token at the least score less ten. Null or empty text
has no tokens; repeated rows are counted one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rulequarry.llm._text import Words, buffers, mix, powers, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
LONG = 96  # words of more bytes are scored one by one
_T = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def pieces(path: str = VOCABULARY) -> dict[bytes, float]:
    """Piece -> score, of a sentencepiece model file's ordinary pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i).encode(): -float(np.log(rank + 2.0)) for rank, i in enumerate(kept)}


class Pieces:
    """Hash tables of the pieces by length."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.unknown = min(scores.values(), default=0.0) - 10
        self.longest = max(map(len, scores), default=1)
        self.by_length = {}
        groups: dict[int, list[tuple[int, float]]] = {}
        up, _ = powers(self.longest + 1)
        for p, s in scores.items():
            h = int(mix(np.array([(_T[np.frombuffer(p, np.uint8)] * up[: len(p)]).sum()], np.uint64))[0])
            groups.setdefault(len(p), []).append((h, s))
        for n, rows in groups.items():
            rows.sort()
            h, s = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows])
            sieve = np.zeros(1 << 18, bool)
            sieve[(h & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
            self.by_length[n] = h, s, sieve

    def find(self, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the sums that are pieces of n bytes."""
        if n not in self.by_length:
            return np.zeros(0, np.int64), np.zeros(0)
        h, s, sieve = self.by_length[n]
        x = mix(sums)
        at = np.flatnonzero(sieve[(x & np.uint64((1 << 18) - 1)).astype(np.int64)])
        i = np.minimum(np.searchsorted(h, x[at]), len(h) - 1)
        hit = h[i] == x[at]
        return at[hit], s[i[hit]]

    def one(self, word: bytes) -> int:
        """Tokens of one pre-token, by the plain forward recursion."""
        best, count = [0.0], [0]
        for d in range(1, len(word) + 1):
            top, n = best[d - 1] + self.scores.get(word[d - 1 : d], self.unknown), count[d - 1] + 1
            for size in range(2, min(d, self.longest) + 1):
                score = self.scores.get(word[d - size : d])
                if score is not None and (score + best[d - size], -count[d - size] - 1) > (top, -n):
                    top, n = score + best[d - size], count[d - size] + 1
            best.append(top)
            count.append(n)
        return count[-1]


def trie_counts(words: list[bytes], model: Pieces) -> np.ndarray:
    """Token counts of distinct pre-tokens, each shared prefix scored once."""
    out = np.zeros(len(words), np.int64)
    size = np.array([len(w) for w in words], np.int64)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = model.one(words[i])
    order = np.flatnonzero((size <= LONG) & (size > 0))
    order = order[np.argsort(-size[order], kind="stable")]
    if not len(order):
        return out
    size = size[order]
    deepest = int(size[0])
    chars = np.zeros((deepest, len(order)), np.uint8)
    flat = np.frombuffer(b"".join(words[i] for i in order.tolist()), np.uint8)
    start = np.cumsum(size) - size
    alive = np.searchsorted(-size, -np.arange(1, deepest + 1), side="right")
    for d in range(deepest):
        chars[d, : alive[d]] = flat[start[: alive[d]] + d]
    up, down = powers(deepest + 1)
    # node[d]: of each word, its node of depth d; head[d]: of each node, a word below it; sums[d]: of each word, the hash of its first d bytes
    sums = np.zeros((deepest + 1, len(order)), np.uint64)
    node, best, count = [np.zeros(len(order), np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)]
    for d in range(1, deepest + 1):
        n = int(alive[d - 1])
        sums[d, :n] = sums[d - 1, :n] + _T[chars[d - 1, :n]] * up[d - 1]
        _, head, own = np.unique(sums[d, :n], return_index=True, return_inverse=True)
        parent = node[d - 1][head]
        top, tokens = best[d - 1][parent] + model.unknown, count[d - 1][parent] + 1
        for k in range(1, min(d, model.longest) + 1):
            at, score = model.find(k, (sums[d, head] - sums[d - k, head]) * down[d - k])
            if len(at):
                above = node[d - k][head[at]]
                score = score + best[d - k][above]
                n_tokens = count[d - k][above] + 1
                better = (score > top[at]) | ((score == top[at]) & (n_tokens < tokens[at]))
                top[at[better]], tokens[at[better]] = score[better], n_tokens[better]
        node.append(own)
        best.append(top)
        count.append(tokens)
        done = np.flatnonzero(size[:n] == d)
        out[order[done]] = tokens[own[done]]
    return out


_models: dict[str, Pieces] = {}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_tokens; the vocabulary's path must be readable by the executors."""

    def judge(batches):
        if vocabulary not in _models:
            _models[vocabulary] = Pieces(pieces(vocabulary))
        model = _models[vocabulary]
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            n_words, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for first, last in slices(offsets, 1 << 23):
                words = Words(raw, offsets, first, last)
                _, head, own = np.unique(words.hashes(), return_index=True, return_inverse=True)
                data = words.raw.tobytes()
                distinct = [MARK + data[a:b] for a, b in zip(words.starts[head].tolist(), words.ends[head].tolist())]
                counts = trie_counts(distinct, model)
                sums = np.concatenate([[0], np.cumsum(counts[own])])
                n_words[first:last] = np.diff(words.first)
                n_tokens[first:last] = sums[words.first[1:]] - sums[words.first[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n_words), pa.array(n_tokens)], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, n_words long, n_tokens long")
