"""Closeness of two blocks of names: products of count matrices, and edits of many pairs at a time."""

from __future__ import annotations

from collections import Counter
from os.path import commonprefix

import numpy as np

#: Columns of a count matrix and pairs of a count of edits that are held at a time.
COLUMNS, PAIRS = 4_096, 65_536


def trigrams(form: str) -> Counter:
    padded = f"  {form}  "
    return Counter(padded[i : i + 3] for i in range(len(padded) - 2))


def tokens(form: str) -> Counter:
    return Counter({t for t in form.split("_") if t})


def products(left: list[Counter], right: list[Counter]) -> np.ndarray:
    """Of each name on the left and each on the right, the sum of the products of their counts; whole numbers, exact."""
    keys = {k: i for i, k in enumerate(set().union(*left) & set().union(*right))}
    longest = max((sum(c * c for c in counts.values()) for counts in left + right), default=0)
    kind = np.float32 if longest < 2**24 else np.float64
    out = np.zeros((len(left), len(right)), kind)
    sides = [np.array([(i, keys[k], c) for i, counts in enumerate(side) for k, c in counts.items() if k in keys], np.int64).reshape(-1, 3) for side in (left, right)]
    for at in range(0, len(keys), COLUMNS):
        wide = min(COLUMNS, len(keys) - at)
        x, y = np.zeros((len(left), wide), kind), np.zeros((len(right), wide), kind)
        for matrix, (row, key, count) in zip((x, y), (s.T for s in sides)):
            here = (key >= at) & (key < at + wide)
            matrix[row[here], key[here] - at] = count[here]
        out += x @ y.T
    return out


def _banded(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Edit distances, most + 1 if larger, of the columns of a and of b, which hold a string each."""
    (m, pairs), n, far = a.shape, len(b), most + 1
    full = lambda v: np.full(pairs, min(v, far), np.int8)
    row = {d: full(d) for d in range(most + 1) if d <= n}
    for i in range(1, m + 1):
        new: dict[int, np.ndarray] = {}
        for d in range(-most, most + 1):
            j = i + d
            if j == 0:
                new[d] = full(i)
            elif 0 < j <= n:
                best = row[d] + (a[i - 1] != b[j - 1])
                for beside in (row.get(d + 1), new.get(d - 1)):
                    if beside is not None:
                        np.minimum(best, beside + np.int8(1), out=best)
                new[d] = np.minimum(best, far)
        row = new
    return row[n - m]


def edits(left: list[str], right: list[str], wanted: np.ndarray, most: int) -> np.ndarray:
    """Edit distances of the pairs that are wanted; most + 1 where they are larger and for the others."""
    skip = len(commonprefix(left + right))
    out = np.full(wanted.shape, most + 1, np.int8)

    def by_length(side: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        lengths = np.array([len(x) - skip for x in side])
        found = []
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            text = "".join(side[i][skip:] for i in rows)
            found.append((rows, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), n).T))
        return found

    for rows, a in by_length(left):
        for columns, b in by_length(right):
            if abs(len(a) - len(b)) > most:
                continue
            x, y = np.nonzero(wanted[np.ix_(rows, columns)])
            for k in range(0, len(x), PAIRS):
                s = slice(k, k + PAIRS)
                out[rows[x[s]], columns[y[s]]] = _banded(a[:, x[s]], b[:, y[s]], most)
    return out


def close(left: list[str], right: list[str], open_: np.ndarray, jaccard: float, edit: int, cosine: float) -> tuple[np.ndarray, ...]:
    """Of the pairs that are open, those with shared tokens, few edits or alike trigrams: rows, columns, jaccard, edits (edit + 1 if more), cosine.

    A cosine counts by what it is in six digits, and isn't rounded yet.
    """
    ga, gb = [trigrams(x) for x in left], [trigrams(x) for x in right]
    dot = products(ga, gb)
    square = lambda side: np.array([float(sum(c * c for c in counts.values())) for counts in side])
    alike = dot / np.sqrt(square(ga)[:, None] * square(gb)[None, :])
    ta, tb = [tokens(x) for x in left], [tokens(x) for x in right]
    both = products(ta, tb).astype(np.float64)
    either = np.array([len(t) for t in ta])[:, None] + np.array([len(t) for t in tb])[None, :] - both
    share = np.divide(both, either, out=np.zeros_like(both), where=either > 0)
    # an edit spoils three trigrams at most, and a form of n characters has n + 2
    longer = np.maximum(np.array([len(x) for x in left])[:, None], np.array([len(x) for x in right])[None, :])
    distance = edits(left, right, open_ & (dot >= longer + 2 - 3 * edit), edit)
    least = float(f"{cosine - 5e-7:.7f}")
    x, y = np.nonzero(open_ & ((share >= jaccard) | (distance <= edit) | (alike >= least)))
    return x, y, share[x, y], distance[x, y], alike[x, y]


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links (a, b) that connect all that these do, one less in each component than it has members."""
    _, first = np.unique(np.stack([a, b]), axis=1, return_index=True)
    above: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := above.get(v, v)) != v:
            above[v] = v = above.get(up, up)
        return v

    kept = []
    for k, x, y in zip(first.tolist(), a[first].tolist(), b[first].tolist()):
        x, y = root(x), root(y)
        if x != y:
            above[x] = y
            kept.append(k)
    return np.array(kept, np.int64)
