"""Vector code compression: product codes whose nearest entries are found by partial distances.

Components become integers floor(256 x), vectors are cut into equal parts, and each part position has a
codebook of up to 64 entries, moved to its parts' means (floored) in each round. The nearest entry is found by partial-distance
search: dimensions come in descending variance of the codebook, and a mask drops an entry of a row once its
integer distance so far strictly exceeds the row's best complete distance; the entry that is nearest in the first
dimension gives the first complete distance, and entries come in blocks so that later ones meet a better one. Equal distances go to the lower index.
All arithmetic is exact.

Per round a task gives one row for each entry it has used, with its parts' sums; what reaches the driver is the codebooks
(64 times the dimension) and one such row for each entry. Sums by label are partial aggregates, so a hot label costs nothing more.

Null vectors and those with null or non-finite components give no row. The entries start from the least vec_ids
(not null; of a repeated one its least vector). The length is that of the least one that the parts divide; vectors of other lengths get null code
and error. Components are taken as at most 2**62 after scaling; an error over 2**63 - 1 is given as that, a label's sum beyond it as null.
Repeated rows are coded one by one; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.llm._scratch import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a block of the search.
BLOCK = 16
#: Scaled components under this leave squares, summed over 512 dimensions, in 64 bits; others are handled as Python's integers.
NARROW = 1 << 26
#: Sums by label are broadcast up to this many (24 bytes each), else joined by label.
MAX_LABELS = 100_000
_MOST = 2**63 - 1


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(256 x) as 64-bit integers, or as Python's where squares could leave 64 bits."""
    down = np.floor(values.astype(np.float64) * SCALE)
    if not down.size or np.abs(down).max() < NARROW:
        return down.astype(np.int64)
    return np.array([int(x) for x in np.clip(down, -(2.0**62), 2.0**62).ravel()], dtype=object).reshape(down.shape)


def by_variance(book: np.ndarray) -> list[int]:
    """Dimensions of a codebook in descending variance of its entries."""
    n = len(book)
    wide = book.astype(object)
    spread = [n * sum(v * v for v in wide[:, j]) - sum(wide[:, j]) ** 2 for j in range(book.shape[1])]
    return sorted(range(book.shape[1]), key=lambda j: (-spread[j], j))


def nearest(x: np.ndarray, book: np.ndarray, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, by partial distances in this order of dimensions."""
    if x.dtype != book.dtype:
        x, book = x.astype(object), book.astype(object)
    first = order[0]
    by_value = np.argsort(book[:, first], kind="stable")
    at = np.searchsorted(book[by_value, first], x[:, first])
    low, high = by_value[np.maximum(at - 1, 0)], by_value[np.minimum(at, len(book) - 1)]
    index = np.where(np.abs(x[:, first] - book[low, first]) <= np.abs(x[:, first] - book[high, first]), low, high)
    best = ((x - book[index]) ** 2).sum(1)
    for start in range(0, len(book), BLOCK):
        part = book[start : start + BLOCK]
        sums = (x[:, first, None] - part[None, :, first]) ** 2
        rows, entries = np.nonzero(sums <= best[:, None])
        sums = sums[rows, entries]
        for j in order[1:]:
            sums = sums + (x[rows, j] - part[entries, j]) ** 2
            on = np.flatnonzero(sums <= best[rows])
            rows, entries, sums = rows[on], entries[on], sums[on]
        if not len(rows):
            continue
        # the least of each row's complete distances, of equal ones the lowest entry; rows are in order
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        least = np.minimum.reduceat(sums, starts)
        is_least = np.flatnonzero(sums == np.repeat(least, np.diff(np.r_[starts, len(rows)])))
        is_least = is_least[np.r_[True, rows[is_least][1:] != rows[is_least][:-1]]]
        rows, entries = rows[is_least], entries[is_least] + start
        better = np.flatnonzero((least < best[rows]) | (least == best[rows]) & (entries < index[rows]))
        best[rows[better]], index[rows[better]] = least[better], entries[better]
    return index, best


@dataclass
class Codebooks:
    """For each part position, entries by dimensions."""

    books: list[np.ndarray]

    @property
    def width(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def assign(self, x: np.ndarray):
        """For each part: its rows, and the index and distance of their nearest entries."""
        w = self.books[0].shape[1]
        for p, book in enumerate(self.books):
            part = x[:, p * w : (p + 1) * w]
            yield part, *nearest(part, book, by_variance(book))

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for b in self.books for e in b for v in e).encode()).hexdigest()


def _vectors(column: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists: which rows are kept, which of these have the width, and the scaled components of the latter."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64), nan=0).astype(np.int64)
    flat = column.flatten()
    flat_values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~np.isfinite(flat_values)  # nulls come as NaN
    ends = np.cumsum(lengths)
    sums = np.r_[0, np.cumsum(bad)]
    kept = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), dtype=bool) & (sums[ends] == sums[ends - lengths])
    fits = kept & (lengths == width)
    values = flat_values[np.repeat(fits, lengths)].reshape(-1, width or 1)
    return kept, fits, scaled(values)


def _start(vectors: DataFrame, parts: int, size: int) -> np.ndarray:
    """The scaled vectors of the least vec_ids."""
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & sound & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)).select("vec_id", "embedding")

    def least(of: DataFrame):
        return of.orderBy("vec_id", "embedding").limit(size).collect()

    found = least(rows)
    if not found:
        return np.zeros((0, 0), np.int64)
    width = len(found[0].embedding)
    if any(len(r.embedding) != width for r in found):
        rows = rows.filter(F.size("embedding") == width)
        found = least(rows)
    if len({r.vec_id for r in found}) < len(found):
        found = least(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    return scaled(np.array([r.embedding for r in found], dtype=np.float64))


def _sums(vectors: DataFrame, books: Codebooks) -> list:
    """For each part and entry in use, the number of its parts and their sums."""
    w, width, size = books.books[0].shape[1], books.width, len(books.books[0])
    names = ["part", "entry", "n", *(f"s{j}" for j in range(w))]
    kind = pa.decimal128(38, 0)

    def add(batches):
        counts = np.zeros((len(books.books), size), np.int64)
        sums = np.zeros((len(books.books), size, w), object)
        for batch in batches:
            _, _, x = _vectors(batch.column(0), width)
            if not len(x):
                continue
            for p, (part, index, _) in enumerate(books.assign(x)):
                counts[p] += np.bincount(index, minlength=size)
                if part.dtype == object:
                    np.add.at(sums[p], index, part)
                else:
                    for j in range(w):  # sums of a batch are under 2**53, so exact in 64-bit floats
                        sums[p, :, j] += np.bincount(index, weights=part[:, j], minlength=size).astype(np.int64)
        at = np.argwhere(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(counts[tuple(at.T)], pa.int64()), *(pa.array([int(v) for v in sums[at[:, 0], at[:, 1], j]], kind) for j in range(w))],
            names=names,
        )

    schema = "part int, entry int, n long, " + ", ".join(f"s{j} decimal(38,0)" for j in range(w))
    found = vectors.select("embedding").mapInArrow(add, schema)
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{j}").cast("decimal(38,0)").alias(f"s{j}") for j in range(w))).collect()


def fit(vectors: DataFrame, parts: int = PARTS, size: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after these rounds over all vectors; none where no vector can start them."""
    start = _start(vectors, parts, size)
    if not len(start):
        return None
    books = Codebooks(np.split(start, parts, axis=1))
    for _ in range(rounds):
        moved = [b.astype(object) for b in books.books]
        for part, entry, n, *sums in _sums(vectors, books):
            moved[part][entry] = [int(s) // n for s in sums]
        books = Codebooks([b.astype(np.int64) if max(map(abs, b.ravel())) < NARROW else b for b in moved])
    return books


def encode(vectors: DataFrame, books: Codebooks | None) -> DataFrame:
    """(vec_id, label, code, error) of every kept vector."""
    width = books.width if books else None
    schema = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "label")) + ", code string, error long"

    def code(batches):
        for batch in batches:
            kept, fits, x = _vectors(batch.column(2), width)
            codes, errors = np.full(len(kept), None, object), np.full(len(kept), None, object)
            if books and len(x):
                total, text = 0, [""] * len(x)
                for _, index, best in books.assign(x):
                    total = total + best
                    text = [a + "%02x" % b for a, b in zip(text, index.tolist())]
                codes[fits], errors[fits] = text, [min(int(e), _MOST) for e in total]
            at = np.flatnonzero(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(codes[at], pa.string()), pa.array(errors[at], pa.int64())], names=["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(code, schema)


def vector_codes(vectors: DataFrame, parts: int = PARTS, size: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vectors (vec_id, embedding, label) -> (vec_id, code, error, label_error, codebooks_sha256)."""
    books = fit(vectors, parts, size, rounds)
    coded = written(encode(vectors, books), "codes")
    by_label = written(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "by_label").withColumnRenamed("label", "__label")
    if by_label.count() <= MAX_LABELS:
        by_label = F.broadcast(by_label)
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("__label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))


def _oracle() -> str:
    def assigned(k: int) -> str:
        return f"""near{k} AS MATERIALIZED (
          SELECT vec_id, p, min(struct_pack(d := d, e := e)) AS best
          FROM (SELECT x.vec_id, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN book{k} b ON x.p = b.p AND x.j = b.j GROUP BY ALL) GROUP BY ALL)"""

    def moved(k: int) -> str:
        return f"""book{k} AS MATERIALIZED (
          SELECT b.p, b.e, b.j, coalesce(m.v, b.v) AS v FROM book{k - 1} b LEFT JOIN (
            SELECT p, e, j, CAST((total - ((total % many) + many) % many) // many AS BIGINT) AS v
            FROM (SELECT x.p, a.best.e AS e, x.j, CAST(sum(x.v) AS BIGINT) AS total, count(*) AS many
                  FROM x JOIN near{k - 1} a ON x.vec_id = a.vec_id AND x.p = a.p GROUP BY ALL)) m
          ON b.p = m.p AND b.e = m.e AND b.j = m.j)"""

    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT) FOR v IN embedding] AS vs, row_number() OVER (ORDER BY vec_id) - 1 AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len([1 FOR v IN embedding IF v IS NULL OR NOT isfinite(v)]) = 0),
x AS MATERIALIZED (
  SELECT vec_id, CAST(floor((i - 1) / (len(vs) / 16)) AS BIGINT) AS p, CAST((i - 1) % (len(vs) / 16) AS BIGINT) AS j, vs[i] AS v
  FROM (SELECT vec_id, vs, unnest(range(1, len(vs) + 1)) AS i FROM kept)),
book0 AS MATERIALIZED (SELECT x.p, k.e, x.j, x.v FROM x JOIN kept k USING (vec_id) WHERE k.e < {ENTRIES}),
{assigned(0)}, {moved(1)}, {assigned(1)}, {moved(2)}, {assigned(2)},
coded AS (
  SELECT n.vec_id, any_value(k.label) AS label, string_agg(printf('%02x', CAST(n.best.e AS INTEGER)), '' ORDER BY n.p) AS code, CAST(sum(n.best.d) AS BIGINT) AS error
  FROM near2 n JOIN kept k USING (vec_id) GROUP BY n.vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, j)) FROM book2) AS codebooks_sha256
FROM coded
"""


ORACLE = _oracle()
