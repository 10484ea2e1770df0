"""N-gram Jaccard join by prefix filters under several global token orders.

A document's set holds its distinct 5-word shingles (A-Z as a-z), as 64-bit hashes. Sets that link
at J >= 0.8 share a token among the first n - ceil(0.8 n) + 1 of each, under any one order of all tokens, and
so many of these that with all later tokens of one set they could be enough.
The first order puts frequent tokens last, and its prefixes make the candidates. Two further orders, by
other hashes, are intersected with it: the prefixes of a pair under each must share enough tokens too, before the
whole sets of what is left are read and verified.

Documents with equal sets are one class, of which only one goes on. Tokens that a single class
has in its prefix are dropped by a count that is combined on the map side. Candidates are first
stars: each class and the one pivot that it shares most prefix tokens with (pivots have the most
common tokens, as the original of a group of copies does), so a group of any size gives
as many pairs as it has members. What is linked so becomes one component. Then every pair of
classes that share a prefix token, but not yet a component, is verified; before that, more rounds of
stars around other pivots are made as long as those pairs would far outnumber the postings and stars still find links.
A token of very many classes isn't joined with itself: its classes are dealt by size, so that only those of fitting
sizes meet, and those of the pivot's component meet only the others. No pair that could link is left out, so
components are exact.

Frequent tokens are those in FREQUENT_FROM prefixes or more by hash alone, the MAX_FREQUENT most common
ones at most (1.6 MB, shipped to the tasks). Any order gives the same links, so they only decide how many
candidates there are.

Documents without words have an empty set and link with nothing; with fewer than five words the
whole sequence is one shingle. Rows repeated in full are copies of each other; a null doc_id takes part
but is no component's least id unless all are null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.llm._graph import components
from rulequarry.llm._scratch import bucketed, drop, scratch, written
from rulequarry.llm._text import FOLD, STEP, Words, buffers, grams, mix, slices

SHINGLE, PERCENT = 5, 80
MAX_FREQUENT, FREQUENT_FROM = 200_000, 12
#: Of candidates with prefixes of c common tokens: whether their sizes allow a link, and whether c does. The tokens
#: after the shorter-reaching prefix are at most n less its length, and all others that are shared are in both prefixes.
SIZES = f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)"
_REST = "({n} * {p} + 99) DIV 100 - 1"
ENOUGH = f"{100 + PERCENT} * (c + greatest({_REST.format(n='n_a', p=PERCENT)}, {_REST.format(n='n_b', p=PERCENT)})) >= {PERCENT} * (n_a + n_b)"
#: Tokens that more classes share are compared in blocks of so many, by parity sketches of so many bits.
DENSE, BLOCK, BITS = 256, 2048, 2048
#: How many random signs of components estimate the pairs that are left; they only decide whether another round of stars is made.
SIGNS = 4
ORDERS = (np.uint64(0x632BE59BD9B4E019), np.uint64(0x9E6C63D0676A9A99))


def shingle_sets(raw, offsets, first: int, last: int):
    """The sorted distinct shingle hashes of each row of a slice."""
    words = Words(raw, offsets, first, last)
    hashes = words.hashes(FOLD)
    runs = grams(hashes, SHINGLE)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= SHINGLE:
            yield np.unique(runs[a : b - SHINGLE + 1])
        elif b > a:
            yield mix((hashes[a:b] * STEP[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield hashes[:0]


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1 if n else 0


def _prefix(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first tokens in the order: rare before frequent, then by hash."""
    k = prefix_length(len(tokens))
    if len(frequent) and len(tokens):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        common = frequent[at] == tokens
        if common.any():
            return np.concatenate([tokens[~common], tokens[common]])[:k]
    return tokens[:k]


def orders(tokens: np.ndarray) -> list[np.ndarray]:
    """Under each further order, the places of the set's prefix tokens, sorted: a token's place is its mixed hash."""
    k = prefix_length(len(tokens))
    return [np.sort(np.partition(mix(tokens ^ seed), k - 1)[:k]) if k else tokens[:0] for seed in ORDERS]


def may_link(n_x: int, x: np.ndarray, n: np.ndarray, ys: list[np.ndarray]) -> np.ndarray:
    """Whether a set of n_x tokens may link to sets of n tokens, from their prefixes x and ys under one order.

    Of the tokens that both have, those up to where the shorter-reaching prefix ends are in both prefixes, and the
    others are among the rest of the set whose prefix that is.
    """
    if not len(x):
        return np.zeros(len(ys), bool)
    flat, row = np.concatenate([*ys, x[:0]]), np.repeat(np.arange(len(ys)), [len(y) for y in ys])
    both = np.bincount(row[_among(flat, x)], minlength=len(ys))
    ends = np.array([y[-1] if len(y) else 0 for y in ys], np.uint64)
    rest = np.where(ends < x[-1], n - [len(y) for y in ys], n_x - len(x))
    return (both > 0) & ((100 + PERCENT) * (both + rest) >= PERCENT * (n_x + n))


def linked(x: np.ndarray, ys: list[np.ndarray]) -> np.ndarray:
    """Whether the sorted set x links to each set of ys."""
    n = np.array([len(y) for y in ys], np.int64)
    flat, row = np.concatenate([*ys, x[:0]]), np.repeat(np.arange(len(ys)), n)
    both = np.bincount(row[_among(flat, x)], minlength=len(ys))
    return (both > 0) & (100 * both >= PERCENT * (len(x) + n - both))


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Of each of x: whether it is in a sorted array."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _describe(base: DataFrame) -> DataFrame:
    """(rid, doc_id, n, key) of each row: its set's size and 128-bit digest."""

    def judge(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(2))
            n, keys = [], []
            for first, last in slices(offsets, 1 << 22):
                for s in shingle_sets(raw, offsets, first, last):
                    n.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary())], names=["rid", "doc_id", "n", "key"])

    return base.select("rid", "doc_id", "text").mapInArrow(judge, "rid long, doc_id long, n long, key binary")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _prefixes(base: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(rid, n, tokens): the prefix of each row with a set."""
    shipped = base.sparkSession.sparkContext.broadcast(np.sort(frequent.astype(np.int64).view(np.uint64)))

    def judge(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            n, tokens = [], []
            for first, last in slices(offsets, 1 << 22):
                for s in shingle_sets(raw, offsets, first, last):
                    n.append(len(s))
                    tokens.append(_prefix(s, shipped.value).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), _lists(tokens)], names=["rid", "n", "tokens"])

    return base.select("rid", "text").mapInArrow(judge, "rid long, n long, tokens array<long>")


def _binary(rows: DataFrame, of) -> DataFrame:
    """(rid, text) -> (rid, sets): of(set), arrays of longs, one after the other in parts of a list of binaries."""

    def judge(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            sets = [[a.tobytes() for a in of(s)] for first, last in slices(offsets) for s in shingle_sets(raw, offsets, first, last)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.binary()))], names=["rid", "sets"])

    return rows.select("rid", "text").mapInArrow(judge, "rid long, sets array<binary>")


def _compared(pairs: DataFrame, sets: DataFrame, test) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that pass test(n_a, sets of a, n_b, sets of each b); those of one a that come together are judged together."""

    def judge(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 1024):  # bounds the sets that are held at once
                some = batch.slice(part, 1024)
                a, n_a, n_b = (some.column(k).to_numpy() for k in (0, 2, 3))
                ends = np.append(np.flatnonzero(a[1:] != a[:-1]) + 1, len(a))
                ok = np.zeros(len(a), bool)
                for i, j in zip([0, *ends[:-1].tolist()], ends.tolist()):
                    x = [np.frombuffer(v, np.uint64) for v in some.column(4)[i].as_py()]
                    ys = [[np.frombuffer(v, np.uint64) for v in y] for y in some.column(5).slice(i, j - i).to_pylist()]
                    ok[i:j] = test(int(n_a[i]), x, n_b[i:j], ys)
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays([some.column(k).filter(keep) for k in range(4)], names=["a", "b", "n_a", "n_b"])

    y = sets.select(F.col("rid").alias("b"), F.col("sets").alias("y"))
    x = sets.select(F.col("rid").alias("a"), F.col("sets").alias("x"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(judge, "a long, b long, n_a long, n_b long")


def _verified(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """The pairs (a, b, n_a, n_b) whose sets link: first their prefixes under the further orders are compared, then the whole sets of those left."""

    def of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
        return base.join(ids, "rid", "left_semi")

    def share(n_x, x, n, ys):
        ok = np.ones(len(ys), bool)
        for k in range(len(ORDERS)):
            at = np.flatnonzero(ok)
            if len(at):
                ok[at] = may_link(n_x, x[k], n[at], [ys[i][k] for i in at])
        return ok

    sets = written(_binary(of(pairs), orders), "orders")
    left = written(_compared(pairs, sets, share), "left")
    drop(sets)
    sets = written(_binary(of(left), lambda s: [s]), "sets")
    found = written(_compared(left, sets, lambda n_x, x, n, ys: linked(x[0], [y[0] for y in ys])).select("a", "b"), "links")
    drop(sets)
    drop(left)
    return found


def _sketches(rows: DataFrame) -> DataFrame:
    """(rid, text) -> (rid, sketch): for each of BITS cells, the parity of the set's tokens in it."""

    def judge(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            out = []
            for first, last in slices(offsets):
                for s in shingle_sets(raw, offsets, first, last):
                    out.append(np.packbits(np.bincount((mix(s ^ ORDERS[0]) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["rid", "sketch"])

    return rows.select("rid", "text").mapInArrow(judge, "rid long, sketch binary")


def near_pairs(rid: np.ndarray, n: np.ndarray, component: np.ndarray, sketch: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places, one in left and one in right, that of the lesser rid first, of rows that may link: another component, fitting sizes, and no more odd cells in both sketches together than tokens that may differ."""
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in left.tolist():
        total = n[i] + n[right]
        ok = (component[right] != component[i]) & (100 * np.minimum(n[i], n[right]) >= PERCENT * np.maximum(n[i], n[right]))
        j = right[ok]
        differ = np.bitwise_count(sketch[j] ^ sketch[i]).sum(1, dtype=np.int64)
        j = j[differ <= total[ok] - 2 * (-(-PERCENT * total[ok] // (100 + PERCENT)))]
        swap = rid[j] < rid[i]
        out_i.append(np.where(swap, j, i))
        out_j.append(np.where(swap, i, j))
    pairs = np.unique(np.stack([np.concatenate(out_i), np.concatenate(out_j)]), axis=1)
    return pairs[0], pairs[1]


def _block_pairs(rows: DataFrame) -> DataFrame:
    """(token, band, x, y, block, rid, n, component, sketch), equal (token, band, x, y) next to each other -> pairs (a, b, n_a, n_b) of block x with block y."""

    def judge(batches):
        held: list[pa.RecordBatch] = []
        last = None

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            rid, n, component, block, x, y = (t.column(k).to_numpy() for k in ("rid", "n", "component", "block", "x", "y"))
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(rid), -1)
            i, j = near_pairs(rid, n, component, sketch, np.flatnonzero(block == x), np.flatnonzero(block == y))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (rid[i], rid[j], n[i], n[j])], names=["a", "b", "n_a", "n_b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in range(4)])
            starts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            for i, j in zip([0, *starts.tolist()], [*starts.tolist(), batch.num_rows]):
                now = tuple(key[:, i])
                if held and now != last:
                    yield flush()
                held.append(batch.slice(i, j - i))
                last = now
        if held:
            yield flush()

    return rows.select("token", "band", "x", "y", "block", "rid", "n", "component", "sketch").mapInArrow(judge, "a long, b long, n_a long, n_b long")


def _open_pairs(open_: DataFrame, base: DataFrame, any_dense: bool) -> DataFrame:
    """All pairs (a, b, n_a, n_b) of different components that share a prefix token and may link.

    Tokens of up to DENSE classes are joined. The classes of any other are dealt by size into bands, of which only
    neighbours can link, and there into blocks: those of the pivot's component, which needn't be compared with each
    other, and the rest. A task compares two blocks by sketches and lets out the pairs that these don't rule out.
    """
    spark = open_.sparkSession
    rows = open_
    if any_dense:
        d = open_.groupBy("rid").agg(F.sum((F.col("c") > DENSE).cast("int")).alias("d"))
        rows = open_.filter(F.col("c") <= DENSE).join(d, "rid")
    else:
        rows = open_.withColumn("d", F.lit(0).cast("long"))
    x = rows.select("token", F.col("rid").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a"), F.col("d").alias("d_a"))
    y = rows.select("token", F.col("rid").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b"), F.col("d").alias("d_b"))
    pairs = x.join(y, "token").filter("a < b AND c_a <> c_b").filter(SIZES).groupBy("a", "b", "n_a", "n_b", "d_a", "d_b").agg(F.count("*").alias("shared"))
    # they may share dense tokens as well, of which the lesser number of either is the most
    pairs = pairs.withColumn("c", F.col("shared") + F.least("d_a", "d_b")).filter(ENOUGH).select("a", "b", "n_a", "n_b")
    if not any_dense:
        return pairs
    dense = open_.filter(F.col("c") > DENSE)
    # 100 / PERCENT between the ends of a band: sets that link are in one band or in neighbours
    own = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT)) - F.lit(1e-9)).cast("long")
    dense = dense.select("token", "rid", "n", "component", (F.col("component") == F.col("pivot.component")).alias("main"), F.explode(F.array(own, own + 1)).alias("band"), own.alias("home"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("long")
    sizes = dense.groupBy("token", "band").agg(blocks(F.sum(F.col("main").cast("int"))).alias("mains"), blocks(F.sum((~F.col("main")).cast("int"))).alias("others"), F.max((F.col("home") == F.col("band")).cast("int")).alias("homes"))
    dense = dense.join(sizes.filter("others > 0 AND homes > 0"), ["token", "band"])
    # blocks of others come first, then those of the main component
    block = F.when(F.col("main"), F.col("others") + F.pmod(F.xxhash64("rid"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("rid"), F.col("others")))
    partners = F.sequence(F.lit(0).cast("long"), F.when(F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)
    dealt = dense.withColumn("block", block).select(
        "token", "band", "rid", "n", "component", "block", F.explode(F.transform(partners, lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))).alias("cell")
    )
    dealt = dealt.select("token", "band", "cell.x", "cell.y", "block", "rid", "n", "component")
    sketches = written(_sketches(base.join(open_.filter(F.col("c") > DENSE).select("rid").distinct(), "rid", "left_semi")), "sketches")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.join(sketches, "rid").repartition(n, "token", "band", "x", "y").sortWithinPartitions("token", "band", "x", "y")
    return pairs.unionByName(_block_pairs(dealt)).distinct()


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, n_copies (rows of the same set, itself included)."""
    with scratch() as kept:
        out = _classified(bucketed(docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()), "rid", "base"))
        kept.append(out)
    return out.drop("rid", "component")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs with one left of each component (the least doc_id's first row); rows with an empty set all stay."""
    base = bucketed(docs.withColumn("__rid", F.monotonically_increasing_id()), "__rid", "base")
    with scratch() as stay:
        found = _classified(base.select("doc_id", "text", F.col("__rid").alias("rid")))
        stay.append(found)
    whole = found.filter("n_shingles > 0")
    kept = whole.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first")).select(F.col("first.rid").alias("__rid"))
    kept = written(kept.unionByName(found.filter("n_shingles = 0").select(F.col("rid").alias("__rid"))), "kept")
    drop(found)
    return base.join(kept, "__rid", "left_semi").drop("__rid")


def _classified(base: DataFrame) -> DataFrame:
    """(rid, doc_id, text), bucketed by rid -> rid, doc_id, n_shingles, component (a rid), component_id, n_copies, written."""
    rows = written(_describe(base), "rows")
    classes = written(rows.filter("n > 0").groupBy("key").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least"), F.count("*").alias("n_copies")), "classes")
    firsts = base.join(classes.select("rid"), "rid", "left_semi")
    counts = _prefixes(firsts, np.zeros(0, np.int64)).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    often = counts.filter(F.col("c") >= FREQUENT_FROM).orderBy(F.desc("c"), "token").limit(MAX_FREQUENT).select("token").toArrow()
    prefixes = written(_prefixes(firsts, often.column("token").to_numpy()), "prefixes")
    postings = prefixes.select(F.explode("tokens").alias("token"), "rid", "n")
    # written, so that the join below has two plain exchanges and a common token's partition can be split
    several = written(postings.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1"), "several")
    shared = postings.join(several, "token")
    # one row for a class: the tokens that it shares, and its score; the document that others were copied from has the
    # most common tokens, and most of its copies link to it
    held = shared.groupBy("rid", "n").agg(F.collect_list("token").alias("tokens"), F.sum("c").alias("sum"))
    held = written(held.select("rid", "n", (F.col("sum") / F.col("n")).alias("score"), "tokens"), "held")
    drop(prefixes)
    drop(several)
    links, tested, turn, new, label = None, None, 0, [], None
    while True:
        now = held.withColumn("component", F.col("rid")) if label is None else held.join(label, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
        # later pivots are other documents: the score counts less with each round
        rank = F.col("score") if not turn else F.col("score") * (F.pmod(F.xxhash64("rid", F.lit(turn)), F.lit(1000)) / 1000.0)
        now = now.select(F.explode("tokens").alias("token"), "rid", "n", "component", rank.cast("float").alias("rank"))
        signs = [F.sum(F.lit(1) - 2 * F.shiftright(F.xxhash64("component"), k).bitwiseAND(F.lit(1).cast("long"))).alias(f"s{k}") for k in range(SIGNS)]
        stats = now.groupBy("token").agg(F.count("*").alias("c"), F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.struct("rank", "rid", "n", "component")).alias("pivot"), *signs)
        # the mean square of sums of random signs is the number of pairs within components: cross is that of all others
        cross = (F.col("c") * F.col("c") - sum(F.col(f"s{k}") * F.col(f"s{k}") for k in range(SIGNS)) / SIGNS) / 2
        stats = written(stats.filter("low < high").select("token", "c", "pivot", F.greatest(F.lit(0.0), cross).alias("cross")), "stats")
        open_ = written(now.drop("rank").join(stats.drop("cross"), "token"), "open")
        size = stats.agg(F.coalesce(F.sum("cross"), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.coalesce(F.max("c"), F.lit(0)).alias("most")).first()
        drop(stats)
        last = turn > 0 and (size.pairs <= 8 * size.rows or new[-1] <= 0.1 * new[0])
        if last:
            pairs = _open_pairs(open_, base, size.most > DENSE)
        else:
            star = open_.filter("component <> pivot.component").select("rid", F.col("n").alias("n_a"), F.col("pivot.rid").alias("pivot"), F.col("pivot.n").alias("n_b")).filter(SIZES)
            # here c counts only tokens of which the other is the pivot: too few, at worst, and then the last round has the pair
            star = star.groupBy("rid", "pivot", "n_a", "n_b").agg(F.count("*").alias("c")).filter(ENOUGH)
            best = star.groupBy("rid", "n_a").agg(F.max_by(F.struct("pivot", "n_b"), F.struct("c", "pivot")).alias("to")).withColumn("swap", F.col("rid") > F.col("to.pivot"))
            either = lambda p, q: F.when(F.col("swap"), F.col(q)).otherwise(F.col(p))
            pairs = best.select(either("rid", "to.pivot").alias("a"), either("to.pivot", "rid").alias("b"), either("n_a", "to.n_b").alias("n_a"), either("to.n_b", "n_a").alias("n_b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        drop(open_)
        found = _verified(pairs, base)
        new.append(found.count())
        links = found if links is None else links.unionByName(found)
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        label = written(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "rid"), "label")
        turn += 1
        if last:
            break
    drop(held)
    grouped = classes.join(label, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    known = grouped.join(least, "component").select("key", "component", "component_id", "n_copies")
    out = rows.filter("n > 0").join(known, "key").select("rid", "doc_id", F.col("n").alias("n_shingles"), "component", "component_id", "n_copies")
    alone = rows.filter("n = 0").select("rid", "doc_id", F.col("n").alias("n_shingles"), F.col("rid").alias("component"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies"))
    out = written(out.unionByName(alone), "classes")
    drop(rows)
    drop(classes)
    return out
