"""Suffix-array dedup: every byte within a 200-byte string that starts twice anywhere is removed.

1. Anchors. The anchor of a 200-byte window is its leftmost 32-byte run of least hash, so equal
   windows have equal anchors. Anchors that occur at one place only are dropped by a count that is
   combined on the map side; about one byte in 85 gives a row.
2. Pieces. Consecutive windows of one anchor make a piece of up to 368 bytes. Equal pieces become
   one with a count, combined on the map side: copies of documents and passages go no further, however many.
3. Merged transforms. The distinct pieces of an anchor come together, cut to what another one may share. Tasks put them into shards,
   sort each shard's suffixes to 200 bytes, keep its Burrows-Wheeler transform, and merge the transforms
   by interleave refinement (Holt and McMillan, 2014), k ways at once: the interleave, a shard number
   for each suffix, is dealt out stably by the symbol before each suffix, which orders it by one symbol more; what
   is sorted is the symbols, never the suffixes of several shards. A symbol is a block of 8 bytes, so
   25 rounds give 200 bytes. Each round also splits the intervals of equal prefixes; those of the
   last round that hold two suffixes or more are the repeated strings, and the round in which an interval
   splits gives the common prefix of its neighbours.
4. An anchor with more than MAX_PIECES distinct pieces (a line that very many documents have, each between other
   text) would be one task: its pieces are split by the text around the anchor, again and again if need be, until the
   transforms of a group can be merged in a task.

Null or empty text has no bytes. Repeated rows are separate documents with equal bytes. Matches
never cross documents; kept bytes may cut a character in two, so they are binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.llm._scratch import bucketed, drop, release, written
from rulequarry.llm._text import BYTE, buffers, mix, powers, sliding_min

LENGTH, GRAM, BLOCK = 200, 32, 8
MAX_PIECES = 4096
SHARD_BYTES, BIN_BYTES = 1 << 13, 1 << 20


# ---- merged transforms ------------------------------------------------------------------------


def stable_order(x: np.ndarray) -> np.ndarray:
    """The stable order of small non-negative integers, by 16 bits at a time."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    if len(x) and int(x.max()) > 0xFFFF:
        order = order[np.argsort((x >> 16).astype(np.uint16)[order], kind="stable")]
    return order


class Shard:
    """Suffixes of some pieces in order of their first `length` bytes, with the block before each of them.

    Each piece is followed by BLOCK empty suffixes, which come first. Places are in the joined text.
    """

    def __init__(self, pieces: list[bytes], length: int = LENGTH):
        size = np.array([len(p) for p in pieces], np.int64)
        text = np.frombuffer(b"".join(p + bytes(2 * BLOCK) for p in pieces) + bytes(BLOCK), np.uint8)
        starts = np.cumsum(size + 2 * BLOCK) - size - 2 * BLOCK
        self.starts, self.sizes = starts, size
        n = len(text) - BLOCK
        block = np.zeros(n, np.uint64)
        for j in range(BLOCK):
            block |= text[j : n + j].astype(np.uint64) << np.uint64(8 * (BLOCK - 1 - j))
        piece = np.repeat(np.arange(len(pieces)), size + 2 * BLOCK)
        at = np.arange(n) - starts[piece]
        real, empty = at < size[piece], (at >= size[piece]) & (at < size[piece] + BLOCK)
        # ranks by doubling: 8, 16, .. bytes; empty suffixes rank 0, and so does what lies behind them
        _, rank = np.unique(block, return_inverse=True)
        rank = np.where(real, rank + 1, 0)
        depth = BLOCK
        while depth < length:
            after = np.zeros(n, np.int64)
            after[:-depth or None] = rank[depth:] if depth < n else 0
            ahead = at + depth
            after = np.where(ahead < size[piece], after, 0)
            _, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
            rank = np.where(real, rank + 1, 0)
            depth *= 2
        places = np.flatnonzero(real | empty)
        self.suffixes = places[np.argsort(rank[places], kind="stable")]
        self.n_empty = int(empty.sum())
        before = self.suffixes - BLOCK
        # the first BLOCK suffixes of a piece have no block before them within it
        self.has_before = at[self.suffixes] >= BLOCK
        self.before = block[np.maximum(before, 0)]


def interleave(shards: list[Shard], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each suffix in merged order, common prefix with the one before).

    Empty suffixes stay in front; common prefixes are in whole blocks, up to `length`.
    """
    sizes = [len(s.suffixes) for s in shards]
    n = sum(sizes)
    n_empty = sum(s.n_empty for s in shards)
    every = np.concatenate([s.before for s in shards])
    has = np.concatenate([s.has_before for s in shards])
    _, symbols = np.unique(every, return_inverse=True)
    base = np.cumsum([0, *sizes])
    empty_z = np.repeat(np.arange(len(shards), dtype=np.int16), [s.n_empty for s in shards])
    z = np.concatenate([empty_z, np.repeat(np.arange(len(shards), dtype=np.int16), [k - s.n_empty for k, s in zip(sizes, shards)])])
    group = np.zeros(n, np.int64)  # number of the interval of each place
    lcp = np.full(n, -1, np.int32)
    lcp[0] = 0
    if n_empty < n:
        lcp[n_empty] = 0
    for turn in range(-(-length // BLOCK)):
        # the k-th suffix of a shard in merged order is the k-th of its own order
        own = np.empty(n, np.int64)
        for k in range(len(shards)):
            own[np.flatnonzero(z == k)] = np.arange(base[k], base[k + 1])
        kept = np.flatnonzero(has[own])
        symbol = symbols[own[kept]]
        order = kept[stable_order(symbol)]
        z = np.concatenate([empty_z, z[order]])
        symbol, came = symbols[own[order]], group[order]
        split = np.ones(len(order), bool)
        split[1:] = (symbol[1:] != symbol[:-1]) | (came[1:] != came[:-1])
        new = np.zeros(n, np.int64)
        new[n_empty:] = np.cumsum(split)
        fresh = np.flatnonzero(split) + n_empty
        fresh = fresh[lcp[fresh] < 0]
        lcp[fresh] = turn * BLOCK
        group = new
    lcp[lcp < 0] = length
    return z, lcp


def repeated_windows(pieces: list[bytes], length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """Of each piece: whether the string of `length` bytes at each place where one fits also starts at another place of the pieces."""
    parts, now, held = [], [], 0
    for p in pieces:
        if now and held + len(p) > shard_bytes:
            parts.append(now)
            now, held = [], 0
        now.append(p)
        held += len(p)
    parts.append(now)
    shards = [Shard(p, length) for p in parts]
    z, lcp = interleave(shards, length)
    # neighbours that share `length` bytes are one interval of equal strings
    first = lcp < length
    n_empty = sum(s.n_empty for s in shards)
    fits, where = np.zeros(len(z), bool), np.zeros(len(z), np.int64)
    for k, s in enumerate(shards):
        mine = np.flatnonzero(z == k)
        piece = np.searchsorted(s.starts, s.suffixes, side="right") - 1
        fits[mine] = s.suffixes - s.starts[piece] + length <= s.sizes[piece]
        where[mine] = s.suffixes
    fits[:n_empty] = False
    interval = np.cumsum(first)
    # only suffixes of full length count: a shorter one padded with zeros may share an interval
    count = np.bincount(interval[fits], minlength=interval[-1] + 1 if len(interval) else 1)
    hit = fits & (count[interval] > 1) if len(interval) else fits
    out = []
    for k, s in enumerate(shards):
        flags = np.zeros(int(s.starts[-1] + s.sizes[-1]) + 1, bool)
        mine = np.flatnonzero(z == k)
        flags[where[mine[hit[mine]]]] = True
        out += [flags[a : a + max(0, size - length + 1)] for a, size in zip(s.starts.tolist(), s.sizes.tolist())]
    return out


# ---- anchors and pieces -----------------------------------------------------------------------


def _chunks(raw: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20):
    """(first row, place in that row, bytes, offsets): rows together up to `limit`, longer rows in parts that share LENGTH - 1 bytes."""
    row, n = 0, len(offsets) - 1
    while row < n:
        size = int(offsets[row + 1] - offsets[row])
        if size > limit:
            for a in range(0, size - LENGTH + 1, limit):
                b = min(size, a + limit + LENGTH - 1)
                yield row, a, raw[offsets[row] + a : offsets[row] + b], np.array([0, b - a])
            row += 1
            continue
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, 0, raw[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def _anchored(raw: np.ndarray, offsets: np.ndarray):
    """Runs of windows of one anchor: (row, first window, windows, anchor, place of the anchor)."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[raw] * up[:n], out=sums[1:])
    hashes = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    low = np.uint64((1 << 24) - 1)
    place = (sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), LENGTH - GRAM + 1) & low).astype(np.int64)
    end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.flatnonzero(np.arange(len(place)) + LENGTH <= end[: len(place)])
    if not len(at):
        return none, none, none, none, none
    place = place[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    k = np.flatnonzero(new)
    return np.searchsorted(offsets, at[k], side="right") - 1, at[k], np.diff(np.append(k, len(at))), hashes[place[k]].view(np.int64), place[k]


def _anchors(docs: DataFrame) -> DataFrame:
    def judge(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            ids = batch.column(0).to_numpy()
            for first, _, part, own in _chunks(raw, offsets):
                row, _, _, anchor, _ = _anchored(part, own)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row + first]), pa.array(anchor)], names=["rid", "anchor"])

    return docs.select("rid", "text").mapInArrow(judge, "rid long, anchor long")


def _pieces(rows: DataFrame) -> DataFrame:
    """(rid, text, anchors) -> (anchor, x, y, rid, start, place, body) of the runs whose anchor is among anchors; x, y: 128 bits of the body, place: of the anchor in it."""
    names = ["anchor", "x", "y", "rid", "start", "place", "body"]

    def judge(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            ids, wanted = batch.column(0).to_numpy(), batch.column(2)
            for first, shift, part, own in _chunks(raw, offsets):
                row, at, n, anchor, place = _anchored(part, own)
                chosen = np.zeros(len(row), bool)
                ends = np.searchsorted(row, np.arange(len(own)))
                for i in range(len(own) - 1):
                    a, b = ends[i], ends[i + 1]
                    if b > a:
                        chosen[a:b] = np.isin(anchor[a:b], wanted[first + i].values.to_numpy())
                row, at, n, anchor, place = row[chosen], at[chosen], n[chosen], anchor[chosen], place[chosen]
                data = part.tobytes()
                body = [data[a : a + k + LENGTH - 1] for a, k in zip(at.tolist(), n.tolist())]
                keys = np.frombuffer(b"".join(hashlib.blake2b(b, digest_size=16).digest() for b in body), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(ids[row + first]), pa.array(at - own[row] + shift), pa.array(place - at), pa.array(body, pa.binary())], names=names
                )

    return rows.select("rid", "text", "anchors").mapInArrow(judge, "anchor long, x long, y long, rid long, start long, place long, body binary")


def _ranges(flags: np.ndarray) -> list[int]:
    """Starts and ends of the runs of true, in turn."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.tolist()


def _reach(group: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """How many first bytes of each text another text of its group shares, at most."""
    size = np.array([len(t) for t in texts], np.int64)
    width = int(size.max(initial=0))
    if not width:
        return np.zeros(len(texts), np.int64)
    table = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(-1, width)
    keyed = np.concatenate([group.astype(">u8")[:, None].view(np.uint8), table], 1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"V{width + 8}").ravel(), kind="stable")
    differ = table[order[1:]] != table[order[:-1]]
    same = np.where(differ.any(1), differ.argmax(1), width)
    same = np.minimum(same, np.minimum(size[order[1:]], size[order[:-1]]))
    same[group[order[1:]] != group[order[:-1]]] = 0
    out = np.zeros(len(texts), np.int64)
    out[order[1:]] = same
    out[order[:-1]] = np.maximum(out[order[:-1]], same)
    return out


def repeated_in_groups(held: list[tuple[int, int, int, bytes]]) -> list[list[int]]:
    """(anchor, place, copies, body) with equal anchors next to each other -> starts and ends of each piece's repeated windows.

    Equal windows have the anchor at the same place, so what two pieces share lies around it. Each piece is cut
    to the bytes around its anchor that some other piece of the anchor has to the left and, maybe another one, to
    the right; no repeated window reaches beyond. Cut pieces that are equal become one. Where an anchor
    keeps several, their transforms are merged.
    """
    anchors = np.array([h[0] for h in held], np.int64)
    group = np.cumsum(np.concatenate([[True], anchors[1:] != anchors[:-1]])) if len(held) else anchors
    right = _reach(group, [h[3][h[1] :] for h in held])
    left = _reach(group, [h[3][: h[1]][::-1] for h in held])
    cut: dict[tuple[int, bytes], list[int]] = {}
    shift = [0] * len(held)
    for i, (_, place, copies, body) in enumerate(held):
        if copies > 1:
            # all its windows are repeated; the others are held against the whole of it that they may share
            left[i], right[i] = place, len(body) - place
        if left[i] + right[i] >= LENGTH:
            shift[i] = place - int(left[i])
            cut.setdefault((int(group[i]), body[shift[i] : place + int(right[i])]), []).append(i)
    several: dict[int, int] = {}
    for g, _ in cut:
        several[g] = several.get(g, 0) + 1
    open_ = {k[0] for k, members in cut.items() if several[k[0]] > 1 and len(members) == 1 and held[members[0]][2] == 1}
    merged = [k for k in cut if k[0] in open_]
    flags = dict(zip(merged, repeated_windows([t for _, t in merged]))) if merged else {}
    out: list[list[int]] = [[] for _ in held]
    for key, members in cut.items():
        if len(members) > 1 or held[members[0]][2] > 1:
            found = [0, len(key[1]) - LENGTH + 1]
        else:
            found = _ranges(flags[key]) if key in flags else []
        for i in members:
            out[i] = [a + shift[i] for a in found]
    return out


def _merged(rows: DataFrame) -> DataFrame:
    """Rows (anchor, x, y, n_copies, place, body) with those of an anchor next to each other -> (x, y, ranges of repeated windows)."""

    def judge(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            found = repeated_in_groups([(h[0], h[4], h[3], h[5]) for h in held])
            out = [(h[1], h[2], f) for h, f in zip(held, found) if f]
            x, y, found = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["x", "y", "ranges"])

        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if size > BIN_BYTES and held[-1][0] != r[0]:
                    yield flush()
                    held.clear()
                    size = 0
                held.append(r)
                size += len(r[5])
        if held:
            yield flush()

    return rows.select("anchor", "x", "y", "n_copies", "place", "body").mapInArrow(judge, "x long, y long, ranges array<long>")


def _split(rows: DataFrame) -> DataFrame:
    """Rows (x, y, n_copies, place, body, low, high) -> (x, y, shift, anchor, u, v, n_copies, place, body, low, high).

    A window has the anchor from its byte `low` to its byte `high` on. The two halves of that range part the windows of
    a piece in two, each a piece of its own (from `shift` on; u, v: 128 bits of it). All windows of a half
    have LENGTH less its width of bytes around the anchor in common, and a hash of these and the half is the new anchor.
    """
    names = ["x", "y", "shift", "anchor", "u", "v", "n_copies", "place", "body", "low", "high"]

    def judge(batches):
        for batch in batches:
            out = []
            for x, y, copies, place, body, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    first, last = max(0, place - b), min(len(body) - LENGTH, place - a)
                    if a <= b and first <= last:
                        part, common = body[first : last + LENGTH], body[place - a : place + LENGTH - b]
                        key = hashlib.blake2b(common + bytes((a, b)), digest_size=8).digest()
                        own = hashlib.blake2b(part, digest_size=16).digest()
                        out.append((x, y, first, *(int.from_bytes(h, "little", signed=True) for h in (key, own[:8], own[8:])), copies, place - first, part, a, b))
            types = [pa.int64()] * 8 + [pa.binary(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(names), types)], names=names)

    return rows.select("x", "y", "n_copies", "place", "body", "low", "high").mapInArrow(judge, "x long, y long, shift long, anchor long, u long, v long, n_copies long, place long, body binary, low int, high int")


def _decided(distinct: DataFrame, max_pieces: int) -> DataFrame:
    """Distinct pieces (anchor, x, y, n_copies, place, body, low, high) -> (x, y, ranges of repeated windows), maybe in several rows.

    Anchors of one piece are decided by its copies, those of up to max_pieces by merged transforms. The pieces of a
    larger one are split by what is around the anchor, and decided in the same way; after eight halvings a
    piece is one window, and those of an anchor are equal.
    """
    spark = distinct.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = written(distinct.groupBy("anchor").agg(F.count("*").alias("c")), "sizes")
    of = lambda which: distinct.join(sizes.filter(which).select("anchor"), "anchor", "left_semi")
    alone = of("c = 1").filter("n_copies > 1").select("x", "y", F.array(F.lit(0).cast("long"), (F.octet_length("body") - LENGTH + 1).cast("long")).alias("ranges"))
    merged = _merged(of(F.col("c").between(2, max_pieces)).repartition(n, "anchor").sortWithinPartitions("anchor"))
    found = alone.unionByName(merged)
    if sizes.filter(F.col("c") > max_pieces).isEmpty():
        found = written(found, "found")
        drop(sizes)
        return found
    parts = written(_split(of(F.col("c") > max_pieces)), "parts")
    below = parts.groupBy("anchor", F.col("u").alias("x"), F.col("v").alias("y"), "low", "high").agg(F.sum("n_copies").alias("n_copies"), F.min("place").alias("place"), F.min("body").alias("body"))
    below = written(below, "distinct")
    inner = _decided(below, max_pieces)
    again = parts.select("x", "y", "shift", "u", "v").join(inner.select(F.col("x").alias("u"), F.col("y").alias("v"), "ranges"), ["u", "v"])
    again = again.select("x", "y", F.transform("ranges", lambda r: r + F.col("shift")).alias("ranges"))
    found = written(found.unionByName(again), "found")
    for table in (sizes, parts, below, inner):
        drop(table)
    return found


def _cut(rows: DataFrame, texts: bool) -> DataFrame:
    """(doc_id, text, found) -> the digest and, if texts, kept bytes and removed spans; found: array of (start, ranges)."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "spans"][: 7 if texts else 5]

    def judge(batches):
        for batch in batches:
            out = []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist()):
                text = text or b""
                spans: list[list[int]] = []
                kept = text
                if found:
                    gone = np.zeros(len(text) + 1, np.int64)
                    for f in found:
                        edge = np.array(f["ranges"]) + f["start"]
                        np.add.at(gone, edge[0::2], 1)
                        np.add.at(gone, edge[1::2] + LENGTH - 1, -1)
                    gone = np.cumsum(gone[:-1]) > 0
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    edge = _ranges(gone)
                    spans = [[a, b] for a, b in zip(edge[0::2], edge[1::2])]
                out.append((doc_id, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, spans)[: len(names)])
            types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
            cols = zip(*out) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_bytes binary, spans array<array<long>>" if texts else "")
    return rows.select("doc_id", "text", "found").mapInArrow(judge, schema)


def suffix_dedup(docs: DataFrame, max_pieces: int = MAX_PIECES, texts: bool = True) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if texts, kept_bytes and spans (start, end in bytes)."""
    spark = docs.sparkSession
    table = bucketed(docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()), "rid", "docs")
    anchors = written(_anchors(table), "anchors")
    # written, so that the join has two plain exchanges and the partition of a common anchor can be split
    several = written(anchors.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"), "several")
    wanted = written(anchors.join(several, "anchor").groupBy("rid").agg(F.collect_set("anchor").alias("anchors")), "wanted")
    drop(anchors)
    drop(several)
    pieces = written(_pieces(table.join(wanted, "rid")), "pieces")
    drop(wanted)
    distinct = pieces.groupBy("anchor", "x", "y").agg(F.count("*").alias("n_copies"), F.min("place").alias("place"), F.min("body").alias("body"))
    distinct = written(distinct.withColumns({"low": F.lit(0), "high": F.lit(LENGTH - GRAM)}), "distinct")
    found = _decided(distinct, max_pieces)
    drop(distinct)
    release(spark)
    gone = pieces.select("x", "y", "rid", "start").join(found, ["x", "y"]).groupBy("rid").agg(F.collect_list(F.struct("start", "ranges")).alias("found"))
    gone = written(gone, "gone")
    drop(pieces)
    drop(found)
    return _cut(table.join(gone, "rid", "left"), texts)
