"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

Roles must read `(s?(ua)+)?` by their initials. Edits of a turn: Keep (0), Rerole to user or assistant (1),
Delete (2; the only one for blank and repeated turns); anywhere an empty user or assistant turn may be
Inserted (5); a turn that stays although its text is cut off costs 5 more.

The method is that of cost layers, as Wu and Manber's search with errors has them: after each turn
a word of bits says which states of the grammar are reached at which cost, four bits (the states) a layer,
so an edit is a move inside all layers at once and a shift by as many layers as it costs. The first layer
that accepts gives the cost; the bits that lead to it are marked from the end, and the trace takes
the least letter that stays on marked bits. A word holds 16 layers from the cheapest on: from any state the rest of
a conversation costs at most 12 more than from any other (two insertions and a deletion), so a dearer state
is on no cheapest path and nothing is lost; time and memory are linear in the turns.

Two passes over turns sorted by conversation: the first reads flags and digests only (no texts) and keeps nine bytes and
a digest a turn; the second reads the texts with the audit before them and hashes or returns
repaired turns one by one. A conversation is read in order by one task in each, as its digest is a chain.

Null role or text reads as one space. Turns come by number, nulls first, equal ones by role and then by the MD5 of
the text; rows repeated in full are duplicates. Null conv_id is a conversation of its own. Roles of other initials
can't be kept. An empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sets of states, by what was read: nothing, a system turn, a user turn, an assistant turn. Layers of a word.
START, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8
LAYERS = 16
_EACH = int("1" * LAYERS, 16)
_START, _SYSTEM, _USER, _ASSISTANT = (_EACH * s for s in (START, SYSTEM, USER, ASSISTANT))
_ALL = _EACH * 15
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"


def _move(word: int, initial: str) -> int:
    """Where a turn of this initial leads from the states of each layer."""
    if initial == "s":
        return (word & _START) << 1
    if initial == "u":
        return (word & _START) << 2 | (word & _SYSTEM) << 1 | (word & _ASSISTANT) >> 1
    return (word & _USER) << 1 if initial == "a" else 0


def _unmove(word: int, initial: str) -> int:
    """From where a turn of this initial leads to the states of each layer."""
    if initial == "s":
        return (word & _SYSTEM) >> 1
    if initial == "u":
        to = word & _USER
        return to >> 2 | to >> 1 | to << 1
    return (word & _ASSISTANT) >> 1 if initial == "a" else 0


def _inserted(word: int) -> int:
    for _ in range(2):  # a third would lead back to a state that was left
        word |= (_move(word, "u") | _move(word, "a")) << 4 * INSERT
    return word & _ALL


def _deal(word: int, by: int) -> int:
    """Layers moved to higher (by > 0) or lower costs."""
    return word << 4 * by if by >= 0 else word >> -4 * by


#: A turn is (initial, stays, extra): whether it may stay, and what that costs.
Turn = tuple[str, bool, int]


def _step(word: int, turn: Turn) -> int:
    initial, stays, extra = turn
    out = word << 4 * DELETE
    if stays:
        out |= _move(word, initial) << 4 * extra | (_move(word, "u") | _move(word, "a")) << 4 * (REROLE + extra)
    return out


def _unstep(word: int, turn: Turn) -> int:
    initial, stays, extra = turn
    out = word >> 4 * DELETE
    if stays:
        out |= _unmove(word >> 4 * extra, initial)
        low = word >> 4 * (REROLE + extra)
        out |= _unmove(low, "u") | _unmove(low, "a")
    return out


def least_audit(turns: list[Turn]) -> tuple[int, str]:
    """The least cost, and the least of the edits' initials of that cost."""
    word, low = _inserted(START), 0
    words, lows = [word], [low]
    for turn in turns:
        # deleting keeps each state, so the next word has no more than two empty layers below
        wide = _step(word, turn)
        drop = ((wide & -wide).bit_length() - 1) // 4
        low += drop
        word = _inserted(wide >> 4 * drop & _ALL)
        words.append(word)
        lows.append(low)
    accept = word & (_START | _ASSISTANT)
    cost = low + ((accept & -accept).bit_length() - 1) // 4
    # what leads to the accepting states of that layer, from the end
    live = word & 15 * 16 ** (cost - low) & (_START | _ASSISTANT)
    marks = [0] * len(words)
    for i in range(len(turns), -1, -1):
        for _ in range(2):
            back = live >> 4 * INSERT
            live |= words[i] & (_unmove(back, "u") | _unmove(back, "a"))
        marks[i] = live
        if i:
            live = words[i - 1] & _unstep(_deal(live, lows[i] - lows[i - 1]), turns[i - 1])
    audit, at, i = [], START, 0  # `at`: the one state and layer that this audit leads to, from lows[i] up
    while True:
        if i < len(turns):
            initial, stays, extra = turns[i]
            by = lows[i] - lows[i + 1]
        else:
            stays = False
        tries = [("D", _deal(at, DELETE + by), 1)] if i < len(turns) else []
        tries.append(("I", (_move(at, "u") | _move(at, "a")) << 4 * INSERT, 0))
        if stays:
            tries += [("K", _deal(_move(at, initial), extra + by), 1), ("R", _deal(_move(at, "u") | _move(at, "a"), REROLE + extra + by), 1)]
        for letter, to, on in tries:
            if to & marks[i + on]:
                audit.append(letter)
                at, i = to, i + on
                break
        else:
            return cost, "".join(audit)


def _turns(conversations: DataFrame, gone: Column | None) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"))
    return rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


_ORDER = ("turn", "role", "digest")


def _sorted(rows: DataFrame, *before: str) -> DataFrame:
    """Conversations together, each in order, for passes that read a row at a time."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *before, *(F.col(c).asc_nulls_first() for c in _ORDER))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    """What the first pass keeps of a conversation while it reads its turns."""

    def __init__(self):
        self.first = self.last = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.seen, self.turns, self.before = set(), [], None

    def add(self, turn, role, digest, blank, cut):
        if turn is not None:
            self.distinct += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        initial, key = role[:1], role.encode() + b"\0" + digest
        again = key in self.seen
        self.seen.add(key)
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.blank += blank
        self.duplicate += again and not blank
        cut = cut and not again and not blank
        self.truncated += cut
        self.turns.append((initial, not (blank or again), CUT if cut else 0))

    def summary(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        cost, audit = least_audit(self.turns)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def audits(conversations: DataFrame, gone: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each conversation.

    Rows of which `gone` holds count as not there, but their conv_id stays.
    """
    trimmed = F.rtrim("text", F.lit(SPACE))
    rows = _turns(conversations, gone).select("conv_id", *_ORDER, "gone", (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"))
    id_type = rows.schema["conv_id"].dataType

    def judge(batches):
        now, held = None, None

        def out(done, type_):
            cols = list(zip(*((i, *c.summary()) for i, c in done)))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], type_), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.large_string()).cast(pa.string())], names=["conv_id", *_COUNTS, "audit"])

        type_ = None
        for batch in batches:
            type_, done = batch.schema.field(0).type, []
            for conv, turn, role, digest, away, blank, cut in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or conv != now:
                    if held is not None:
                        done.append((now, held))
                    now, held = conv, _Conversation()
                if not away:
                    held.add(turn, role, digest, blank, cut)
            if done:
                yield out(done, type_)
        if held is not None:
            yield out([(now, held)], type_)

    return _sorted(rows).mapInArrow(judge, f"conv_id {id_type.simpleString()}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string")


class _Replay:
    """Repaired turns of a conversation from its audit, as its turns come."""

    def __init__(self, audit: str):
        self.audit, self.k, self.state = audit, 0, START

    def _next(self) -> str:
        """The role that a rerole or insertion gives here."""
        self.state = ASSISTANT if self.state == USER else USER
        return "user" if self.state == USER else "assistant"

    def inserts(self):
        while self.audit[self.k : self.k + 1] == "I":
            self.k += 1
            yield self._next(), ""

    def turn(self, role: str, text: str):
        yield from self.inserts()
        letter = self.audit[self.k]
        self.k += 1
        if letter == "R":
            yield self._next(), text
        elif letter == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield role, text


def _replayed(conversations: DataFrame, gone: Column | None, found: DataFrame) -> DataFrame:
    """Each conversation's summary row, and behind it its turns in order."""
    rows = _turns(conversations, gone).filter("NOT gone").select("conv_id", F.lit(1).alias("kind"), *_ORDER, "text", *(F.lit(None).cast("long").alias(c) for c in _COUNTS), F.lit(None).cast("string").alias("audit"))
    heads = found.select("conv_id", F.lit(0).alias("kind"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in (*_ORDER, "text")), *_COUNTS, "audit")
    return _sorted(rows.unionByName(heads), "kind")


def repair(conversations: DataFrame, gone: Column | None = None) -> DataFrame:
    """audits() with repaired_sha256: the digest of the repaired `role:text`, newline-joined."""
    stream = _replayed(conversations, gone, audits(conversations, gone))
    id_type = stream.schema["conv_id"].dataType

    def hashed(batches):
        head, replay, digest, started = None, None, None, False

        def feed(lines):
            nonlocal started
            for role, text in lines:
                digest.update((("\n" if started else "") + role + ":" + text).encode())
                started = True

        def close():
            feed(replay.inserts())
            return (*head, digest.hexdigest())

        def out(done, type_):
            cols = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], type_), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.string()), pa.array(cols[8], pa.string())], names=["conv_id", *_COUNTS, "audit", "repaired_sha256"])

        type_ = None
        for batch in batches:
            type_, done = batch.schema.field(0).type, []
            for conv, kind, _, role, _, text, *counts, audit in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if replay is not None:
                        done.append(close())
                    head, replay, digest, started = (conv, *counts, audit), _Replay(audit), hashlib.sha256(), False
                else:
                    feed(replay.turn(role, text))
            if done:
                yield out(done, type_)
        if replay is not None:
            yield out([close()], type_)

    return stream.mapInArrow(hashed, f"conv_id {id_type.simpleString()}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string")


def repaired_turns(conversations: DataFrame, gone: Column | None = None) -> DataFrame:
    """(conv_id, position, role, text): the turns of the repaired conversations, positions from 0."""
    stream = _replayed(conversations, gone, audits(conversations, gone))
    id_type = stream.schema["conv_id"].dataType

    def lines(batches):
        conv = replay = None
        position, type_ = 0, None

        def out(done):
            cols = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], type_), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["conv_id", "position", "role", "text"])

        for batch in batches:
            type_, done = batch.schema.field(0).type, []
            for next_conv, kind, _, role, _, text, *_, audit in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    new = replay.inserts() if replay is not None else ()
                else:
                    new = replay.turn(role, text)
                for line in new:
                    done.append((conv, position, *line))
                    position += 1
                if kind == 0:
                    conv, replay, position = next_conv, _Replay(audit), 0
            if done:
                yield out(done)
        if replay is not None:
            done = [(conv, position + k, *line) for k, line in enumerate(replay.inserts())]
            if done:
                yield out(done)

    return stream.mapInArrow(lines, f"conv_id {id_type.simpleString()}, position long, role string, text string")


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """The conversations with the damage of the query's contract, and which of the rows are gone.

    By crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 takes `[.!?]` out, 3 repeats it, 4 sets role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat_ws(":", part("conv_id"), part("turn"))) % 20).alias("damage"))
    rows = rows.withColumn("text", F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")))
    times = F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("time", F.explode(times)).drop("time"), F.col("damage") == 0


def _oracle() -> str:
    """The query's contract in SQL: the least (cost, audit) of each state, turn by turn."""

    def plus(s: str, cost: str, letter: str, line: str | None = None) -> str:
        text = f"{s}.t" if line is None else f"CASE WHEN {s}.t = '' THEN {line} ELSE {s}.t || chr(10) || {line} END"
        return f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {text}}}"

    def least(*of: str) -> str:
        return f"list_sort([{', '.join(of)}])[1]"

    def inserted(a: str) -> str:
        user = [plus(f"{a}{k}", str(INSERT), "I", "'user:'") for k in (1, 2, 4)]
        return f"{a}1 AS {a}{a}1, {a}2 AS {a}{a}2, {least(f'{a}3', *user)} AS {a}{a}3, {least(f'{a}4', plus(f'{a}3', str(INSERT), 'I', "'assistant:'"))} AS {a}{a}4"

    never = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 't': ''}"
    may = f"CASE WHEN stays THEN extra ELSE {10**9} END"
    keep = lambda s, initial: plus(s, f"(CASE WHEN r = '{initial}' THEN {may} ELSE {10**9} END)", "K", "(role || ':' || text)")
    new = lambda s, role: plus(s, f"({may} + {REROLE})", "R", f"('{role}:' || text)")
    gone = lambda s: plus(s, str(DELETE), "D")
    move = f"""{gone('s1')} AS m1, {least(gone('s2'), keep('s1', 's'))} AS m2,
      {least(gone('s3'), *[keep(f's{k}', 'u') for k in (1, 2, 4)], *[new(f's{k}', 'user') for k in (1, 2, 4)])} AS m3, {least(gone('s4'), keep('s3', 'a'), new('s3', 'assistant'))} AS m4"""
    close = lambda rows: f"SELECT conv_id, i, mmmm1 AS s1, mmmm2 AS s2, mmmm3 AS s3, mmmm4 AS s4 FROM (SELECT *, {inserted('mm')} FROM (SELECT *, {inserted('m')} FROM ({rows})))"
    part = lambda c: f"coalesce(CAST({c} AS VARCHAR), ' ')"
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT [list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(k AS BIGINT) FOR k IN range(8)]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) FOR i IN range(256)] AS t),
d AS (
  SELECT conv_id, turn, {part('role')} AS role, {part('text')} AS text,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split({part('conv_id')} || ':' || {part('turn')}, '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) % 20 AS damage
  FROM conversations, crc),
a AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role, CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN damage = 3 THEN [1, 2] ELSE [1] END) AS copy FROM d WHERE damage <> 0)),
o AS (SELECT *, left(role, 1) AS r, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM a),
f AS MATERIALIZED (
  SELECT *, CASE WHEN cut = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au'), false) AS odd FROM o),
ids AS (SELECT DISTINCT conv_id FROM d),
walk AS (
  {close(f"SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS m1, {never} AS m2, {never} AS m3, {never} AS m4 FROM ids")}
  UNION ALL
  {close(f"SELECT conv_id, i, {move} FROM (SELECT f.conv_id, f.i, f.r, f.role, f.text, f.fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN f.fault = 'truncated' THEN {CUT} ELSE 0 END AS extra, s1, s2, s3, s4 FROM walk JOIN f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.i = walk.i + 1)")}),
best AS (SELECT conv_id, {least('s1', 's4')} AS b FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE odd) AS illegal FROM f GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.c AS cost, b.a AS audit, sha256(b.t) AS repaired_sha256
FROM best LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM best.conv_id
"""


ORACLE = _oracle()
