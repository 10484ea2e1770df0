"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from rulequarry.llm import conversation_repair, queries

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def plain_repair(rows):
    """Cost, audit and repaired turns of (role, text, fault) rows, by Dijkstra's search over whole audits."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        for role in ("user", "assistant"):
            if to := NEXT.get((state, role[0])):
                heapq.heappush(heap, (cost + 5, audit + "I", i, to, out + ((role, ""),)))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if to := NEXT.get((state, role[:1])):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, out + ((role, text),)))
                for new in ("user", "assistant"):
                    if to := NEXT.get((state, new[0])):
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, to, out + ((new, text),)))


def plain(table):
    """The query's rows by its contract, from (conv_id, turn, role, text) rows."""
    groups, result = defaultdict(list), []
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        damage = zlib.crc32(key.encode()) % 20
        groups[conv]
        if damage == 0:
            continue
        text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
        role = "user" if damage == 4 else role
        groups[conv] += [(turn, role, text)] * (2 if damage == 3 else 1)
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in rows:
            left = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[0] for r in rows} - {None}
        cost, audit, out = plain_repair([(r[1], r[2], f) for r, f in zip(rows, faults)])
        result.append(
            (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")))
            + (sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
        )
    return sorted(result, key=str)


def test_least_audit_is_that_of_a_search():
    rng = random.Random(1)
    for _ in range(3000):
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", " ", ""]), "x", rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(10))]
        want = plain_repair(rows)
        got = conversation_repair.least_audit([(r[:1], f not in ("blank", "duplicate"), 5 * (f == "truncated")) for r, _, f in rows])
        assert got == want[:2], rows


def test_long_runs_keep_to_the_layers():
    """Stretches of one role, of turns that can't stay and of cut turns, longer than a word has layers."""
    rng = random.Random(2)
    for _ in range(150):
        rows = []
        while len(rows) < 60:
            rows += [(rng.choice(["system", "user", "assistant", "tool"]), "x", rng.choice(["", "truncated", "blank"]))] * rng.randrange(1, 25)
        got = conversation_repair.least_audit([(r[:1], f != "blank", 5 * (f == "truncated")) for r, _, f in rows])
        assert got == plain_repair(rows)[:2]


ODD = [
    (None, 0, "user", "Null id."), (None, 1, "assistant", "Yes."), (None, None, None, None),
    (-1, 0, "user", None), (-1, 0, None, "Same turn."), (-1, 0, "user", "Same turn."), (-1, 0, "user", "Same turn."), (-1, 0, "user", "Same turn."), (-1, None, "", "no role"),
    (-2, 5, "system", "Alone."), (-3, None, "user", " \t\n"), (-4, 2**40, "tool", "é" * 50_000 + "!"), (-4, -(2**40), "assistant", "ü? \x0b"),
    *((-5, t, "user", "again" if t % 3 else "Again.") for t in range(400)),
]


@pytest.mark.parametrize("table", ["given", "odd", "empty"])
def test_query_is_the_contract(spark, tmp_path, table):
    schema = "conv_id long, turn long, role string, text string"
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    if table != "given":
        rows = spark.createDataFrame(ODD if table == "odd" else [], schema).selectExpr("*", "1 AS kind", "'x' AS audit", "2 AS gone", "3 AS digest")
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_conversation_repair(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == plain([r[:4] for r in rows.collect()])


def test_repaired_turns(spark):
    rows = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    found = defaultdict(list)
    for r in conversation_repair.repaired_turns(rows).collect():
        found[r.conv_id].append((r.position, r.role, r.text))
    for r in conversation_repair.repair(rows).collect():
        lines = sorted(found[r.conv_id])
        assert [x[0] for x in lines] == list(range(len(lines)))
        assert re.fullmatch("(s?(ua)+)?", "".join(x[1][0] for x in lines))
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{x[1]}:{x[2]}" for x in lines).encode()).hexdigest()


def test_statement(spark):
    import compare

    sf = "/root/testdata/sf0.001"
    assert compare.differences(spark, compare.connection(sf), queries.op13_conversation_repair, conversation_repair.ORACLE, sf) == ""
