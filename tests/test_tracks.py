"""Merging of two tracks and what is made of it, against plain versions."""

import datetime
import random

import pandas as pd
from pyspark.sql import functions as F

import compare
from rulequarry.operators import candidates
from rulequarry.plans import catalog
from rulequarry.schema import PARAMS

SCHEMA = f"type string, description string, support double, consistency double, severity string, params {PARAMS}, evidence array<string>"


def params(**given):
    names = [x.split(": ")[0] for x in PARAMS[len("struct<") : -1].split(", ")]
    return tuple(given.get(n) for n in names)


def test_two_tracks(spark):
    say = "The agent always calls `{}` before calling `{}`"
    first = [
        ("ordering", say.format("check_stock", "create_order"), 0.9, 0.95, "high", params(tool_a="check_stock", tool_b="create_order"), ["t1", "t2"]),
        ("ordering", say.format("login", "logout"), 0.9, 0.95, "high", params(tool_a="login", tool_b="logout"), ["t3"]),
        ("ordering", say.format("9bad", "x"), 1.0, 1.0, "high", params(tool_a="9bad", tool_b="x"), []),
        ("conditional", "Calls `refund` when asked", 0.1, 0.1, "low", params(keyword="refund", tool="refund"), []),
    ]
    second = [
        ("ordering", say.format("check_stock", "create_order") + " at all", 0.5, 1.0, "low", params(tool_a="check_stock", tool_b="create_order"), ["t2", "t9"]),
        ("ordering", say.format("check_stock", "create_order") + " at all!", 0.7, 0.5, "low", params(tool_a="check_stock", tool_b="create_order"), ["t9", "t8"]),
    ]
    found = candidates.two_tracks(spark.createDataFrame(first, SCHEMA), spark.createDataFrame(second, SCHEMA)).collect()
    got = {r.description: r for r in found}
    both = got[say.format("check_stock", "create_order") + " at all"]
    # the suggestions' averages: 0.6 and 0.75; login and logout aren't close enough to be merged, or disagree
    assert both.track == "both" and both.n == 2 and both.support == 0.9 and both.consistency == 0.95 and both.cross_val_bonus == 0.2 and both.evidence == ["t1", "t2", "t9", "t8"]
    assert both.confidence == round(0.4 * 0.9 + 0.3 * 0.95 + 0.2 + 0.1, 4) and both.status == "active" and both.severity == "low" and both.params.tool_b == "create_order"
    alone = got[say.format("login", "logout")]
    assert alone.track == "statistical" and alone.n == 1 and alone.status == "pending" and len(got) == 2
    assert [r.confidence for r in found] == sorted((r.confidence for r in found), reverse=True)
    none = candidates.two_tracks(spark.createDataFrame(first, SCHEMA), spark.createDataFrame([], SCHEMA)).collect()
    assert [(r.description, r.track) for r in none] == [(say.format("check_stock", "create_order"), "statistical"), (say.format("login", "logout"), "statistical")]
    assert candidates.two_tracks(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA)).count() == 0


def test_mine_of_long_chains(spark, tmp_path):
    """A chain of five tools is a candidate as a whole, and its parts of three or four, which as many traces have, are none."""
    tools = ["signup", "view", "click", "purchase", "error"]
    start = datetime.datetime(2024, 1, 1)
    events = [(5 * u + k, start + datetime.timedelta(minutes=k), u, t, 1.0, '{"k": 1}') for u in range(40) for k, t in enumerate(tools if u < 36 else tools[:2])]
    frame = pd.DataFrame(events, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    frame.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    (tmp_path / "documents.parquet").symlink_to("/root/testdata/sf0.001/documents.parquet")
    found, con = catalog.queries()["mine_two_tracks"](spark, str(tmp_path)), compare.connection(str(tmp_path))
    got = found.collect()
    chains = [(r.description, r.support) for r in got if " then " in r.description]
    assert chains == [("The agent always calls " + " then ".join(f"`{t}`" for t in tools), 0.9)]
    out = con.execute(catalog.oracle_sql()["mine_two_tracks"])
    assert compare.rows(found.columns, got) == compare.rows([d[0] for d in out.description], out.fetchall())


def test_agreement_of_every_pair(spark):
    """Random maps of parameters: a cluster stays if no pair of its members has different values of a shared key."""
    rng = random.Random(4)
    rows, found, groups = [], [], {}
    for k in range(300):
        given = {key: rng.choice("xy") for key in rng.sample(["tool_a", "tool", "segment", "category", "threshold"], rng.randrange(4))}
        rows.append((k, given or None))
        c = k % 90
        found.append((k, c))
        groups.setdefault(c, []).append((k, given))
    want = {}
    for c, members in groups.items():
        ok = all(a[key] == b[key] for _, a in members for _, b in members for key in candidates.SHARED_KEYS if key in a and key in b)
        want |= {k: c if ok else k for k, _ in members}
    got = candidates.agreeing(spark.createDataFrame(rows, "item_id long, params map<string, string>"), spark.createDataFrame(found, "item_id long, cluster long"))
    assert {r.item_id: r.cluster for r in got.collect()} == want and len(set(want.values())) not in (90, 300)


def test_evidence_is_cut_in_order(spark):
    rows = [(k, f"d{k}", 1.0, 1.0, "llm", [f"e{(k * 37 + j) % 400}" for j in range(80)]) for k in range(6)]
    frame = spark.createDataFrame(rows, "item_id long, description string, support double, consistency double, track string, evidence array<string>")
    row = candidates.merged(frame, frame.select("item_id", F.lit(0).alias("cluster"))).first()
    assert row.evidence == list(dict.fromkeys(e for r in rows for e in r[5]))[: candidates.MAX_EVIDENCE] and row.track == "llm" and row.n == 6


def test_repeats_are_merged_without_lists_of_evidence(spark):
    """The first traces of a group, by numbers and by names as the order, without the group's evidence in one array."""
    from pyspark.sql import functions as F

    from rulequarry.operators import candidates

    lists = {k: [f"t{(k * 7 + i * i) % 40}" for i in range(k % 9)] for k in range(60)}
    data = [(k, None if k % 5 == 4 else f"Rule {k % 5}!", "a" if k % 2 else None, k / 60, 1 - k / 60, lists[k]) for k in range(60)] + [(99, "gap", "a", 0.5, 0.5, None)]
    rows = spark.createDataFrame(data, "item_id long, description string, type string, support double, consistency double, evidence array<string>")
    named = rows.withColumn("item_id", F.struct(F.lpad(F.col("item_id").cast("string"), 3, "0").alias("name")))
    want = {}
    for k, description, kind, *_, evidence in data:
        found = want.setdefault((kind, description and description.lower().strip("!")), [])
        found += [t for t in evidence or [] if t not in found]
    for given in (rows, named):
        out = candidates.deduplicated(given, most=6)
        got = {(r.type, r.key): r.evidence for r in out.collect()}
        assert got.pop(("a", "gap")) is None
        assert got == {k: v[:6] for k, v in want.items() if k != ("a", "gap")}
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert not any("collect_list(struct(__o" in line and "evidence" in line[line.index("collect_list(struct(__o") :].split(")")[0] for line in plan.splitlines())
