"""Review of queued traces, and verdicts on outputs by a judge of the user's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.operators.checks import with_each

#: Decisions on a queued item; an item without any is pending.
DECISIONS = ("approved", "rejected", "edited")
#: A judge reads so many characters of a response.
RESPONSE_CHARS = 2000


def decide(items: DataFrame, decisions: DataFrame, order: list[str]) -> DataFrame:
    """items (item_id, trace), decisions (item_id, decision, decided_by, decided_at, edit_notes, replacement, and the columns of `order`)
    -> item_id, decision, decided_by, decided_at, edit_notes, trace, n_decisions.

    Decisions hold in order, the last one counts; a replacement takes the trace's place only with an edit, and stays when
    later decisions bring none. Other decisions than DECISIONS and those of unknown items (see unknown()) don't count.
    """
    known = decisions.filter(F.col("decision").isin(*DECISIONS))
    at = F.struct(*order)
    edit = F.when((F.col("decision") == "edited") & F.col("replacement").isNotNull(), F.struct(at.alias("at"), "replacement"))
    said = F.struct(at.alias("at"), "decision", "decided_by", "decided_at", "edit_notes")
    last = known.groupBy("item_id").agg(F.max_by(said, at).alias("last"), F.max_by("replacement", edit["at"]).alias("replacement"), F.count("*").alias("n"))
    own = items.select("item_id", "trace").join(last, "item_id", "left")
    return own.select(
        "item_id", F.coalesce("last.decision", F.lit("pending")).alias("decision"), "last.decided_by", "last.decided_at", "last.edit_notes",
        F.coalesce("replacement", "trace").alias("trace"), F.coalesce("n", F.lit(0)).alias("n_decisions"),
    )


def unknown(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """The decisions on items that aren't there."""
    return decisions.join(items.select("item_id"), "item_id", "left_anti")


def judged(traces: DataFrame, rules: DataFrame, ask: Callable[[list[str]], list[str]] | None) -> DataFrame:
    """Rules of type output_format on each trace by a judge: trace_id, rule_id, severity, outcome, expected, observed.

    ask() takes prompts, JSON of the rule and the trace's responses, of an Arrow batch, and gives as many answers, which hold an
    object with verdict (pass, fail or not_applicable) and reason somewhere. No judge, one that fails, and any other answer
    make not_applicable. `traces` need trace_id and steps; rules are broadcast in checked parts.
    """
    wanted = rules.filter("type = 'output_format'")
    if ask is None:
        ask = lambda prompts: [None] * len(prompts)
    reply = F.array_join(F.expr("transform(filter(steps, s -> s.type = 'agent_response'), s -> coalesce(s.content, ''))"), " ")
    rows = with_each(traces.select("trace_id", F.substring(reply, 1, RESPONSE_CHARS).alias("reply")), wanted.withColumn("params", F.struct("description")))
    prompt = F.to_json(F.struct(F.col("p.description").alias("rule"), F.col("reply").alias("agent_response")))
    given = rows.select("trace_id", "rule_id", "severity", F.col("p.description").alias("expected"), prompt.alias("prompt"))

    def answers(batches):
        for b in batches:
            try:
                got = list(ask(list(b["prompt"])))
            except Exception:  # a judge that fails has no verdict
                got = [None] * len(b)
            yield b.drop(columns="prompt").assign(answer=got if len(got) == len(b) else [None] * len(b))

    said = given.mapInPandas(answers, "trace_id string, rule_id string, severity string, expected string, answer string")
    found = F.from_json(F.regexp_extract("answer", r"(?s)\{.*\}", 0), "verdict string, reason string")
    verdict = F.lower(F.coalesce(found["verdict"], F.lit("")))
    outcome = F.when(verdict.isin("pass", "fail"), verdict).otherwise("not_applicable")
    why = F.when(F.coalesce(found["reason"], F.lit("")) == "", "judged to fail without a reason").otherwise(found["reason"])
    return said.select("trace_id", "rule_id", "severity", outcome.alias("outcome"), F.when(outcome == "fail", F.col("expected")).alias("expected"), F.when(outcome == "fail", why).alias("observed"))
