"""Tokens, samples, and payloads cut, compacted and redacted."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulequarry.functions import payload
from rulequarry.operators import features
from rulequarry.plans.registry import query
from rulequarry.sources.views import EVENTS, event_traces, table


@query(r"""WITH raw AS (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '\s+'))) AS raw FROM documents)
SELECT doc_id, token FROM (SELECT doc_id, regexp_replace(raw, '[^a-z0-9_]', '', 'g') AS token FROM raw) WHERE token <> '' GROUP BY ALL""")
def user_tokens_verification(spark, sf_dir):
    """Distinct tokens of whole texts, split at white space."""
    raw = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("raw"))
    return raw.select("doc_id", F.regexp_replace("raw", "[^a-z0-9_]", "").alias("token")).filter("token <> ''").distinct()


@query(f"""WITH {EVENTS}, r AS (SELECT trace_id, segment <> 'JP' AS known, ('0x' || substr(sha1(trace_id), 1, 8))::BIGINT / CAST(4294967295 AS DOUBLE) < CAST(0.25 AS DOUBLE) AS drawn,
  list_contains(statuses, 'error') AS bad, list_max(latencies) >= 1000 AS slow FROM tr)
SELECT trace_id, true AS none, bad OR drawn AS rate, bad OR drawn AS tail_on_error, bad OR slow OR known OR drawn AS adaptive, slow OR known OR drawn AS adaptive_errors_too FROM r""")
def sample_traces(spark, sf_dir):
    """Which traces each mode of sampling keeps; one segment counts as unknown."""
    rows = event_traces(spark, sf_dir).withColumn("segment", F.nullif("segment", F.lit("JP")))
    modes = [features.sampled(mode, 0.25).alias(mode) for mode in features.SAMPLING]
    return rows.select("trace_id", *modes, features.sampled("adaptive", 0.25, keep_errors=False).alias("adaptive_errors_too"))


_CUT = "CASE WHEN length(text) > {0} THEN substr(text, 1, {0}) || '…' ELSE text END"


@query(f"""SELECT conv_id, turn, {_CUT.format(1000)} AS text, {_CUT.format(1000)} AS deep, least(25, length(text)) AS n_items, CAST(turn AS VARCHAR) AS number, {_CUT.format(2000)} AS long_text, least(50, length(text)) AS n_long FROM conversations""")
def value_truncation(spark, sf_dir):
    """Payloads of turns with texts cut and lists shortened at every depth, by the limits of calls and those of decorators."""
    items = F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.struct(i.alias("i")))
    given = F.to_json(F.struct("turn", "text", items.alias("items"), F.array(F.struct(F.array("text").alias("inner"))).alias("list")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", payload.truncated(given, 1000, 25).alias("p"), payload.truncated(given, 2000, 50).alias("q"))
    at = F.get_json_object
    n = lambda c: F.size(F.from_json(at(c, "$.items"), "array<struct<i: int>>")).cast("long")
    return rows.select("conv_id", "turn", at("p", "$.text").alias("text"), at("p", "$.list[0].inner[0]").alias("deep"), n("p").alias("n_items"), at("p", "$.turn").alias("number"), at("q", "$.text").alias("long_text"), n("q").alias("n_long"))


@query(f"""SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user_input' WHEN 'assistant' THEN 'agent_response' ELSE 'system' END AS kind, {_CUT.format(240)} AS content,
  CASE WHEN turn % 2 = 0 THEN 2 ELSE 3 END AS n_keys, count(*) OVER (PARTITION BY conv_id) AS n_steps FROM conversations""")
def step_compaction(spark, sf_dir):
    """Steps of conversations as they are put to a model: type and five keys, absent ones left out, texts cut at 240 characters."""
    kind = F.when(F.col("role") == "user", "user_input").when(F.col("role") == "assistant", "agent_response").otherwise("system")
    step = F.struct("turn", kind.alias("type"), F.col("text").alias("content"), F.when(F.col("turn") % 2 == 1, F.col("turn")).cast("int").alias("latency_ms"), F.lit(None).cast("string").alias("tool"), F.lit("x").alias("secret"))
    traces = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    compact = F.from_json(payload.compact_steps("steps", ("content", "latency_ms", "tool")), "array<string>")
    rows = traces.select("conv_id", F.transform("steps", lambda s: s["turn"]).alias("turns"), compact.alias("compact"))
    rows = rows.select("conv_id", F.size("compact").cast("long").alias("n_steps"), F.explode(F.arrays_zip("turns", "compact")).alias("s"))
    at = F.get_json_object
    return rows.select("conv_id", F.col("s.turns").alias("turn"), at("s.compact", "$.type").alias("kind"), at("s.compact", "$.content").alias("content"), F.size(F.json_object_keys("s.compact")).alias("n_keys"), "n_steps")


@query("""SELECT event_id, '{"user": {"' || CASE WHEN event_id % 2 = 0 THEN 'Password": "[redacted:blocked_field]"' ELSE 'note": ' || props END || ', "id": ' || event_id || '}, "' ||
  CASE WHEN event_id % 3 = 0 THEN 'credentials": "[redacted:blocked_field]"' ELSE 'tokens": ["a", {"Bearer_Token" : "[redacted:blocked_field]"}]' END || '}' AS value FROM events""")
def redact_fields(spark, sf_dir):
    """Values of blocked keys replaced, by key name, at any depth; here up to seven levels."""
    deep = "'credentials\": {\"x\": [1, {\"a\": {\"b\": {\"c\": {\"d\": \"}SECRET{\"}}}}]}'"
    user = F.expr(f"""concat('{{"user": {{"', IF(event_id % 2 = 0, concat('Password": "a, \\\\"b\\\\" ', event_id, '"'), concat('note": ', props)), ', "id": ', event_id, '}}, "',
        IF(event_id % 3 = 0, {deep}, 'tokens": ["a", {{"Bearer_Token" : {{"k": [[["SECRET"]]]}}}}]'), '}}')""")
    return table(spark, sf_dir, "events").select("event_id", payload.redacted(user).alias("value"))
