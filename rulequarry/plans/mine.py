"""All miners in one call: candidates of every kind, scored, sorted out and ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.operators import candidates
from rulequarry.plans import mining, patterns
from rulequarry.plans.registry import ORACLES, query
from rulequarry.plans.scoring import clarity_sql
from rulequarry.schema import PARAMS

_D = "CAST({} AS DOUBLE)"
_ALL = f"""WITH found AS (
  SELECT 'ordering' AS type, 'The agent always calls `' || tool_a || '` before calling `' || tool_b || '`' AS description, round(support, 4) AS support, round(consistency, 4) AS consistency, severity FROM ({ORACLES['mine_ordering']}) WHERE kept
  UNION ALL SELECT 'ordering', description, support, support, 'medium' FROM ({ORACLES['mine_chains']})
  UNION ALL SELECT 'statistical', 'Latency of `' || tool || '` stays under ' || CAST(threshold AS VARCHAR) || ' ms', {_D.format(1)}, round(within_rate, 4), 'low' FROM ({ORACLES['latency_p99']})
  UNION ALL SELECT 'statistical', '`' || tool || '` succeeds in 95% of its calls or more', {_D.format(1)}, round(rate, 4), 'medium' FROM ({ORACLES['success_rate']}) WHERE kept
  UNION ALL SELECT 'statistical', 'The feature `' || feature || '` stays within its usual range', {_D.format(1)}, round(within_rate, 4), 'low' FROM ({ORACLES['feature_envelope']})
  UNION ALL SELECT 'negative', 'The agent calls only these tools: `' || string_agg(tool, ', ' ORDER BY tool) || '`', {_D.format(1)}, {_D.format(1)}, 'high' FROM ({ORACLES['mine_repertoire']}) WHERE allowed HAVING count(*) > 0
  UNION ALL SELECT 'conditional', 'The agent calls `' || tool || '` when the input mentions `' || keyword || '`', round(lift, 4), round(lift, 4), 'medium' FROM ({ORACLES['mine_conditional']})),
s AS (SELECT *, CAST(round(CAST({_D.format(0.4)} * support + {_D.format(0.3)} * consistency + {_D.format(0.1)} * {clarity_sql('description')} AS DECIMAL(18, 9)), 4) AS DOUBLE) AS confidence FROM found)"""


def union_of_miners(spark, sf_dir, chains=patterns.mine_chains) -> DataFrame:
    """type, description, support, consistency, severity, params, evidence, track of every candidate that the miners keep.

    chains: patterns.mine_chains for chains of three tools, as the statements here have them, or patterns.all_chains.
    """
    said = lambda *parts: F.concat(*[F.lit(p) if k % 2 == 0 else F.col(p).cast("string") for k, p in enumerate(parts)])
    one = F.lit(1.0)

    fields = [x.split(": ") for x in PARAMS[len("struct<") : -1].split(", ")]

    def rule(rows, kind, text, support, consistency, severity, **params):
        rounded = lambda c: F.round(c if not isinstance(c, str) else F.col(c), 4)
        made = F.struct(*[params.get(name, F.lit(None)).cast(t).alias(name) for name, t in fields])
        return rows.select(F.lit(kind).alias("type"), text.alias("description"), rounded(support).alias("support"), rounded(consistency).alias("consistency"), severity.alias("severity"), made.alias("params"))

    col, chain = F.col, F.split("pattern", ">")
    tools = mining.mine_repertoire(spark, sf_dir).filter("allowed").agg(F.array_join(F.sort_array(F.collect_list("tool")), ", ").alias("tools"), F.count("*").alias("n")).filter("n > 0")
    found = [
        rule(patterns.mine_ordering(spark, sf_dir).filter("kept"), "ordering", said("The agent always calls `", "tool_a", "` before calling `", "tool_b", "`"), "support", "consistency", F.col("severity"), tool_a=col("tool_a"), tool_b=col("tool_b")),
        rule(chains(spark, sf_dir), "ordering", F.col("description"), "support", "support", F.lit("medium"), tool_a=chain[0], tool_b=F.element_at(chain, -1), chain=chain),
        rule(mining.latency_p99(spark, sf_dir), "statistical", said("Latency of `", "tool", "` stays under ", "threshold", " ms"), one, "within_rate", F.lit("low"), metric=F.lit("latency_ms"), tool=col("tool"), threshold=col("threshold")),
        rule(mining.success_rate(spark, sf_dir).filter("kept"), "statistical", said("`", "tool", "` succeeds in 95% of its calls or more"), one, "rate", F.lit("medium"), metric=F.lit("success_rate"), tool=col("tool"), rate=col("rate")),
        rule(mining.feature_envelope(spark, sf_dir), "statistical", said("The feature `", "feature", "` stays within its usual range"), one, "within_rate", F.lit("low"), metric=F.lit("feature_envelope"), feature=col("feature"), p1=col("p1"), p99=col("p99")),
        rule(tools, "negative", said("The agent calls only these tools: `", "tools", "`"), one, one, F.lit("high"), allowed_repertoire=F.split("tools", ", ")),
        rule(mining.mine_conditional(spark, sf_dir), "conditional", said("The agent calls `", "tool", "` when the input mentions `", "keyword", "`"), "lift", "lift", F.lit("medium"), keyword=col("keyword"), tool=col("tool")),
    ]
    return reduce(DataFrame.unionByName, found).withColumns({"track": F.lit("statistical"), "evidence": F.array().cast("array<string>")})


@query(f"{_ALL} SELECT type, description, support, consistency, severity, confidence, CASE WHEN confidence < 0.8 THEN 'pending' ELSE 'active' END AS status FROM s WHERE confidence >= 0.6 ORDER BY confidence DESC, description")
def mine_all(spark, sf_dir):
    """Candidates of all miners that aren't rejected, the most certain first."""
    rows = candidates.scored(union_of_miners(spark, sf_dir)).filter("status <> 'rejected'")
    return rows.select("type", "description", "support", "consistency", "severity", "confidence", "status").orderBy(F.desc("confidence"), "description")


@query(f"{_ALL} SELECT type, count(*) AS n, round(avg(support), 6) AS support FROM s GROUP BY type")
def miner_counts(spark, sf_dir):
    """How many candidates each kind of miner gives before any is rejected."""
    return union_of_miners(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("support"), 6).alias("support"))
