"""A store of rules in the shape of a plain table: each part is a rule of some type, and the same as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulequarry.schema import PARAMS, SEVERITY, TYPES
from rulequarry.sources.views import table

STATUSES = ("pending", "active", "rejected")


def stored_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule_id, type, description, severity, status, confidence, formal_rule, params; some parameters are incomplete or out of range."""
    pick = lambda values, of: F.element_at(F.array(*[F.lit(v) for v in values]), (of + 1).cast("int"))
    rows = table(spark, sf_dir, "part").withColumns(
        {"k": F.col("p_partkey"), "adj": F.split("p_name", " ")[0], "noun": F.split("p_name", " ")[1], "type": pick(TYPES, F.col("p_partkey") % 8), "kind": F.floor(F.col("p_partkey") / 8) % 3}
    )
    text = F.when(F.col("k") % 5 == 0, F.concat("p_name", F.lit(': "a" or \'b\''))).when(F.col("k") % 11 == 0, F.repeat(F.concat("p_name", F.lit(" ")), 20)).otherwise(F.concat(F.lit("Rule on `"), "adj", F.lit("` and `"), "noun", F.lit("`")))
    rows = rows.withColumn("description", text)
    of = lambda kind, value: F.when(F.col("type") == kind, F.expr(value))
    given = {
        "tool_a": of("ordering", "IF(k % 24 = 0, concat('9 ', adj), adj)"),
        "tool_b": of("ordering", "noun"),
        "keyword": of("conditional", "adj"),
        "tool": F.when(F.col("type") == "conditional", F.col("noun")).when((F.col("type") == "statistical") & (F.col("kind") < 2), F.col("noun")),
        "forbidden_patterns": of("negative", "IF(k % 16 = 2, IF(k % 48 = 2, array(adj), CAST(NULL AS array<string>)), array(noun, adj))"),
        "allowed_repertoire": of("negative", "IF(k % 16 = 2, array(adj, noun), CAST(NULL AS array<string>))"),
        "category": of("negative", "lower(p_type)"),
        "metric": of("statistical", "element_at(array('latency_ms', 'success_rate', 'feature_envelope'), CAST(kind + 1 AS int))"),
        "feature": of("statistical", "IF(kind = 2, 'tool_count', NULL)"),
        "threshold": of("statistical", "IF(kind = 0, p_size * 10D, NULL)"),
        "rate": of("statistical", "IF(kind = 1, p_size / 40D, NULL)"),
        "p1": of("statistical", "IF(kind = 2, 5D, NULL)"),
        "p99": of("statistical", "IF(kind = 2, CAST(p_size AS double), NULL)"),
        "terminator_tool": of("state", "noun"),
        "forbidden_after": of("state", "IF(k % 40 = 4, CAST(array() AS array<string>), array(adj))"),
        "upstream_tool": of("composition", "adj"),
        "downstream_tool": of("composition", "noun"),
        "segment": of("tool_selection", "p_type"),
        "expected_tool": of("tool_selection", "noun"),
        "forbidden_tool": of("tool_selection", "IF(k % 16 = 6, adj, NULL)"),
        "rubric": of("output_format", "description"),
    }
    fields = [x.split(": ") for x in PARAMS[len("struct<") : -1].split(", ")]
    params = F.struct(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])
    return rows.select(
        F.concat(F.lit("p"), F.col("k").cast("string")).alias("rule_id"), "type", "description", pick(tuple(SEVERITY), F.col("p_size") % 4).alias("severity"), pick(STATUSES, F.col("k") % 3).alias("status"),
        ((F.col("p_size") * 7 % 100) / 100.0).alias("confidence"), F.when(F.col("k") % 4 == 0, "  ").otherwise(F.concat(F.lit(" rule_"), F.col("k").cast("string"))).alias("formal_rule"), params.alias("params"),
    )


#: The same rules, parameters as plain columns.
STORED = """
sr AS (
  SELECT 'p' || p_partkey AS rule_id, k, adj, noun, kind, p_size, p_type, type, severity, status, CAST((p_size * 7) % 100 AS DOUBLE) / 100 AS confidence,
    CASE WHEN k % 4 = 0 THEN '  ' ELSE ' rule_' || k END AS formal_rule,
    CASE WHEN k % 5 = 0 THEN p_name || ': "a" or ''b''' WHEN k % 11 = 0 THEN repeat(p_name || ' ', 20) ELSE 'Rule on `' || adj || '` and `' || noun || '`' END AS description,
    CASE WHEN k % 24 = 0 THEN '9 ' || adj ELSE adj END AS tool_a,
    CASE WHEN k % 16 = 2 THEN CASE WHEN k % 48 = 2 THEN [adj] END ELSE [noun, adj] END AS patterns, k % 16 = 2 AS listed
  FROM (SELECT *, p_partkey AS k, string_split(p_name, ' ')[1] AS adj, string_split(p_name, ' ')[2] AS noun, (p_partkey // 8) % 3 AS kind,
          (['ordering', 'conditional', 'negative', 'statistical', 'state', 'composition', 'tool_selection', 'output_format'])[p_partkey % 8 + 1] AS type,
          (['low', 'medium', 'high', 'critical'])[p_size % 4 + 1] AS severity, (['pending', 'active', 'rejected'])[p_partkey % 3 + 1] AS status FROM part)),
valid AS (
  SELECT *, CASE type WHEN 'ordering' THEN k % 24 <> 0 WHEN 'negative' THEN NOT (listed AND k % 48 = 2) WHEN 'state' THEN k % 40 <> 4
    WHEN 'statistical' THEN CASE kind WHEN 1 THEN p_size <= 40 WHEN 2 THEN p_size >= 5 ELSE true END ELSE true END AS ok FROM sr)
"""
