"""Packs of ready-made rules: files, a catalogue, and rows to install."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulequarry.schema import PARAMS, params_valid

_RULE = f"struct<type: string, description: string, formal_rule: string, severity: string, params: {PARAMS}, rationale: string, regulatory_refs: array<string>>"
PACK = f"pack_id string, title string, description string, version string, targets array<string>, regulatory_frameworks array<string>, invariants array<{_RULE}>"
#: Scores of a rule that comes from a pack and has not met traces yet.
SCORES = {"confidence": 0.65, "support": 0.7, "consistency": 0.7, "cross_validation": 0.0, "clarity": 0.85}


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each rule of the JSON pack files of a folder. Files that aren't packs are skipped, and so are rules without
    a type, a description or valid parameters; a missing version is 0.1.0, a missing severity medium, a missing title the pack's id."""
    raw = spark.read.schema(PACK).option("multiLine", True).option("mode", "PERMISSIVE").json(path).filter("pack_id IS NOT NULL")
    title = F.coalesce("title", F.initcap("pack_id"))
    rows = raw.select("pack_id", title.alias("title"), F.coalesce("version", F.lit("0.1.0")).alias("version"), F.posexplode("invariants").alias("number", "r"))
    rows = rows.select("pack_id", "title", "version", "number", "r.*").withColumn("severity", F.coalesce("severity", F.lit("medium")))
    return rows.filter(params_valid() & F.col("description").isNotNull())


def pack_catalog(rules: DataFrame) -> DataFrame:
    """pack_id, title, version, n_rules and the kinds of rules."""
    return rules.groupBy("pack_id", "title", "version").agg(F.count("*").alias("n_rules"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))


def install(rules: DataFrame) -> DataFrame:
    """Rules (pack_id, version, type, description, formal_rule, severity, params) -> pending rules with fixed scores and where they come from.

    The id follows from the pack, the kind and the parameters, so that installing a pack again gives the same rows.
    """
    rule_id = F.concat(F.lit("pack-"), F.substring(F.sha2(F.concat_ws("\n", "pack_id", "version", "type", "description", F.to_json("params")), 256), 1, 8))
    formal = F.coalesce(F.nullif("formal_rule", F.lit("")), F.format_string("pack(%s).%s", "pack_id", "type"))
    return rules.filter(params_valid()).select(
        rule_id.alias("rule_id"), "type", "description", formal.alias("formal_rule"), "severity", "params", F.col("pack_id"), F.col("version").alias("pack_version"),
        *[F.lit(v).alias(k) for k, v in SCORES.items()], F.lit("pending").alias("status"), F.lit("pack").alias("discovered_by"), F.lit(0).alias("evidence_count"),
    )
