"""Trace and rule stores on Parquet: scans, partitioned sinks, upserts and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulequarry.schema import RULE, TRACE


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """A file, or files, holding JSON arrays of traces; what doesn't fit the schema is in _corrupt_record."""
    return spark.read.schema(TRACE + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of JSON files; a missing id comes from other id fields, a missing severity is medium."""
    raw = spark.read.schema(RULE + ", invariant_id string, id string").option("multiLine", True).json(path)
    made = F.coalesce("rule_id", "invariant_id", "id", F.substring(F.sha2(F.concat_ws(":", "type", "description", F.to_json("params")), 256), 1, 32))
    return raw.select(made.alias("rule_id"), "type", "description", F.coalesce("severity", F.lit("medium")).alias("severity"), "params")


def write_traces(traces: DataFrame, path: str, mode: str = "append") -> None:
    """By version and day, so scans of a period or a version prune folders."""
    traces.withColumn("dt", F.to_date("started_at")).write.mode(mode).partitionBy("version", "dt").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with rows of equal keys replaced by those of new, others added; action tells which."""
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("a"))
    b = new.select(*keys, F.struct(*rest).alias("b"))
    action = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "keep").otherwise("update")
    return a.join(b, keys, "full").select(*keys, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in rest], action.alias("action"))


def replace_where(old: DataFrame, new: DataFrame, condition: Column) -> DataFrame:
    return old.filter(~condition).unionByName(new)


def retention(traces: DataFrame, now: str, compress_days: int = 30, drop_days: int = 90) -> DataFrame:
    """tier hot, cold or drop by age; a filter on the partition column prunes what is dropped."""
    age = F.date_diff(F.to_date(F.lit(now)), F.to_date("started_at"))
    return traces.withColumn("tier", F.when(age > drop_days, "drop").when(age > compress_days, "cold").otherwise("hot"))

