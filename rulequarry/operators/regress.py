"""Summaries of checks, comparison of two sets of traces, verdicts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulequarry.schema import SEVERITY, severity_rank

MIN_APPLICABLE, DROP = 3, 0.10


def batch_summary(results: DataFrame, keys: tuple[str, ...] = ("rule_id",)) -> DataFrame:
    """Counts and rates by rule; one shuffle of partial counts."""
    n = lambda o: F.sum(F.when(F.col("outcome") == o, 1).otherwise(0)).cast("long")
    out = results.groupBy(*keys).agg(n("pass").alias("passed"), n("fail").alias("failed"), n("warn").alias("warned"))
    applicable = F.col("passed") + F.col("failed") + F.col("warned")
    least = F.greatest(applicable, F.lit(1))
    return out.withColumn("applicable", applicable).withColumns({f"{a}_rate": F.bround(F.col(b) / least, 4) for a, b in (("pass", "passed"), ("fail", "failed"), ("warn", "warned"))})


def first_failing(results: DataFrame, n: int = 5) -> DataFrame:
    """The first n failing or warned traces of each rule, by trace_id, in bounded state."""
    bad = results.filter("outcome IN ('fail', 'warn')").select("rule_id", "trace_id")
    ranked = bad.withColumn("k", F.row_number().over(Window.partitionBy("rule_id").orderBy("trace_id"))).filter(F.col("k") <= n)
    return ranked.groupBy("rule_id").agg(F.array_join(F.sort_array(F.collect_list("trace_id")), ",").alias("samples"))


def compare(summary: DataFrame, rules: DataFrame, baseline: str = "v1", candidate: str = "v2", by: str = "version") -> DataFrame:
    """Rule by rule: rates of both sides and the verdict."""

    def side(value: str, prefix: str) -> DataFrame:
        return summary.filter(F.col(by) == value).select("rule_id", *[F.col(c).alias(f"{prefix}_{c}") for c in ("applicable", "passed", "failed", "warned", "pass_rate", "fail_rate", "warn_rate")])

    both = rules.select("rule_id", "severity").join(side(baseline, "b"), "rule_id", "left").join(side(candidate, "c"), "rule_id", "left").na.fill(0)
    verdict = (
        F.when(F.col("c_applicable") < MIN_APPLICABLE, "pass")
        .when((F.col("c_fail_rate") > F.col("b_fail_rate")) & (F.col("c_pass_rate") <= F.col("b_pass_rate") - DROP), "fail")
        .when(F.col("c_warn_rate") >= F.col("b_warn_rate") + DROP, "warn")
        .otherwise("pass")
    )
    return both.withColumn("verdict", verdict)


def exit_code(compared: DataFrame, fail_on: str = "any") -> DataFrame:
    """1 if a verdict is bad enough: never, warn, any, high or critical."""
    bad = {
        "never": F.lit(False),
        "warn": F.col("verdict").isin("fail", "warn"),
        "any": F.col("verdict") == "fail",
        "high": (F.col("verdict") == "fail") & (severity_rank("severity") >= SEVERITY["high"]),
        "critical": (F.col("verdict") == "fail") & (severity_rank("severity") >= SEVERITY["critical"]),
    }[fail_on]
    return compared.agg(F.coalesce(F.max(F.when(bad, 1).otherwise(0)), F.lit(0)).alias("exit_code"))
