"""Settings of mining and retention, read from the session's configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "spark.rulequarry."


@dataclass(frozen=True)
class Settings:
    """Each may be set as spark.rulequarry.<name>; a value out of range is an error."""

    mining_batch_size: int = 75
    mining_min_support: float = 0.6
    confidence_reject_threshold: float = 0.6
    confidence_review_threshold: float = 0.8
    hot_retention_days: int = 30
    warm_retention_days: int = 90

    def __post_init__(self):
        if not 10 <= self.mining_batch_size <= 200:
            raise ValueError("mining_batch_size must lie between 10 and 200")
        for name in ("mining_min_support", "confidence_reject_threshold", "confidence_review_threshold"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie between 0 and 1")


def settings(spark: SparkSession) -> Settings:
    given = {f.name: spark.conf.get(PREFIX + f.name, None) for f in fields(Settings)}
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    return Settings(**{k: kinds[k](v) for k, v in given.items() if v is not None})
