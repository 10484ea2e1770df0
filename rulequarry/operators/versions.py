"""Renamed tools between two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.functions import text as T
from rulequarry.operators.candidates import checkpoint_dir


def renames(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(name) of both sides -> old_name, new_name: closest pairs, each name once, removed names in order.

    Nothing is gathered on the driver; rounds are as many as the longest chain of refusals. Forms of four characters or more count, at distances up to 2 and a quarter of the length.
    """
    checkpoint_dir(removed.sparkSession)
    of = lambda side, name, form: side.select(F.col("name").alias(name), T.canonical_form("name").alias(form)).filter(F.length(form) >= 4).withColumn("k", F.explode(T.deletions(form)))
    near = of(removed, "old_name", "fa").join(of(added, "new_name", "fb"), "k").drop("k").distinct().withColumn("d", T.levenshtein_bounded("fa", "fb", 2))
    near = near.filter("d <= least(2, greatest(1, length(fa) DIV 4))").select("old_name", "new_name", "d")
    left = near.checkpoint()
    while True:
        # every removed name asks the nearest that it may still ask; an added name keeps the first in order of those that ask it.
        # all added names prefer alike, so this ends with what serving the removed names in order would give
        asked = left.groupBy("old_name").agg(F.min(F.struct("d", "new_name")).alias("best")).select("old_name", F.col("best.new_name").alias("new_name"))
        taken = asked.groupBy("new_name").agg(F.min("old_name").alias("old_name"))
        refused = asked.join(taken, ["old_name", "new_name"], "left_anti").checkpoint()
        if refused.isEmpty():
            return taken.select("old_name", "new_name")
        left = left.join(refused, ["old_name", "new_name"], "left_anti").checkpoint()
