"""Mixing sources to target weights: each document is repeated a Poisson number of times.

A source of share w of the target is repeated at the mean rate w * T / size, where size is its
characters and T those of the whole corpus times `scale`. A document's uniform number comes from
the MD5 of a seed, its id and its text, and the inverse Poisson distribution turns it into a count
(rates over MOST are split into equal parts, and the counts of as many numbers summed);
so the result is the same for any partitioning, and a source of any size needs no state but its rate.
The copies are then put in a global random order by a hash, as ranges over all tasks.

The rates are looked up by broadcast while there are at most MAX_SOURCES sources (7 kB each at most), which is counted; with more, documents are
dealt by source and a salt, so a hot source is no single task.

Null source is a source of its own; null or empty text has no characters but is repeated at its
source's rate; a source without characters has rate 0. Rows repeated in full draw the same count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulequarry.llm._scratch import written

SEED = 17
#: The largest rate of one draw; exp(-rate) must not vanish.
MOST = 512.0
MAX_SOURCES, SALTS = 2000, 64
#: The inverse distribution is tabulated up to mean + 12 deviations + 30; beyond that mass is under 1e-12.
_TERMS = "CAST(ceil(part + 12 * sqrt(part) + 30) AS int)"


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1): 52 bits of the MD5 of the parts, a null as an empty string."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, scale: float = 1.0, max_rate: float | None = None) -> DataFrame:
    """(source, size, rate, parts, cdf): the mean repetitions of each source, at most max_rate if given, in how many parts they are drawn, and the cumulative Poisson terms of a part.

    weights: target shares by source, any positive scale, sources left out get 0; none: all sources alike.
    """
    sizes = docs.groupBy("source").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("size"))
    if weights is None:
        weight = F.when(F.col("size") > 0, 1.0).otherwise(0.0)
    else:
        weight = F.lit(float(weights.get(None, 0.0)))
        for k, v in weights.items():
            if k is not None:
                weight = F.when(F.col("source") == k, float(v)).otherwise(weight)
    total = sizes.withColumn("weight", weight)
    sums = total.agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("size") > 0, F.col("weight")).otherwise(0.0)).alias("all_weight"))
    rate = F.lit(scale) * F.col("weight") * F.col("all_size") / (F.col("all_weight") * F.col("size"))
    rate = F.when((F.col("size") > 0) & (F.col("all_weight") > 0), rate if max_rate is None else F.least(F.lit(max_rate), rate)).otherwise(0.0)
    out = total.crossJoin(F.broadcast(sums)).select("source", "size", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST).cast("int")))
    cdf = F.expr(f"""
        aggregate(sequence(1, {_TERMS}),
          named_struct('term', exp(-part), 'cdf', array(exp(-part))),
          (s, k) -> named_struct('term', s.term * part / k, 'cdf', concat(s.cdf, array(element_at(s.cdf, -1) + s.term * part / k))),
          s -> s.cdf)""")
    return out.withColumn("part", F.col("rate") / F.col("parts")).withColumn("cdf", cdf).drop("part")


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, scale: float = 1.0, seed: int = SEED, shuffle: bool = True, columns: list[str] | None = None) -> DataFrame:
    """docs (all columns, or `columns`) with copy (from 1) and order_key, a row for each repetition, in order of order_key if `shuffle`.

    order_key and copy replace columns of these names.
    """
    table = written(rates(docs, weights, scale).select(F.col("source").alias("__source"), F.col("cdf").alias("__cdf"), F.col("parts").alias("__parts")), "rates")
    few = table.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES

    def u(of: Column) -> Column:
        return uniform(of, "doc_id", "__text")

    def count(of: Column) -> Column:
        return F.size(F.filter("__cdf", lambda c: c <= of))

    rows = docs.withColumn("__text", F.md5(F.coalesce("text", F.lit("")))).withColumn("__u", u(F.lit(f"{seed}")))
    same = F.col("source").eqNullSafe(F.col("__source"))
    if few:
        rows = rows.join(F.broadcast(table), same)
    else:
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "__text"), F.lit(SALTS)))
        rows = rows.join(table.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), same & (F.col("__salt") == F.col("__part")))
    others = F.aggregate(F.sequence(F.lit(2), F.col("__parts")), F.lit(0), lambda n, k: n + count(u(F.concat(F.lit(f"{seed}/"), k.cast("string")))))
    rows = rows.withColumn("__n", count(F.col("__u")) + F.when(F.col("__parts") > 1, others).otherwise(0)).filter("__n > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    rows = rows.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"))))
    rows = rows.select(*[c for c in columns or docs.columns if c not in ("copy", "order_key")], "copy", "order_key")
    return rows.orderBy("order_key", "doc_id", "copy") if shuffle else rows


ORACLE = f"""
WITH sizes AS (SELECT source, coalesce(sum(length(text)), 0) AS size FROM documents GROUP BY source),
sums AS (SELECT sum(size) AS all_size, count(*) FILTER (WHERE size > 0) AS k FROM sizes),
rates AS (SELECT source, CASE WHEN size > 0 THEN CAST(all_size AS DOUBLE) / (k * size) ELSE 0.0 END AS rate FROM sizes, sums),
terms AS (
  SELECT source, rate, i, rate + 12 * sqrt(rate) + 30 AS most, exp(-rate) * list_product([rate / j FOR j IN range(1, i + 1)] || [1.0]) AS term
  FROM rates, range(0, 600) r(i) WHERE i <= ceil(rate + 12 * sqrt(rate) + 30)),
cdf AS (SELECT source, i, sum(term) OVER (PARTITION BY source ORDER BY i) AS c FROM terms),
drawn AS (
  SELECT doc_id, source, CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents),
counted AS (SELECT d.doc_id, d.source, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND c <= u) AS n FROM drawn d)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy,
       md5('{SEED}/order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(copy AS VARCHAR)) AS order_key
FROM (SELECT doc_id, source, unnest(range(1, n + 1)) AS copy FROM counted)
"""
