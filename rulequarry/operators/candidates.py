"""Rule candidates: text vectors, similarity, clusters, merging, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from rulequarry.functions.text import clarity, dedup_key
from rulequarry.schema import params_valid

REJECT, REVIEW = 0.6, 0.8


def scored(rows: DataFrame) -> DataFrame:
    """Adds clarity, confidence and status to support, consistency, track and description."""
    both = F.when(F.col("track") == "both", 0.2).otherwise(0.0)
    exact = F.round(F.lit(0.4) * F.col("support") + F.lit(0.3) * F.col("consistency") + both + F.lit(0.1) * clarity("description"), 9)
    value = F.round(exact, 4)  # what is halfway is so in nine digits, whatever the sum in doubles ends in
    out = rows.withColumn("clarity", clarity("description")).withColumn("confidence", value)
    return out.withColumn("status", F.when(F.col("confidence") < REJECT, "rejected").when(F.col("confidence") < REVIEW, "pending").otherwise("active"))


#: Fixed words that tell nothing in a rule's description.
STOP = (
    "the", "a", "an", "is", "are", "always", "never", "before", "after", "agent", "trace", "must", "this", "that", "with", "and", "or", "of",
    "to", "for", "from", "has", "have", "be", "been", "if", "when", "then", "as", "at", "by", "on", "in", "it", "its", "into",
)
#: Pairs of words count from this mean number of words of a type's descriptions on; the weight of character trigrams.
BIGRAMS_FROM, TRIGRAM_WEIGHT = 8, 0.4
#: Fixed names of parameters that must agree where two candidates both have them.
SHARED_KEYS = ("tool_a", "tool_b", "tool", "keyword", "metric", "terminator_tool", "upstream_tool", "downstream_tool", "expected_tool", "segment", "feature")
MAX_EVIDENCE = 100


def tfidf(rows: DataFrame) -> DataFrame:
    """(item_id, type, description) -> (item_id, type, term, w): unit vectors within each type, of words, pairs of words and trigrams of words."""
    stop = ", ".join(f"'{w}'" for w in STOP)
    given = rows.select("item_id", "type", F.expr(f"filter(regexp_extract_all(lower(description), '[a-z][a-z0-9_]+', 0), t -> t NOT IN ({stop}))").alias("words"))
    of_type = given.groupBy("type").agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    terms = F.expr(f"""concat(words,
        IF(mean >= {BIGRAMS_FROM} AND size(words) > 1, transform(sequence(1, size(words) - 1), i -> concat('__bi__', words[i - 1], '_', words[i])), array()),
        flatten(transform(words, t -> IF(length(t) > 2, transform(sequence(1, length(t) - 2), i -> concat('__ch__', substring(t, i, 3))), array()))))""")
    terms = given.join(F.broadcast(of_type), "type").withColumn("terms", terms).select("item_id", "type", "n", F.size("terms").alias("len"), F.explode("terms").alias("term"))
    tf = terms.groupBy("item_id", "type", "n", "len", "term").agg(F.count("*").alias("c"))
    df = tf.groupBy("type", "term").agg(F.count("*").alias("df"))
    weight = F.expr(f"CAST(c AS double) / len * (ln((1 + n) / CAST(1 + df AS double)) + 1) * IF(startswith(term, '__ch__'), {TRIGRAM_WEIGHT}D, 1D)")
    w = tf.join(df, ["type", "term"]).withColumn("w", weight)
    return w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("item_id")))).select("item_id", "type", "term", "w")


def similarity(vectors: DataFrame) -> DataFrame:
    """Cosines of candidates of one type that share a term."""
    a = vectors.select(F.col("item_id").alias("a"), "type", "term", F.col("w").alias("wa"))
    b = vectors.select(F.col("item_id").alias("b"), "type", "term", F.col("w").alias("wb"))
    return a.join(b, ["type", "term"]).filter("a < b").groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("cosine"))


def checkpoint_dir(spark) -> None:
    """The folder that the session names must be shared; only where all tasks run in one process is one made if it is unset."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        import tempfile

        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rulequarry-"))


def label_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id), (a, b) -> id, cluster: the least id that each reaches; lineage is cut each round in the checkpoint folder."""
    checkpoint_dir(nodes.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    now = nodes.select("id", F.col("id").alias("cluster")).checkpoint()
    while True:
        least = both.join(now.select(F.col("id").alias("b"), "cluster"), "b").groupBy("a").agg(F.min("cluster").alias("m"))
        near = now.join(least, now["id"] == least["a"], "left").select("id", F.col("cluster").alias("old"), F.least("cluster", F.coalesce("m", "cluster")).alias("cluster"))
        jump = near.select(F.col("id").alias("cluster"), F.col("cluster").alias("root"))
        after = near.join(jump, "cluster").select("id", "old", F.col("root").alias("cluster")).checkpoint()
        now = after.select("id", "cluster")
        if after.filter("cluster <> old").isEmpty():
            return now


def _param(rows: DataFrame, key: str) -> Column:
    """A parameter of the column params, a map or a struct, as text."""
    kind = rows.schema["params"].dataType
    if kind.typeName() == "map":
        return F.try_element_at("params", F.lit(key))
    return F.col(f"params.{key}") if key in kind.names else F.lit(None).cast("string")


def clusters(rows: DataFrame, pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """(item_id), (a, b, cosine) -> item_id, cluster: candidates that are close, and what these lead to."""
    near = pairs.filter(F.col("cosine") >= least)
    return label_components(rows.select(F.col("item_id").alias("id")), near.select("a", "b")).withColumnRenamed("id", "item_id")


def agreeing(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(item_id, params), (item_id, cluster) -> item_id, cluster: a cluster in which two members have different values of one of SHARED_KEYS falls apart.

    Every pair of a cluster agrees if no key has two values in it, so this is one aggregate by cluster, without pairs.
    """
    joined = rows.select("item_id", *[_param(rows, k).alias(k) for k in SHARED_KEYS]).join(found, "item_id")
    unlike = reduce(lambda a, b: a | b, [F.coalesce(F.min(k) < F.max(k), F.lit(False)) for k in SHARED_KEYS])
    apart = joined.groupBy("cluster").agg(unlike.alias("apart"))
    return found.join(apart, "cluster").select("item_id", F.when(F.col("apart"), F.col("item_id")).otherwise(F.col("cluster")).alias("cluster"))


def merged(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """One candidate for each cluster: the longest description with its type and severity, the best support and consistency, all
    parameters (each from the last candidate that has it), and the first MAX_EVIDENCE of all evidence in order of the candidates, without repeats.

    rows: item_id, description, support, consistency, track, evidence and, if there are, type, severity and params (a struct).
    """
    rows = rows.join(clusters, "item_id")
    own = [c for c in ("type", "severity") if c in rows.columns]
    base = F.min_by(F.struct("description", *own), F.struct((-F.length("description")).alias("n"), "item_id"))
    track = F.when(F.min("track") != F.max("track"), "both").otherwise(F.min("track"))
    aggregates = [base.alias("base"), F.max("support").alias("support"), F.max("consistency").alias("consistency"), F.count("*").alias("n"), track.alias("track")]
    if "params" in rows.columns and rows.schema["params"].dataType.typeName() == "struct":
        last = lambda c: F.max_by(f"params.{c}", F.when(F.col(f"params.{c}").isNotNull(), F.col("item_id"))).alias(c)
        aggregates.append(F.struct(*[last(c) for c in rows.schema["params"].dataType.names]).alias("params"))
    out = rows.groupBy("cluster").agg(*aggregates)
    seen = rows.select("cluster", "item_id", F.posexplode("evidence").alias("k", "trace")).groupBy("cluster", "trace").agg(F.min(F.struct("item_id", "k")).alias("at"))
    first = seen.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("at"))).filter(F.col("r") <= MAX_EVIDENCE)
    first = first.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "trace"))), lambda x: x["trace"]).alias("evidence"))
    none = F.array().cast(rows.schema["evidence"].dataType)
    kept = [c for c in out.columns if c not in ("cluster", "base")]
    return out.join(first, "cluster", "left").select("cluster", "base.*", *kept, F.coalesce("evidence", none).alias("evidence"))


def formalised(rows: DataFrame, reject: float = REJECT, review: float = REVIEW) -> DataFrame:
    """Candidates (with params as schema.PARAMS) that have valid parameters and aren't rejected, the most certain first.

    Adds clarity, confidence, status, cross_val_bonus (a fifth if both tracks found it), evidence_count (as it came) and formal_rule (made of the
    description where it is missing); evidence loses repeats and what is over MAX_EVIDENCE.
    """
    known = rows.filter(params_valid()).withColumns({"cross_val_bonus": F.when(F.col("track") == "both", 0.2).otherwise(0.0), "evidence_count": F.size("evidence"), "evidence": F.slice(F.array_distinct("evidence"), 1, MAX_EVIDENCE)})
    said = F.concat(F.lit("holds(trace, '"), F.substring(F.trim("description"), 1, 120), F.lit("')"))
    formal = F.expr("nullif(trim(formal_rule), '')") if "formal_rule" in rows.columns else F.lit(None).cast("string")
    known = scored(known.withColumn("formal_rule", F.coalesce(formal, said)))
    status = F.when(F.col("confidence") < reject, "rejected").when(F.col("confidence") < review, "pending").otherwise("active")
    return known.withColumns({"description": F.trim("description"), "status": status}).filter("status <> 'rejected'").orderBy(F.desc("confidence"), "description")


def deduplicated(rows: DataFrame, order: str = "item_id", most: int = 50) -> DataFrame:
    """One candidate for each type and normalised description, as batches of suggestions repeat themselves: the first, with support and
    consistency averaged with each further one in turn, to four places, and the first `most` of all evidence.

    A group's array holds its numbers only. Evidence is reduced to where each trace comes first before it is shuffled; whole numbers as
    the order keep that a plain aggregate by hash.
    """
    own = [c for c in ("severity", "params") if c in rows.columns]
    keyed = rows.withColumn("key", dedup_key("description")).withColumn("__o", F.col(order))
    every = F.sort_array(F.collect_list(F.struct("__o", "support", "consistency")))
    first = F.min_by(F.struct("description", *own), "__o")
    grouped = keyed.groupBy("type", "key").agg(first.alias("first"), every.alias("a"), F.count("*").alias("n"), F.max(F.col("evidence").isNull()).alias("gap"))

    def running(c: str) -> Column:
        return F.aggregate(F.slice("a", 2, F.size("a")), F.col("a")[0][c], lambda m, x: F.round(F.round((m + x[c]) / 2, 9), 4)).alias(c)  # what is halfway is so in nine digits

    # what is behind a row's own first `most` traces is never among the first of a group
    some = keyed.withColumn("some", F.slice(F.array_distinct("evidence"), 1, most))
    if isinstance(rows.schema[order].dataType, IntegralType):
        at = F.col("__o").cast("decimal(20, 0)") * most + F.col("k")
    else:
        some = some.withColumn("__o", F.struct("__o", "support", "consistency", F.get("evidence", F.lit(0)), F.xxhash64("evidence")))
        at = F.struct("__o", "k")
    seen = some.select("type", "key", "__o", F.posexplode_outer("some").alias("k", "trace")).filter("k IS NOT NULL").groupBy("type", "key", "trace").agg(F.min(at).alias("at"))
    kept = seen.withColumn("r", F.row_number().over(Window.partitionBy("type", "key").orderBy("at", "trace"))).filter(F.col("r") <= most)
    kept = kept.groupBy(F.col("type").alias("__type"), F.col("key").alias("__key")).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "trace"))), lambda x: x["trace"]).alias("found"))
    out = grouped.join(kept, F.col("type").eqNullSafe(F.col("__type")) & F.col("key").eqNullSafe(F.col("__key")), "left")
    evidence = F.when(~F.col("gap"), F.coalesce("found", F.array().cast(rows.schema["evidence"].dataType)))
    return out.select("type", "key", "first.*", running("support"), running("consistency"), evidence.alias("evidence"), "n")


def two_tracks(statistical: DataFrame, suggested: DataFrame) -> DataFrame:
    """Candidates of both tracks (type, description, support, consistency, severity, params, evidence) -> those that stay, as formalised() gives them.

    Suggestions lose repeats; close candidates of one type whose parameters all agree become one, which counts as found by both tracks if it
    was; what disagrees stays as it came. An empty second track leaves the first as it is.
    """
    columns = ["type", "description", "support", "consistency", "severity", "params", "evidence"]
    once = deduplicated(suggested.withColumn("item_id", F.struct("description", "severity")))
    rows = statistical.select(*columns, F.lit("statistical").alias("track")).unionByName(once.select(*columns, F.lit("suggested").alias("track")))
    first = F.when(F.col("track") == "statistical", "0").otherwise("1")
    checkpoint_dir(statistical.sparkSession)
    # the miners run once, not once for each use of their candidates
    rows = rows.withColumn("item_id", F.concat_ws("|", first, "type", "description")).checkpoint()
    vectors = tfidf(rows).checkpoint()
    return formalised(merged(rows, agreeing(rows, clusters(rows, similarity(vectors)))))
