"""Names that mean the same tool: pairs, clusters and the decision for each name."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.functions import text as T
from rulequarry.functions.names import close, forest
from rulequarry.operators.candidates import checkpoint_dir, label_components

JACCARD, EDIT, COSINE = 0.5, 2, 0.78
#: Names of a block; the pairs of two blocks are compared in one piece, of a million pairs.
BLOCK = 1_024


#: An alias table is broadcast up to this many rows (two names of up to 128 characters each).
MAX_ALIASES = 50_000


def applied(steps: DataFrame, known: DataFrame, most: int = MAX_ALIASES) -> DataFrame:
    """steps with `tool` replaced by the canonical name that the alias table (raw, canonical) gives; others stay as they are.

    Of several rows for a raw name the least counts. A table of up to `most` rows, which is counted, is broadcast; a larger one is
    joined by name, where a frequent name's partition can be split.
    """
    once = known.filter("raw IS NOT NULL").groupBy(F.col("raw").alias("__raw")).agg(F.min("canonical").alias("__canonical"))
    if once.limit(most + 1).count() <= most:
        once = F.broadcast(once)
    named = steps.join(once, steps["tool"] == once["__raw"], "left")
    return named.withColumn("tool", F.coalesce("__canonical", "tool")).drop("__raw", "__canonical")


def forms(names: DataFrame) -> DataFrame:
    """(name) -> (id, name, form), ids in order of the names, which one task gives out: a few bytes a name.

    They are written to the checkpoint folder: the pairs read them three times.
    """
    from pyspark.sql import Window

    checkpoint_dir(names.sparkSession)

    distinct = names.select("name").filter("name IS NOT NULL").distinct()
    return distinct.select(F.row_number().over(Window.orderBy("name")).cast("long").alias("id"), "name", T.canonical_form("name").alias("form")).checkpoint()


def pairs(rows: DataFrame, known: DataFrame | None = None, spanning: bool = False) -> DataFrame:
    """All pairs of names with an equal form, or close ones: (a, b, same, jaccard, distance, cosine); where known (id, cluster) is given, of different clusters.

    Names are cut into blocks by their ids, and every two blocks are compared in one piece, so that a task holds two blocks and what is
    close in them, and what is shuffled is the names once for each block, not their pairs. Blocks of one cluster aren't compared with each other.
    With spanning, each piece leaves as many links as connect its clusters.
    """
    rows = rows.select("id", "form", F.col("id").alias("of")) if known is None else rows.join(known.withColumnRenamed("cluster", "of"), "id").select("id", "form", "of")
    rows = rows.withColumn("block", F.expr(f"id DIV {BLOCK}"))
    blocks = rows.groupBy("block").agg(F.min("of").alias("least"), F.max("of").alias("most"))
    x, y = (blocks.select(F.col("block").alias(c), F.col("least").alias(f"least_{c}"), F.col("most").alias(f"most_{c}")) for c in ("x", "y"))
    pieces = x.join(y, F.expr("x <= y AND NOT (least_x = most_x AND least_y = most_y AND least_x = least_y)")).select("x", "y")
    sides = [pieces.withColumn("block", F.col("x")).withColumn("right", F.lit(False)), pieces.withColumn("block", F.col("y")).withColumn("right", F.lit(True))]
    # few names make many pairs: they aren't left to one task because what it reads is small
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    facing = sides[0].unionByName(sides[1]).join(rows, "block").select("x", "y", "right", "id", "of", "form").repartition(n, "x", "y")

    def compared(piece: pa.Table) -> pa.Table:
        left, right = (piece.filter(pc.equal(piece["right"], side)) for side in (False, True))
        (a, ofa), (b, ofb) = ([side[c].to_numpy() for c in ("id", "of")] for side in (left, right))
        wanted = (a[:, None] < b[None, :]) & (ofa[:, None] != ofb[None, :])
        i, j, jaccard, distance, cosine = close(left["form"].to_pylist(), right["form"].to_pylist(), wanted, JACCARD, EDIT, COSINE)
        if spanning:
            kept = forest(ofa[i], ofb[j])
            i, j, jaccard, distance, cosine = i[kept], j[kept], jaccard[kept], distance[kept], cosine[kept]
        return pa.table({"a": a[i], "b": b[j], "same": distance == 0, "jaccard": jaccard, "distance": distance.astype("int32"), "cosine": cosine})

    found = facing.groupBy("x", "y").applyInArrow(compared, "a long, b long, same boolean, jaccard double, distance int, cosine double")
    return found.withColumn("cosine", F.round("cosine", 6))


def links(rows: DataFrame) -> DataFrame:
    """(a, b): enough of the links between close names to give the same clusters as all pairs(), without the pairs within most of them.

    Forms that are equal, or of which up to one deletion leaves the same, are within two edits, so each is linked to the first of its
    kind. Only names that these links leave apart are compared.
    """
    checkpoint_dir(rows.sparkSession)
    keys = rows.select("id", F.explode(T.deletions("form", 1)).alias("k"))
    first = keys.groupBy("k").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    sure = keys.join(first, "k").filter("a < id").select("a", F.col("id").alias("b")).distinct().checkpoint()
    rest = pairs(rows, label_components(rows.select("id"), sure), spanning=True)
    return sure.unionByName(rest.select("a", "b"))


def clusters(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(name, form, canonical): the shortest form of a cluster, ties by form and then by name, stands for all."""
    label = label_components(rows.select("id"), found.select("a", "b"))
    known = rows.join(label, "id")
    head = known.groupBy("cluster").agg(F.min(F.struct(F.length("form").alias("n"), "form", "name")).alias("m"))
    return known.join(head, "cluster").select("name", "form", F.col("m.form").alias("canonical"))


def decisions(found: DataFrame) -> DataFrame:
    """(name, form, canonical) -> name, canonical, method, confidence: the name itself, an equal form, one within two edits, shared tokens, or trigrams."""
    distance, jaccard = T.levenshtein_bounded("form", "canonical", EDIT), T.token_jaccard("form", "canonical")
    known = found.withColumns({"distance": distance, "jaccard": jaccard})
    same, exact, near, tokens = F.col("name") == F.col("canonical"), F.col("form") == F.col("canonical"), F.col("distance") <= EDIT, F.col("jaccard") >= JACCARD
    method = F.when(same, "self").when(exact, "exact").when(near, "edit_distance").when(tokens, "token_jaccard").otherwise("trigram_cosine")
    cosine = F.round(T.trigram_cosine("form", "canonical"), 3)
    confidence = F.when(same, 1.0).when(exact, 0.99).when(near, 1 - F.col("distance") / 4).when(tokens, F.round("jaccard", 3)).otherwise(cosine)
    return known.select("name", "canonical", method.alias("method"), confidence.alias("confidence"))
