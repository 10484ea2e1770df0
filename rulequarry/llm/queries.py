"""The dealt operators as queries over whole tables, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulequarry.llm import attention_quality, conversation_repair, decontaminate, fingerprint_index, html_extract, jaccard_join, language_id, mixing, quality_rules, secret_scan, suffix_dedup, token_counts, vector_codes


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_read(spark, sf_dir, "documents"), texts=False)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it is contaminated, its best coverage and the items covered enough."""
    found = decontaminate.coverage(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    enough = F.filter("matches", lambda m: m["covered"] >= F.lit(decontaminate.MIN_COVERAGE) * m["length"])
    return found.select(
        "doc_id",
        decontaminate.contaminated().alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["covered"] / m["length"])), F.lit(0.0)).alias("coverage"),
        F.array_sort(F.transform(enough, lambda m: m["item_id"])).alias("item_ids"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.train(docs, _read(spark, sf_dir, "labels")))


def op5_incremental_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_index.incremental_dedup(_read(spark, sf_dir, "documents"), texts=False)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(_read(spark, sf_dir, "documents"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_read(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    learned = language_id.samples(docs)
    found = language_id.identify(docs, learned)
    return found.select("doc_id", F.coalesce(language_id.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.digest(fixed_only=True), 256).alias("base_sha256"), secret_scan.digest().alias("spans"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_read(spark, sf_dir, "embeddings"))


def op12_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return attention_quality.quality_scores(docs, attention_quality.train(docs, _read(spark, sf_dir, "labels")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(*conversation_repair.damaged(_read(spark, sf_dir, "conversations")))


def mix_sources_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_mix_sources that its SQL statement has."""
    return op10_mix_sources(spark, sf_dir).select("doc_id", "source", "copy", "order_key")


def queries():
    return {f.__name__: f for f in (op1_suffix_dedup, op2_decontaminate, op3_token_counts, op4_quality_rules, op5_incremental_dedup, op6_jaccard_join, op7_html_extract, op8_language_id, op9_secret_scan, op10_mix_sources, mix_sources_ids, op11_vector_codes, op12_attention_quality, op13_conversation_repair)}


def oracle_sql():
    return {"mix_sources_ids": mixing.ORACLE, "op11_vector_codes": vector_codes.ORACLE, "op13_conversation_repair": conversation_repair.ORACLE}
