"""The registered query of each operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import conversations, decontamination, fim, langid, licenses, oracle, pieces, quality, repeats, toxicity, url_rules, warc
from barline.llm.jaccard_join import jaccard_components
from barline.llm.scratch import Scratch
from barline.llm.sharding import histogram_shards


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histogram_shards(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit_on(docs, table(spark, sf_dir, "labels")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.Pieces.load())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a page are those of the document that its path names by number."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    named = pages.select("url", F.regexp_extract(url_rules.path(F.col("url")), r"^/[a-z]+/(\d{1,18})", 1).alias("named")).where("named <> ''")
    bad = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("unwanted"))
    labelled = named.withColumn("doc_id", F.col("named").cast("long")).join(bad, "doc_id").select("url", "unwanted")
    return url_rules.judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict", "sure")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), Scratch(spark, "warc"))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit_on(docs))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = fim.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_sharding,
        op2_quality_rules,
        op3_sentencepiece,
        op4_toxicity,
        op5_license_scan,
        op6_decontamination,
        op7_url_filter,
        op8_warc,
        op9_language_id,
        op10_jaccard_join,
        op11_conversation_repair,
        op12_substring_dedup,
        op13_fill_in_middle,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Only where SQL can express all of a result: the others come from trained models, hashing or iteration."""
    return {"op5_license_scan": oracle.license_sql(), "op8_warc": oracle.WARC_SQL, "op10_jaccard_join": oracle.JACCARD_SQL, "op11_conversation_repair": oracle.CONVERSATION_SQL, "op12_substring_dedup": oracle.REPEATS_SQL, "op13_fill_in_middle": oracle.FIM_SQL}
