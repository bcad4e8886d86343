"""The operators' queries over their whole tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fingerprints, licenses, lines, neardup, negatives, packing, pii, quality, shards, urls, whitening
from .common import table


def word_tokenizer() -> str:
    """The place of the public word tokenizer's file; it is read there and never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    of_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarise(licenses.find_licenses(table(spark, sf_dir, "documents")))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = lambda c: F.sha2(F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ","), 256)
    size = lambda c: F.size(c).cast("long")
    return found.select(
        "doc_id", "n_words", size("hits").alias("n_hit"), size("items").alias("n_items"), names("items").alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
        size("near").alias("n_near_items"), names("near").alias("near_items_sha256"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = lines.judge_lines(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    content = F.size(F.filter("content", lambda c: c)).cast("long")
    return judged.select("doc_id", *lines.COUNTS, "base_failed", "kept", "n_content_words", content.alias("n_content_lines"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_licenses, op3_neardup, op4_packing, op5_decontam, op6_quality, op7_chat, op8_urls, op9_shards, op10_fingerprints, op11_whitening, op12_negatives, op13_lines)}


def queries() -> dict:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    sql = {"op3_neardup": neardup.ORACLE, "op5_decontam": decontam.ORACLE, "op7_chat": chat.ORACLE, "op12_negatives": negatives.ORACLE}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
