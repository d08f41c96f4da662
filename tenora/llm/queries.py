"""The corpus operators as named queries over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenora.llm import (
    ann, chat, importance, langid, mixing, packing, periodic, quality, repeats, sharding, simhash, urlfilter,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(spark, _table(spark, sf_dir, "documents"), keep=("doc_id",))
    return taken.select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(spark, _table(spark, sf_dir, "documents"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(spark, docs, _table(spark, sf_dir, "labels"))
    judged = quality.judge(docs.select("doc_id", "text"), model)
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "probability")


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(spark, docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", langid.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(spark, _table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"),
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard")


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(spark, _table(spark, sf_dir, "documents"), tokenizer_path())


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.format_chats(turns))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark, _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.planted_runs(_table(spark, sf_dir, "documents"))


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.without_repeats(spark, _table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"), "longest")


QUERIES = {
    "op1_mix_sources": mix,
    "op2_simhash_groups": near_duplicates,
    "op3_quality_rules": quality_rules,
    "op4_warc_round_trip": warc_round_trip,
    "op5_language_id": language_id,
    "op6_virtual_slots": shard,
    "op7_bin_slack_packing": pack,
    "op8_url_rules": url_filter,
    "op9_chat_format": chat_format,
    "op10_nearest_vectors": nearest_vectors,
    "op11_importance_resampling": importance_resampling,
    "op12_periodic_runs": periodic_runs,
    "op13_repeated_passages": repeated_passages,
}

SQL = {
    "op1_mix_sources": mixing.SQL,
    "op4_warc_round_trip": warc.SQL,
    "op8_url_rules": urlfilter.SQL,
    "op9_chat_format": chat.SQL,
    "op11_importance_resampling": importance.SQL,
}
