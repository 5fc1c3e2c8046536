"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import bpe, chat, language, line_runs, merkle, mixing, phrases, pii, pstable, quality, sharding, shingle_join, simhash
from ledgerlight.llm.common import table

SHARDS = 40


def vocabulary() -> str:
    """The public vocabulary file that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), SHARDS)


def op2_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near: for the searched documents (doc_id divisible by 20) the documents within 3 bits, itself included."""
    made = simhash.edited_prints(table(spark, sf_dir, "documents"))
    made = line_runs.cut_lineage(made)
    counts = made.groupBy("print").agg(F.count("*").alias("n"))
    queries = made.where("doc_id % 20 = 0").select("print").distinct()
    found = simhash.near_prints(queries, counts.select("print"))
    near = found.join(counts.withColumnRenamed("print", "near"), "near").groupBy("print").agg(F.sum("n").alias("n_near"))
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return made.join(near, "print", "left").select(
        "doc_id", "n_chars", "edited_sha256", digits("print").alias("fingerprint"), digits("edited_print").alias("edited_fingerprint"),
        simhash.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), simhash.likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        F.when(F.col("doc_id") % 20 == 0, F.col("n_near")).alias("n_near"),
    )


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_runs.drop_repeated_runs(table(spark, sf_dir, "documents"))
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "first_at").repartitionByRange("first_at", "doc_id").sortWithinPartitions("first_at", "doc_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select(
        "doc_id", (quality.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary())


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspective_segments(table(spark, sf_dir, "conversations"))


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_documents(table(spark, sf_dir, "documents")).drop("node", "group", "mark")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = quality.fold(F.col("doc_id")) == 0
    return language.predict(docs, language.fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose doc_id's checksum 7 divides are tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered).drop("proof")


QUERIES = {f.__name__: f for f in (op1_sharding, op2_pstable, op3_fingerprints, op4_line_runs, op5_mixing, op6_quality, op7_bpe, op8_pii, op9_perspectives, op10_shingle_join, op11_phrases, op12_language, op13_merkle)}
