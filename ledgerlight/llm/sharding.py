"""Shards by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import hex_bucket, running, seeded_key, whole_text

ROW_BYTES = 16


def interleave(docs: DataFrame, shards: int, seed: int = 17, rows_per_bucket: int = 2000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The rows of a source are shuffled by a seeded key and ranked; a row of rank r among n
    stands at (2r + 1) / 2n. All rows are sorted by that fraction and the line is cut into
    ``shards`` parts, whose row counts differ by one at most (law ``rows``), so each part
    holds each source in its share of the whole.

    Ranks are two-level: by (source, slice of the key), then by slice of the fraction, so
    neither a source with a third of all rows nor the whole line is ordered in one task.

    A null source is a source of its own, a null text has no bytes (crc32 of nothing, 0), a
    null doc_id shuffles as one value; equal rows are interchangeable. Other columns are
    not read. An empty table gives no row; with fewer rows than shards some stay empty.
    """
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("2")).alias("stratum"),
        (F.octet_length(whole_text()) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(whole_text(), "utf-8")).alias("text_crc32"),
        seeded_key(seed, F.col("doc_id")).alias("key"),
    )
    total = docs.select("doc_id").count()
    buckets = max(1, total // rows_per_bucket)
    tie = ["key", "doc_id", "text_crc32", "size"]
    ranked = running(rows.withColumn("part", hex_bucket(F.col("key"), buckets)), ["stratum"], "part", tie, {"rank": F.lit(1)})
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    placed = ranked.join(sizes, "stratum").withColumn("fraction", (2 * F.col("rank") + 1) / (2 * F.col("n")))
    placed = placed.withColumn("all", F.lit(0)).withColumn("cell", F.floor(F.col("fraction") * buckets))
    line = running(placed, ["all"], "cell", ["fraction", "stratum", *tie], {"at": F.lit(1)})
    return (
        line.withColumn("shard", F.expr(f"(at * {shards}) div {max(1, total)}"))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
            F.expr(f"at - (shard * {total} + {shards - 1}) div {shards}").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
