"""Transfers by account: the two sides of every transfer, and a table of them in buckets of accounts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDES = "account_id STRING, other STRING, ts TIMESTAMP, sent DOUBLE, received DOUBLE, largest DOUBLE"
BUCKETS = 256


def sides(transfers: DataFrame) -> DataFrame:
    """Each transfer as its sender and as its receiver see it; a transfer to oneself is one row with both amounts."""
    largest = F.greatest("amount_paid", "amount_received").alias("largest")
    to_self = F.col("from_id").eqNullSafe(F.col("to_id"))
    sender = F.struct(
        F.col("from_id").alias("account_id"), F.col("to_id").alias("other"), "ts", F.col("amount_paid").alias("sent"),
        F.when(to_self, F.col("amount_received")).otherwise(0.0).alias("received"), largest,
    )
    receiver = F.struct(
        F.col("to_id").alias("account_id"), F.col("from_id").alias("other"), "ts", F.lit(0.0).alias("sent"),
        F.col("amount_received").alias("received"), largest,
    )
    return transfers.select(F.inline(F.array_compact(F.array(sender, F.when(~to_self, receiver)))))


@dataclass
class Adjacency:
    """Sides of all transfers in Parquet, one folder per bucket of accounts, ordered by account inside each file."""

    spark: SparkSession
    path: str
    buckets: int

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("account_id"), F.lit(self.buckets)).cast("int")

    def table(self) -> DataFrame:
        return self.spark.read.schema(f"{SIDES}, bucket INT").parquet(self.path)

    def rows_of(self, accounts: DataFrame) -> DataFrame:
        """Sides of the given accounts; only their buckets are read (at most ``buckets`` numbers come to the driver)."""
        touched = [r.bucket for r in accounts.filter("account_id IS NOT NULL").select(self.bucket().alias("bucket")).distinct().collect()]
        read = self.table().filter(F.col("bucket").isin(touched)).drop("bucket")
        return read.join(accounts.select("account_id"), "account_id", "left_semi")


def write_adjacency(transfers: DataFrame, path: str, buckets: int = BUCKETS) -> Adjacency:
    """Write the sides of ``transfers`` once, for many lookups.

    The rebalance lets adaptive execution cut a bucket with a hub into several files and keep small buckets in one; rows
    are ordered by account and neighbour, so row groups are skipped inside a bucket too. Rows without an account
    are left out, as no lookup finds them.
    """
    made = Adjacency(transfers.sparkSession, path, buckets)
    placed = sides(transfers).filter("account_id IS NOT NULL").withColumn("bucket", made.bucket())
    spread = placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "account_id", "other")
    spread.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return made


def touching(transfers: DataFrame | Adjacency, accounts: DataFrame) -> DataFrame:
    """Sides of the transfers of some accounts.

    ``accounts(account_id)`` should be a written table: then Spark knows its size before it plans, and below the broadcast
    threshold other transfers are dropped where they are read, without a shuffle.
    """
    if isinstance(transfers, Adjacency):
        return transfers.rows_of(accounts)
    return sides(transfers).join(accounts.select("account_id"), "account_id", "left_semi")
