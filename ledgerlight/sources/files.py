"""Readers and writers. Every reader takes an explicit schema; every writer runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.operators.quality import Split, split_rows
from ledgerlight.operators.screening import clean_sentinel, split_programs
from ledgerlight.sources import schemas


def _account_id(bank: str, account: str):
    """``int(bank):account`` – a numeric bank id loses its leading zeros."""
    return F.concat_ws(":", F.expr(f"try_cast({bank} AS INT)"), F.col(account))


def _typed_transfers(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.try_to_timestamp("ts", F.lit("yyyy/MM/dd HH:mm")).alias("ts"),
        "from_bank", "from_account", "to_bank", "to_account",
        F.expr("try_cast(amount_received AS DOUBLE)").alias("amount_received"),
        "receiving_currency",
        F.expr("try_cast(amount_paid AS DOUBLE)").alias("amount_paid"),
        "payment_currency", "payment_format",
        F.expr("try_cast(is_laundering AS INT)").alias("is_laundering"),
        _account_id("from_bank", "from_account").alias("from_id"),
        _account_id("to_bank", "to_account").alias("to_id"),
        *[c for c in raw.columns if c in ("_corrupt", "_text")],
    )


def read_transfers(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV whose column names repeat, so columns are named by position."""
    return _typed_transfers(spark.read.schema(schemas.TRANSFER_CSV).csv(path, header=True, enforceSchema=True))


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.ACCOUNT_CSV).csv(path, header=True, enforceSchema=True)
    return raw.withColumn("account_id", _account_id("bank_id", "account_number"))


def _raw_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a header CSV as text, with ``_text`` for the reject frame; ``_corrupt`` marks a wrong number of columns."""
    reader = spark.read.schema(f"{schema}, _corrupt STRING").option("columnPruning", "false").option("escape", '"')
    raw = reader.csv(path, header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    fields = [c for c in raw.columns if c != "_corrupt"]
    return raw.withColumn("_text", F.coalesce("_corrupt", F.to_csv(F.struct(*fields))))


def _whole_or(holds: Column) -> Column:
    """A row with a wrong number of columns has that one reason only: what stands in its fields means nothing."""
    return F.col("_corrupt").isNotNull() | F.coalesce(holds, F.lit(False))


def _split(typed: DataFrame, checks: dict[str, Column], out: str) -> Split:
    named = {"column_count": F.col("_corrupt").isNull()} | {name: _whole_or(holds) for name, holds in checks.items()}
    found = split_rows(typed, named, out, F.col("_text"))
    return Split(found.good.drop("_corrupt", "_text"), found.rejected, found.counts)


def _bank_and_account(side: str, bank: str, account: str) -> dict[str, Column]:
    return {
        f"{side}_bank": F.expr(f"try_cast({bank} AS INT)").isNotNull(),
        f"{side}_account": F.trim(account) != "",
    }


def split_transfers(spark: SparkSession, path: str, out: str) -> Split:
    """:func:`read_transfers` with reasons: rows with a bad time, bank, account, amount or label go to the reject frame.

    The files are read once; both frames are read from ``out``. Amounts must be finite numbers, labels 0 or 1.
    """
    def finite(c: str) -> Column:
        return F.abs(F.col(c)) < float("inf")  # false for infinite ones, and Spark orders NaN above them

    checks = {"ts": F.col("ts").isNotNull()}
    checks |= _bank_and_account("from", "from_bank", "from_account") | _bank_and_account("to", "to_bank", "to_account")
    checks |= {c: finite(c) for c in ("amount_received", "amount_paid")}
    checks["is_laundering"] = F.col("is_laundering").isin(0, 1)
    return _split(_typed_transfers(_raw_rows(spark, path, schemas.TRANSFER_CSV)), checks, out)


def split_accounts(spark: SparkSession, path: str, out: str) -> Split:
    """:func:`read_accounts` with reasons for rows without a numeric bank or an account number."""
    raw = _raw_rows(spark, path, schemas.ACCOUNT_CSV)
    typed = raw.withColumn("account_id", _account_id("bank_id", "account_number"))
    return _split(typed, _bank_and_account("own", "bank_id", "account_number"), out)


def read_patterns(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``BEGIN … / END LAUNDERING ATTEMPT`` blocks to one row per edge.

    Each block is one record of the text reader. ``limit`` keeps the first blocks in
    file order, as a small verification set.
    """
    blocks = spark.read.option("lineSep", "END LAUNDERING ATTEMPT").text(path)
    located = blocks.select(
        F.regexp_replace("value", r"(?s)^.*?(?=BEGIN LAUNDERING ATTEMPT)", "").alias("block"),
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("at"),
    ).filter(F.col("block").startswith("BEGIN LAUNDERING ATTEMPT"))
    if limit is not None:
        located = located.orderBy("at").limit(limit)
    lines = located.select(
        F.col("at").alias("pattern_id"),
        F.trim(F.regexp_extract("block", r"^BEGIN LAUNDERING ATTEMPT\s*-\s*([^\n]*)", 1)).alias("typology"),
        F.posexplode(F.split("block", r"\r?\n")).alias("line", "text"),
    ).filter((F.col("line") > 0) & (F.trim("text") != ""))
    part = F.split("text", ",")
    return lines.select(
        "pattern_id", "typology", "line",
        F.concat_ws(":", part[1].cast("int"), part[2]).alias("from_id"),
        F.concat_ws(":", part[3].cast("int"), part[4]).alias("to_id"),
    )


def whole_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header-less CSV rows with exactly the columns of the schema; all are parsed, so that pruned ones count too."""
    reader = spark.read.schema(schema).option("columnPruning", "false").option("escape", '"')
    return reader.csv(path, mode="DROPMALFORMED")


def rejected_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(record, reason) of the rows that :func:`whole_rows` leaves out: those with too few or too many columns."""
    reader = spark.read.schema(f"{schema}, _record STRING").option("columnPruning", "false").option("escape", '"')
    raw = reader.csv(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_record")
    return raw.filter("_record IS NOT NULL").select(F.col("_record").alias("record"), F.lit("column_count").alias("reason"))


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Header-less 12-column CSV; short rows drop out and the last row of an id wins."""
    raw = whole_rows(spark, path, schemas.WATCHLIST_CSV)
    placed = raw.withColumn("_at", F.monotonically_increasing_id())
    entries = placed.select(
        F.trim("ent_num").alias("ent_num"),
        F.trim("name").alias("name"),
        F.coalesce(clean_sentinel(F.col("sdn_type")), F.lit("entity")).alias("sdn_type"),
        split_programs(F.col("program")).alias("programs"),
        F.coalesce(clean_sentinel(F.col("remarks")), F.lit("")).alias("remarks"),
        "_at",
    )
    kept = entries.groupBy("ent_num").agg(F.max_by(F.struct("name", "sdn_type", "programs", "remarks"), "_at").alias("e"))
    return kept.select("ent_num", "e.*")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    raw = whole_rows(spark, path, schemas.ALIAS_CSV)
    named = raw.select(F.trim("ent_num").alias("ent_num"), F.trim("alt_name").alias("alias"))
    return named.filter(F.coalesce(F.col("alias") != "", F.lit(False)))


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Day-partitioned call files with hour, day and the parsed JSON columns."""
    raw = spark.read.schema(schemas.CALL_FILES + ", day DATE").parquet(path)
    return raw.select(
        "*",
        F.col("timestamp").alias("ts"),
        F.date_trunc("hour", "timestamp").alias("hour"),
        F.from_json("decision", schemas.DECISION).alias("decision_parsed"),
        F.from_json("policies_fired", schemas.POLICIES_FIRED).alias("policies_fired_parsed"),
        F.from_json("tokens", schemas.TOKENS).alias("tokens_parsed"),
        F.from_json("tags", "array<string>").alias("tags_parsed"),
    )


def open_table(spark: SparkSession, path: str, schema: str, id_columns: list[str]) -> DataFrame:
    """A folder of Parquet (any depth) or one ``.csv``/``.parquet`` file, id columns as text."""
    if path.endswith(".csv"):
        df = spark.read.schema(schema).csv(path, header=True)
    elif path.endswith(".parquet"):
        df = spark.read.schema(schema).parquet(path)
    else:
        df = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    return df.withColumns({c: F.col(c).cast("string") for c in id_columns if c in df.columns})


def fetch_audit(spark: SparkSession, path: str) -> DataFrame:
    """The whole log in chain order, range-partitioned by id."""
    return spark.read.parquet(path).repartitionByRange("id").sortWithinPartitions("id")


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SCENARIO).json(path)


def write_scenarios(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_by_day(df: DataFrame, path: str, ts: str = "ts", files_per_day: int | None = None) -> None:
    """Parquet by day. A day is spread over hash slices of its rows, so a busy day is not one task."""
    dated = df.withColumn("day", F.to_date(ts))
    if files_per_day:
        piece = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c != ts][:2], F.col(ts)), F.lit(files_per_day))
        dated = dated.repartition("day", piece)
    else:
        # AQE splits a skewed partition of a rebalance and merges small ones.
        dated = dated.hint("rebalance", "day")
    dated.write.mode("overwrite").partitionBy("day").parquet(path)


def write_by_month(df: DataFrame, path: str, ts: str = "ts") -> None:
    dated = df.withColumn("month", F.date_format(ts, "yyyy-MM")).hint("rebalance", "month")
    dated.write.mode("overwrite").partitionBy("month").parquet(path)


def write_accounts(accounts: DataFrame, sample: DataFrame, path: str) -> None:
    accounts.join(sample, "account_id", "left_semi").write.mode("overwrite").parquet(path)


def write_tiers(tiered: DataFrame, path: str) -> None:
    """``tiered`` carries ``tier`` and ``day``."""
    tiered.hint("rebalance", "tier", "day").write.mode("overwrite").partitionBy("tier", "day").parquet(path)


def replace_source(df: DataFrame, path: str, source: str) -> None:
    """Replace the rows of one source and leave the others; executors write, nothing is collected."""
    replace_partitions(df.withColumn("source", F.lit(source)), path, "source")


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def publish_table(df: DataFrame, path: str | None = None, jdbc_url: str | None = None, table: str | None = None) -> None:
    """Bulk-load the published columns to Parquet, or to a relational table emptied first."""
    chosen = df.select(*schemas.PUBLISHED_COLUMNS)
    if jdbc_url:
        chosen.write.mode("overwrite").option("truncate", "true").option("batchsize", 50_000).jdbc(jdbc_url, table)
    else:
        chosen.write.mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row nested run report as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)


def subsample_report(stats: DataFrame, connectivity: DataFrame, seed: int, target: int) -> DataFrame:
    """Nested one-row report from the sample's statistics (two rows) and pattern check (one row)."""
    sides = stats.groupBy().pivot("side", ["raw", "sampled"]).agg(F.first(F.struct("total", "labelled", "ratio_pct")))
    checked = connectivity.select(F.struct("*").alias("pattern_connectivity"))
    keyed = sides.withColumn("_k", F.lit(1)).join(checked.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return keyed.select(F.lit(seed).alias("seed"), F.lit(target).alias("target_accounts"), "raw", "sampled", "pattern_connectivity")
