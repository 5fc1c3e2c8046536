"""Checks on incoming rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Accepted values of the enumerated columns, and the least size of a watch list.
STATUSES = ["INTENT", "HELD", "COMPLETED", "DENIED", "UPSTREAM_ERROR"]
DISPOSITIONS = ["cleared", "escalate", "monitor"]
ENTITY_TYPES = ["individual", "entity", "vessel", "aircraft"]
MIN_WATCHLIST_ROWS = 10_000


def with_reason(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Add ``reject_reason``: the first check that does not hold (null counts as not holding)."""
    reason = None
    for name, holds in checks.items():
        fails = ~F.coalesce(holds, F.lit(False))
        reason = F.when(fails, name) if reason is None else reason.when(fails, name)
    return df.withColumn("reject_reason", reason)


def reject_bad_rows(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    judged = with_reason(df, checks)
    return judged.filter("reject_reason IS NULL").drop("reject_reason"), judged.filter("reject_reason IS NOT NULL")


def invalid_values(df: DataFrame, column: str, accepted: list[str]) -> DataFrame:
    return df.filter(~F.coalesce(F.col(column).isin(accepted), F.lit(False)))


def require_rows(df: DataFrame, least: int = MIN_WATCHLIST_ROWS) -> DataFrame:
    """Fail when a table is implausibly small."""
    found = df.limit(least).count()
    if found < least:
        raise ValueError(f"expected at least {least} rows, found {found}")
    return df


@dataclass
class Split:
    """Good rows, rejected rows with all their reasons, and how many there were, all from one pass."""

    good: DataFrame
    rejected: DataFrame
    counts: dict[str, int]

    def require(self, least: int) -> Split:
        """Fail when too few rows were accepted; reads the counter, not the table."""
        if self.counts["accepted"] < least:
            raise ValueError(f"expected at least {least} rows, accepted {self.counts['accepted']} of {self.counts['total']}")
        return self


def reasons(checks: dict[str, Column]) -> Column:
    """Names of all checks that do not hold, in their order (null counts as not holding)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in checks.items()]))


def split_rows(df: DataFrame, checks: dict[str, Column], path: str, record: Column) -> Split:
    """Judge ``df`` once and write it to ``path``, accepted and rejected rows in folders of their own.

    Counters come from the same job that writes: ``total``, ``accepted`` and one per check. A rejected row is its
    ``record`` and its ``reasons``, a good row is as ``df`` has it. An empty table gives two empty ones and zeros.
    """
    judged = df.withColumn("_reasons", reasons(checks)).withColumn("_record", record)
    counted = {"total": F.count("*"), "accepted": F.count_if(F.size("_reasons") == 0)}
    counted |= {f"rejected_{name}": F.count_if(F.array_contains("_reasons", name)) for name in checks}
    seen = Observation()
    accepted = F.size("_reasons") == 0
    # A good row's text is not kept twice.
    told = judged.withColumn("_accepted", accepted).withColumn("_record", F.when(~accepted, F.col("_record")))
    told.observe(seen, *[c.alias(name) for name, c in counted.items()]).write.mode("overwrite").partitionBy("_accepted").parquet(path)
    kept = df.sparkSession.read.schema(told.schema).parquet(path)
    return Split(
        kept.filter("_accepted").select(*df.columns),
        kept.filter("NOT _accepted").select(F.col("_record").alias("record"), F.col("_reasons").alias("reasons")),
        {name: int(n or 0) for name, n in seen.get.items()},
    )
