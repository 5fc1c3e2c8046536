"""Time-framed sums that stay linear and split hot keys.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, and a
sliding range frame is re-summed for every row. Both helpers below partition by
(key, time bucket) instead, and take differences of growing frames, which Spark
updates incrementally, so the work per row is constant and one busy key is
spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null: a null key is a key like any other."""
    named = right.withColumnsRenamed({key: f"_r_{key}" for key in keys})
    hit = F.lit(True)
    for key in keys:
        hit = hit & left[key].eqNullSafe(named[f"_r_{key}"])
    return left.join(named, hit).drop(*[f"_r_{key}" for key in keys])


def framed_sums(
    df: DataFrame,
    keys: list[str],
    ts: str,
    trailing: dict[str, tuple[Column, int, int]] | None = None,
    to_date: dict[str, Column] | None = None,
    distinct_to_date: dict[str, str] | None = None,
    bucket_us: int = HOUR,
) -> DataFrame:
    """Add trailing sums, running sums and running distinct counts per key in one pass.

    ``trailing``: name -> (measure, lo, hi), the sum over ``[ts + lo, ts + hi]`` (µs,
    inclusive, ``hi`` <= 0). A row only needs its own bucket and the one before, so
    rows near the end of a bucket are copied into the next one.

    ``to_date``: name -> whole-number measure, summed over rows of the key with an
    equal or earlier ``ts``. Totals per (key, bucket) are carried over the few
    buckets of a key; the window inside a bucket adds the remainder.

    ``distinct_to_date``: name -> column with few distinct values (such as tools).
    """
    trailing, to_date, distinct_to_date = trailing or {}, to_date or {}, distinct_to_date or {}
    reach = max([-lo for _, lo, _ in trailing.values()], default=-1)
    width = max(bucket_us, reach + 1)
    measured = {f"_m_{name}": measure.cast("bigint") for name, measure in to_date.items()}
    timed = df.withColumns({**measured, "_t": micros(ts)}).withColumn("_own", F.floor(F.col("_t") / F.lit(width)))
    both = F.array(F.col("_own"), F.col("_own") + 1)
    near_end = F.col("_t") + reach >= (F.col("_own") + 1) * width
    bucket = F.explode(F.when(near_end, both).otherwise(F.array("_own"))) if trailing else F.col("_own")
    placed = timed.withColumn("_bucket", bucket)
    own = F.col("_bucket") == F.col("_own")
    window = Window.partitionBy(*keys, "_bucket").orderBy("_t")
    so_far = window.rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def up_to(measure: Column, offset: int) -> Column:
        return F.coalesce(F.sum(measure).over(window.rangeBetween(Window.unboundedPreceding, offset)), F.lit(0))

    added = {name: up_to(measure, hi) - up_to(measure, lo - 1) for name, (measure, lo, hi) in trailing.items()}
    added |= {f"_i_{name}": F.coalesce(F.sum(F.when(own, F.col(f"_m_{name}"))).over(so_far), F.lit(0)) for name in to_date}
    added |= {f"_v_{name}": F.collect_set(F.when(own, F.col(column))).over(so_far) for name, column in distinct_to_date.items()}
    framed = placed.withColumns(added).filter(own)
    if to_date or distinct_to_date:
        totals = timed.groupBy(*keys, F.col("_own").alias("_bucket")).agg(
            *[F.sum(f"_m_{name}").alias(f"_s_{name}") for name in to_date],
            *[F.collect_set(column).alias(f"_s_{name}") for name, column in distinct_to_date.items()],
        )
        earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(
            *keys,
            "_bucket",
            *[F.coalesce(F.sum(f"_s_{name}").over(earlier), F.lit(0)).alias(f"_c_{name}") for name in to_date],
            *[
                F.array_distinct(F.flatten(F.collect_set(f"_s_{name}").over(earlier))).alias(f"_c_{name}")
                for name in distinct_to_date
            ],
        )
        framed = join_null_safe(framed, carried, [*keys, "_bucket"]).withColumns(
            {name: F.col(f"_c_{name}") + F.col(f"_i_{name}") for name in to_date}
            | {
                name: F.size(F.array_union(f"_c_{name}", f"_v_{name}")).cast("bigint")
                for name in distinct_to_date
            }
        )
    scratch = [c for c in framed.columns if c in ("_t", "_own", "_bucket") or c[:3] in ("_m_", "_i_", "_v_", "_c_")]
    return framed.drop(*scratch)


def trailing_sums(
    df: DataFrame, keys: list[str], ts: str, frames: dict[str, tuple[Column, int, int]], bucket_us: int = 0
) -> DataFrame:
    return framed_sums(df, keys, ts, trailing=frames, bucket_us=bucket_us)


def sums_to_date(df: DataFrame, keys: list[str], ts: str, measures: dict[str, Column], bucket_us: int = HOUR) -> DataFrame:
    return framed_sums(df, keys, ts, to_date=measures, bucket_us=bucket_us)


def row_positions(
    df: DataFrame, keys: list[str], ts: str, tie: str, name: str = "position", bucket_us: int = HOUR
) -> DataFrame:
    """Add the exact 1-based position of each row within its key, ordered by (ts, tie).

    Same two levels as :func:`sums_to_date`: bucket counts are carried forward and
    ``row_number`` only runs inside one (key, bucket).
    """
    placed = df.withColumn("_t", micros(ts)).withColumn("_bucket", F.floor(F.col("_t") / F.lit(bucket_us)))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        placed.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_c"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_t", tie)
    return (
        join_null_safe(placed, carried, [*keys, "_bucket"])
        .withColumn(name, F.col("_c") + F.row_number().over(inside))
        .drop("_t", "_bucket", "_c")
    )


def last_rows(
    df: DataFrame, keys: list[str], position: str, item: Column, n: int, name: str, block: int = 4096
) -> DataFrame:
    """Add an array of ``item`` over this row and the ``n - 1`` before it, newest first.

    ``position`` comes from :func:`row_positions`. Rows are cut into blocks of
    positions; the last ``n - 1`` rows of a block are copied into the next.
    """
    own = F.floor(F.col(position) / block)
    near_end = F.col(position) % block >= block - (n - 1)
    spread = df.withColumn("_own", own).withColumn(
        "_block",
        F.explode(F.when(near_end, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))),
    )
    window = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(-(n - 1), 0)
    return (
        spread.withColumn(name, F.reverse(F.collect_list(item).over(window)))
        .filter(F.col("_block") == F.col("_own"))
        .drop("_own", "_block")
    )
