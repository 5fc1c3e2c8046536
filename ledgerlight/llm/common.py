"""Helpers shared by the text operators: word classes, two-level running sums, order buckets, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.session import cut_lineage

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows of a file of two numbers, about.
FILE_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text() -> Column:
    """The text column, an empty text for null."""
    return F.coalesce(F.col("text"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def text_mark(text: Column) -> Column:
    """With the doc_id, tells rows apart: rows equal in both are one document that is given twice."""
    return F.xxhash64(F.coalesce(text, F.lit("\u0000")))


def seeded_key(seed: int, *parts: Column) -> Column:
    """32 hex digits that shuffle rows by seed and identity alone, so every run gives the same order."""
    texts = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *texts))


def hex_bucket(key: Column, buckets: int) -> Column:
    """Order-preserving bucket of a hex key; ``buckets`` may be up to 2**28."""
    return F.floor(F.conv(F.substring(key, 1, 7), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 28)).cast("long")


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def running(df: DataFrame, group: list[str], bucket: str, order: list[str], values: dict[str, Column | str]) -> DataFrame:
    """Adds, for each ``name: value``, the sum of value over the earlier rows of the group.

    Rows are summed inside (group, bucket); the buckets' totals, one small row each, are
    summed across the group. ``bucket`` must not decrease along ``order``. No task sees
    more than one bucket of a group, so a hot group is spread over its buckets. Neither
    group nor bucket may be null.
    """
    values = {n: F.expr(v) if isinstance(v, str) else v for n, v in values.items()}
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    ahead = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(k).alias(f"_at_{k}") for k in keys],
        *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_from_{n}") for n in values],
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(starts, reduce(lambda a, b: a & b, [df[k] == starts[f"_at_{k}"] for k in keys]))
    sums = {n: F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_from_{n}") for n, v in values.items()}
    return joined.withColumns(sums).drop(*[f"_at_{k}" for k in keys], *[f"_from_{n}" for n in values])


def order_bounds(df: DataFrame, column: str, rows_each: int, most: int) -> list:
    """Ascending cut points that split ``column`` into parts of about ``rows_each`` rows, ``most`` parts at most."""
    parts = max(1, min(most, -(-df.count() // rows_each)))
    if parts == 1:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(column, shares, max(10_000, 20 * parts)).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def order_bucket(column: Column, bounds: list) -> Column:
    """How many cut points are at or below the value (null: past the last), in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda cuts: F.size(F.filter(cuts, lambda cut: cut <= column))
    coarse = below(F.array(*[F.lit(b) for b in bounds[step - 1 :: step]]))
    return F.when(column.isNull(), F.lit(len(bounds) + 1)).otherwise(
        coarse * step + below(F.slice(F.array(*[F.lit(b) for b in bounds]), coarse * step + 1, step))
    )


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the edges, for every node that has one.

    Each round points every node at its smallest neighbour, follows the pointers one step
    further and replaces the edges by those between the nodes pointed at, so paths shrink
    by half at least. Rounds are cut by tables in the shared folder, of as many files as their rows
    need; nothing is collected.
    """
    links = cut_lineage(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").distinct())
    rows = links.count()
    parts = rows // FILE_ROWS + 1
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("component"))
    while rows:
        both = links.union(links.select("b", "a"))
        points = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).coalesce(parts))
        onward = points.select(F.col("a").alias("to"), F.col("to").alias("further"))
        further = cut_lineage(points.join(onward, "to").select("a", F.col("further").alias("to")).coalesce(parts))
        labels = cut_lineage(
            labels.join(further, labels["component"] == further["a"], "left").select("node", F.coalesce("to", "component").alias("component")).coalesce(parts)
        )
        ends = further.select(F.col("a").alias("b"), F.col("to").alias("d"))
        links = cut_lineage(
            links.join(further, "a").join(ends, "b").select(F.least("to", "d").alias("a"), F.greatest("to", "d").alias("b")).where("a <> b").distinct().coalesce(parts)
        )
        rows = links.count()
    return labels
