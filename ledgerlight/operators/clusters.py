"""Agent profiles and distance to the nearest cluster centre.

Clustering is Lloyd's method on whole numbers, so that a run gives the same centres whatever the partitioning: features are
scaled to their range and kept in millionths, sums of them are exact, and only centres (``k`` rows) leave the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ["calls_per_day", "denied_share", "held_share", "tools"]
SCALE = 1_000_000


def agent_profiles(calls: DataFrame) -> DataFrame:
    counted = calls.groupBy("agent_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("day").alias("days"),
        F.count_if(F.col("status") == "DENIED").alias("denied"),
        F.count_if(F.col("hitl_decision").isNotNull()).alias("held"),
        F.count_distinct("tool").cast("double").alias("tools"),
    )
    return counted.select(
        "agent_id",
        F.round(F.col("n") / F.col("days"), 6).alias("calls_per_day"),
        F.round(F.col("denied") / F.col("n"), 6).alias("denied_share"),
        F.round(F.col("held") / F.col("n"), 6).alias("held_share"),
        "tools",
    )


def scaled(profiles: DataFrame, features: list[str]) -> DataFrame:
    """Each feature as a place in its range, 0 to 1 in millionths; 0 where the range is empty or the value null."""
    ranges = profiles.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in features for f in (F.min, F.max)]).first()
    columns = {}
    for c in features:
        low, high = ranges[f"min_{c}"], ranges[f"max_{c}"]
        if low is None or low == high:
            columns[f"x_{c}"] = F.lit(0).cast("bigint")
        else:
            place = (F.col(c) - F.lit(float(low))) / F.lit(float(high) - float(low))
            columns[f"x_{c}"] = F.coalesce(F.floor(place * SCALE + 0.5), F.lit(0)).cast("bigint")
    return profiles.withColumns(columns)


def squared_gap(features: list[str], centre: list[int]) -> Column:
    gap = F.lit(0).cast("bigint")
    for c, at in zip(features, centre):
        gap = gap + (F.col(f"x_{c}") - F.lit(at).cast("bigint")) * (F.col(f"x_{c}") - F.lit(at).cast("bigint"))
    return gap


def nearest(features: list[str], centres: list[list[int]]) -> Column:
    """(squared gap, number) of the nearest centre; the lowest number wins a tie."""
    return F.array_min(F.array(*[F.struct(squared_gap(features, c).alias("gap"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)]))


def first_centres(points: DataFrame, features: list[str], k: int) -> list[list[int]]:
    """Farthest-first starts: the point nearest the origin, then always the one farthest from all centres; ties by ``agent_id``."""
    names = [f"x_{c}" for c in features]
    centres: list[list[int]] = []
    for _ in range(k):
        gap = squared_gap(features, [0] * len(features)) if not centres else -nearest(features, centres)["gap"]
        best = points.agg(F.min(F.struct(gap.alias("gap"), F.col("agent_id"), *names)).alias("p")).first()["p"]
        if best is None or (centres and best["gap"] == 0):
            break
        centres.append([best[n] for n in names])
    return centres


def lloyd(points: DataFrame, features: list[str], centres: list[list[int]], rounds: int) -> list[list[int]]:
    """Centres after at most ``rounds`` rounds; each round is one aggregate, and a centre without points stays."""
    for _ in range(rounds):
        means = [F.floor(F.sum(f"x_{c}") / F.count("*") + 0.5).cast("bigint").alias(f"x_{c}") for c in features]
        rows = points.groupBy(nearest(features, centres)["cluster"].alias("cluster")).agg(*means).collect()  # k rows
        moved = list(centres)
        for row in rows:
            moved[row["cluster"]] = [row[f"x_{c}"] for c in features]
        if moved == centres:
            break
        centres = moved
    return centres


def cluster_outliers(
    profiles: DataFrame, k: int = 4, rounds: int = 10, deviations: float = 2.0, features: list[str] | None = None
) -> DataFrame:
    """Distance of each agent to the nearest of at most ``k`` centres, in units of the scaled ranges.

    An outlier lies farther out than the mean distance of its own cluster by more than ``deviations`` standard deviations.
    Starts, ties and sums are fixed, so reruns agree; fewer distinct profiles than ``k`` give fewer clusters, no profiles
    give no rows.
    """
    features = features or FEATURES
    points = scaled(profiles, features)
    centres = lloyd(points, features, first_centres(points, features, k), rounds)
    if not centres:
        return points.select("agent_id", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance"), F.lit(False).alias("is_outlier"))
    placed = points.withColumn("_near", nearest(features, centres)).select(
        "agent_id", F.col("_near.cluster").alias("cluster"), F.round(F.sqrt(F.col("_near.gap").cast("double")) / SCALE, 6).alias("distance")
    )
    # Sums of whole millionths, so the order of rows can't change a mean; squares as decimals, as they pass 64 bits.
    millionths = F.round(F.col("distance") * SCALE).cast("bigint")
    squares = millionths.cast("decimal(20,0)") * millionths.cast("decimal(20,0)")
    spread = placed.groupBy("cluster").agg(
        F.count("*").cast("double").alias("_n"), F.sum(millionths).cast("double").alias("_s"), F.sum(squares).cast("double").alias("_q")
    )
    mean = F.col("_s") / F.col("_n")
    deviation = F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0)))
    limit = F.round((mean + F.lit(float(deviations)) * deviation) / SCALE, 6)
    joined = placed.join(F.broadcast(spread.select("cluster", limit.alias("_limit"))), "cluster")  # k rows
    return joined.select("agent_id", "cluster", "distance", (F.col("distance") > F.col("_limit")).alias("is_outlier"))
