"""Transfer-graph operators and batch triage of alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.frames import DAY, trailing_sums
from ledgerlight.operators.adjacency import Adjacency, sides, touching
from ledgerlight.operators.telemetry import money, units
from ledgerlight.session import cut_lineage

# Structuring threshold and count, hop limit, edge and neighbour caps.
SMALL_DEPOSIT = 10_000.0
MIN_DEPOSITS = 3
MAX_HOPS = 3
MAX_EDGES = 500
MAX_NEIGHBOURS = 25
# Disposition for each risk level.
DISPOSITION = {"high": "escalate", "medium": "monitor", "low": "cleared"}


def account_transfers(transfers: DataFrame, account_id: str, first_day: str, last_day: str) -> DataFrame:
    inside = (F.col("ts") >= F.lit(first_day).cast("timestamp")) & (
        F.col("ts") < F.lit(last_day).cast("timestamp") + F.expr("INTERVAL 1 DAY")
    )
    mine = (F.col("from_id") == account_id) | (F.col("to_id") == account_id)
    return transfers.filter(mine & inside).orderBy("ts", "from_id", "to_id", "amount_paid")


def endpoints(transfers: DataFrame) -> DataFrame:
    """Every account that sends or receives; each side is de-duplicated map-side before the shuffle."""
    ends = transfers.select(F.explode(F.array("from_id", "to_id")).alias("account_id"))
    return ends.distinct()


def account_summary(transfers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Totals per account; accounts without transfers keep zeros.

    Aggregating by (account, counterparty) first makes the distinct count a plain
    count and splits a hub over all its counterparties.
    """
    return summed_sides(sides(transfers), accounts)


def summed_sides(found: DataFrame, accounts: DataFrame) -> DataFrame:
    """:func:`account_summary` from the sides of the transfers."""
    by_pair = found.groupBy("account_id", "other").agg(
        F.count("*").alias("n"),
        F.sum(units("sent")).alias("sent"),
        F.sum(units("received")).alias("received"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )
    totals = by_pair.groupBy("account_id").agg(
        F.sum("n").alias("total_transactions"),
        (F.sum("sent") / 100).alias("total_sent"),
        (F.sum("received") / 100).alias("total_received"),
        F.count("*").alias("distinct_counterparties"),
        F.min("first").alias("first_activity"),
        F.max("last").alias("last_activity"),
    )
    return accounts.join(totals, "account_id", "left").fillna(
        0, ["total_transactions", "total_sent", "total_received", "distinct_counterparties"]
    )


def edge_totals(transfers: DataFrame) -> DataFrame:
    return transfers.groupBy("from_id", "to_id").agg(
        money("amount_paid").alias("total_amount"), F.count("*").alias("transaction_count")
    )


def both_ends_in(transfers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Transfers whose two ends are both in the set; AQE broadcasts the set only if it is small."""
    left = accounts.select(F.col("account_id").alias("from_id"))
    right = accounts.select(F.col("account_id").alias("to_id"))
    return transfers.join(left, "from_id", "left_semi").join(right, "to_id", "left_semi")


def accounts_in_sample(accounts: DataFrame, sample: DataFrame) -> DataFrame:
    return accounts.join(sample, "account_id", "left_semi")


def subgraph(transfers: DataFrame, accounts: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """Largest edges inside a set; ``truncated`` tells whether one more existed."""
    edges = edge_totals(both_ends_in(transfers, accounts))
    top = edges.orderBy(F.desc("total_amount"), "from_id", "to_id").limit(max_edges + 1)
    order = Window.orderBy(F.desc("total_amount"), "from_id", "to_id")  # at most max_edges + 1 rows
    return (
        top.withColumn("place", F.row_number().over(order))
        .withColumn("truncated", F.max("place").over(Window.partitionBy()) > max_edges)
        .filter(F.col("place") <= max_edges)
    )


def k_hop(
    transfers: DataFrame | Adjacency, seeds: DataFrame, hops: int, min_amount: float = 0.0, max_hops: int = MAX_HOPS
) -> DataFrame:
    """Breadth-first neighbourhood of each seed: first hop reached, amount and transfers of that hop.

    ``seeds(seed_id)``. An edge between two frontier accounts leads to an account
    already visited and so adds nothing. Every frontier is written as a table, so its
    size is known when the next hop is planned: transfers that touch none of its accounts are
    dropped where they are read, and only the others are grouped. An adjacency table reads the frontier's
    buckets alone. Too small transfers are dropped before the two sides are made, as Spark moves no filter
    below that step: so they are not shuffled either where the transfers are themselves a join.
    """
    if not 1 <= hops <= max_hops:
        raise ValueError(f"hops must be from 1 to {max_hops}, not {hops}; pass a larger max_hops if you mean it")
    frontier = cut_lineage(seeds.select("seed_id", F.col("seed_id").alias("account_id")))
    visited = frontier
    found = None
    if not isinstance(transfers, Adjacency):
        transfers = transfers.filter((F.greatest("amount_paid", "amount_received") >= min_amount) & (F.col("from_id") != F.col("to_id")))
    for hop in range(1, hops + 1):
        kept = touching(transfers, frontier).filter((F.col("largest") >= min_amount) & (F.col("account_id") != F.col("other")))
        edges = kept.groupBy("account_id", "other").agg(
            F.sum(units("sent") + units("received")).alias("amount"), F.count("*").alias("n")
        )
        reached = (
            frontier.join(edges, "account_id")
            .groupBy("seed_id", F.col("other").alias("account_id"))
            .agg((F.sum("amount") / 100).alias("total_amount"), F.sum("n").alias("transaction_count"))
            .join(visited, ["seed_id", "account_id"], "left_anti")
            .withColumn("hop", F.lit(hop))
        )
        if hop < hops:
            reached = cut_lineage(reached)
        found = reached if found is None else found.unionByName(reached)
        frontier = reached.select("seed_id", "account_id")
        visited = visited.unionByName(frontier)
    return found


def structuring_check(
    transfers: DataFrame,
    window_days: int = 30,
    threshold: float = SMALL_DEPOSIT,
    min_deposits: int = MIN_DEPOSITS,
    accounts: DataFrame | None = None,
) -> DataFrame:
    """Small deposits in the days before each account's own last deposit, flagged or not, with the reason.

    With ``accounts``, those that never received anything are reported too.
    """
    last = transfers.groupBy("to_id").agg(F.max("ts").alias("max_ts"))
    if accounts is not None:
        last = accounts.select(F.col("account_id").alias("to_id")).join(last, "to_id", "left")
    small = transfers.filter(F.col("amount_received") < threshold).select("to_id", "ts", "amount_received")
    # Days are summed before the join on the account, so a hub sends one row per
    # instant and not one per deposit.
    grouped = small.groupBy("to_id", "ts").agg(
        F.count("*").alias("n"), F.sum(units("amount_received")).alias("amount")
    )
    inside = (F.col("ts") > F.col("max_ts") - F.make_dt_interval(F.lit(window_days))) & (F.col("ts") <= F.col("max_ts"))
    counted = (
        last.join(grouped, "to_id", "left")
        .groupBy("to_id", "max_ts")
        .agg(
            F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("deposit_count"),
            (F.coalesce(F.sum(F.when(inside, F.col("amount"))), F.lit(0)) / 100).alias("total_deposits"),
        )
    )
    flagged = (F.col("deposit_count") >= min_deposits) & (F.col("total_deposits") >= threshold)
    return counted.select(
        F.col("to_id").alias("account_id"),
        F.lit(window_days).alias("window_days"),
        F.lit(threshold).alias("threshold_amount"),
        "deposit_count",
        "total_deposits",
        flagged.alias("flagged"),
        structuring_text(F.col("max_ts"), flagged, window_days, threshold, min_deposits).alias("rationale"),
    )


def structuring_text(max_ts: Column, flagged: Column, window_days: int, threshold: float, min_deposits: int) -> Column:
    # The three texts.
    count = F.col("deposit_count").cast("string")
    total = F.format_number("total_deposits", 2)
    return (
        F.when(max_ts.isNull(), "no deposits found for this account")
        .when(
            flagged,
            F.concat(
                count, F.lit(f" deposits under {threshold:,.0f} totaling "), total,
                F.lit(f" within the trailing {window_days} days -- classic structuring signature"),
            ),
        )
        .otherwise(
            F.concat(
                count, F.lit(" sub-threshold deposits totaling "), total,
                F.lit(f" within the trailing {window_days} days -- below the {min_deposits}-deposit / {threshold:,.0f} alert bar"),
            )
        )
    )


def rolling_structuring(
    transfers: DataFrame, window_days: int = 30, threshold: float = SMALL_DEPOSIT, min_deposits: int = MIN_DEPOSITS
) -> DataFrame:
    """The same rule evaluated at every instant an account receives something."""
    small = F.col("amount_received") < threshold
    cents = units("amount_received")
    instants = transfers.groupBy(F.col("to_id").alias("account_id"), "ts").agg(
        F.count_if(small).alias("n"), F.sum(F.when(small, cents).otherwise(0)).alias("cents")
    )
    reach = -(window_days * DAY - 1)
    summed = trailing_sums(
        instants, ["account_id"], "ts", {"deposit_count": (F.col("n"), reach, 0), "deposit_cents": (F.col("cents"), reach, 0)}
    )
    total = F.col("deposit_cents") / 100
    return summed.select(
        "account_id", "ts", "deposit_count", total.alias("total_deposits"),
        ((F.col("deposit_count") >= min_deposits) & (total >= threshold)).alias("flagged"),
    )


def latest_disposition(log: DataFrame) -> DataFrame:
    """Last write per account from an append-only log."""
    kept = F.max(F.struct("recorded_at", "disposition", "rationale"))
    return log.groupBy("account_id").agg(kept.alias("w")).select("account_id", "w.disposition", "w.rationale", "w.recorded_at")


def account_labels(transfers: DataFrame) -> DataFrame:
    return endpoints(transfers.filter("is_laundering = 1")).withColumn("is_laundering", F.lit(1))


def orphan_edges(transfers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Transfers with an end that has no account row, and which end."""
    ends = transfers.select("from_id", "to_id").distinct()
    left = ends.join(accounts.select(F.col("account_id").alias("from_id")), "from_id", "left_anti").withColumn("missing_end", F.lit("from"))
    right = ends.join(accounts.select(F.col("account_id").alias("to_id")), "to_id", "left_anti").withColumn("missing_end", F.lit("to"))
    return left.unionByName(right)


def broken_patterns(patterns: DataFrame, accounts: DataFrame) -> DataFrame:
    """Patterns with an account outside the set, one row per missing account."""
    members = patterns.select("pattern_id", "typology", F.explode(F.array("from_id", "to_id")).alias("account_id")).distinct()
    return members.join(accounts, "account_id", "left_anti")


def pattern_connectivity(patterns: DataFrame, accounts: DataFrame) -> DataFrame:
    """Patterns checked and fully kept."""
    inside = accounts.select("account_id", F.lit(1).alias("_in"))
    members = patterns.select("pattern_id", F.explode(F.array("from_id", "to_id")).alias("account_id")).distinct()
    whole = members.join(inside, "account_id", "left").groupBy("pattern_id").agg(F.bool_and(F.col("_in").isNotNull()).alias("kept"))
    return whole.agg(F.count("*").alias("checked"), F.count_if("kept").alias("fully_preserved"))


# ---- label-preserving subsample ------------------------------------------------------------------


def remaining_pool(universe: DataFrame, included: DataFrame) -> DataFrame:
    return universe.join(included, "account_id", "left_anti")


def _draw(seed: int) -> Column:
    return F.sha2(F.concat(F.col("account_id"), F.lit(f"|{seed}")), 256)


def first_by_hash(pool: DataFrame, n: int, seed: int, taken: DataFrame | None = None) -> DataFrame:
    """The first ``n`` accounts in keyed-hash order, less those already ``taken``.

    A keyed hash gives the same rows whatever the partitioning. Counts per
    four-digit hash prefix (65 536 rows at most) tell which prefixes are wholly in
    or out, so rows are only ranked inside their own prefix and nothing is sorted
    in one place, however large ``n`` is.
    """
    drawn = pool.select("account_id", _draw(seed).alias("_d")).withColumn("_p", F.substring("_d", 1, 4))
    counts = drawn.groupBy("_p").agg(F.count("*").alias("_n"))
    if taken is not None:
        counts = counts.unionByName(taken.agg(F.count("*").alias("_n")).withColumn("_p", F.lit("")))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c")).filter(F.col("_c") < n)
    within = Window.partitionBy("_p").orderBy("_d", "account_id")
    ranked = drawn.join(carried, "_p").withColumn("_r", F.col("_c") + F.row_number().over(within))
    return ranked.filter(F.col("_r") <= n).select("account_id")


def seeded_fill(pool: DataFrame, n: int, seed: int) -> DataFrame:
    """A reproducible draw of ``n`` accounts from the pool."""
    return first_by_hash(pool, n, seed)


def sample_accounts(transfers: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """All labelled accounts, topped up to ``target`` from the others."""
    must = endpoints(transfers.filter("is_laundering = 1"))
    pool = remaining_pool(endpoints(transfers), must)
    return must.unionByName(first_by_hash(pool, target, seed, taken=must))


def subsample(transfers: DataFrame, target: int, seed: int = 42) -> DataFrame:
    return both_ends_in(transfers, sample_accounts(transfers, target, seed))


def sample_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts and label ratios before and after, and whether every labelled row was kept."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("total"), F.count_if(F.col("is_laundering") == 1).alias("labelled")).select(
            F.lit(name).alias("side"), "total", "labelled"
        )

    both = counted(before, "raw").unionByName(counted(after, "sampled"))
    return both.select(
        "side", "total", "labelled", F.round(F.coalesce(F.try_divide("labelled", "total"), F.lit(0.0)) * 100, 4).alias("ratio_pct")
    )


def assert_labels_kept(stats: DataFrame) -> DataFrame:
    """Fail if a labelled transfer was lost."""
    kept = stats.groupBy().pivot("side", ["raw", "sampled"]).agg(F.first("labelled"))
    message = F.lit("labelled transfers were lost in the sample")
    return kept.select(F.when(F.col("raw") == F.col("sampled"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")).alias("kept"))


# ---- investigations, for all alerts at once ------------------------------------------------------


def seed_alert(transfers: DataFrame, seed: int = 42) -> DataFrame:
    """One labelled transfer, chosen by hash order with offset ``seed % total``."""
    labelled = transfers.filter("is_laundering = 1")
    total = labelled.count()
    if total == 0:
        raise ValueError("no labelled transfer to start from")
    key = F.md5(F.concat("from_id", "to_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    offset = seed % total
    picked = labelled.withColumn("_draw", key).orderBy("_draw", "amount_paid").offset(offset).limit(1)
    return picked.select(
        F.col("from_id").alias("account_id"),
        F.lit("SUSPICIOUS_WIRE").alias("alert_type"),
        F.concat(
            F.lit("Wire activity between "), "from_id", F.lit(" and "), "to_id",
            F.lit(" flagged as laundering in the labeled dataset."),
        ).alias("narrative_hint"),
    )


def cap_neighbours(neighbours: DataFrame, n: int | None = MAX_NEIGHBOURS) -> DataFrame:
    """At most ``n`` neighbours per seed, largest total first (the cap is part of the feature); None keeps all."""
    order = Window.partitionBy("seed_id").orderBy(F.desc("total_amount"), "account_id")
    placed = neighbours.withColumn("place", F.row_number().over(order))
    return placed if n is None else placed.filter(F.col("place") <= n)


def discover(
    alerts: DataFrame, transfers: DataFrame | Adjacency, accounts: DataFrame, screened: DataFrame
) -> DataFrame:
    """Account summary and screening result for every alert; its counterparties are ``distinct_counterparties``.

    ``screened(query, matched_name, entry_id, score, is_match)`` comes from screening
    the account names as type ``entity``. Only transfers of the alerts' accounts are grouped.
    """
    alerts = cut_lineage(alerts)
    summary = summed_sides(touching(transfers, alerts), accounts.join(alerts.select("account_id"), "account_id", "left_semi"))
    return (
        alerts.join(summary, "account_id", "left")
        .join(screened.drop("sdn_type", "reference_url"), F.col("entity_name") == F.col("query"), "left")
        .drop("query")
    )


def alert_transfers(alerts: DataFrame, transfers: DataFrame | Adjacency, first_day: str, last_day: str) -> DataFrame:
    """Every transfer of each alert's account from the first day to the last, as a row, both days whole."""
    inside = (F.col("ts") >= F.lit(first_day).cast("timestamp")) & (
        F.col("ts") < F.lit(last_day).cast("timestamp") + F.expr("INTERVAL 1 DAY")
    )
    return touching(transfers, cut_lineage(alerts.select("account_id"))).filter(inside)


def alert_bundles(
    alerts: DataFrame,
    transfers: DataFrame | Adjacency,
    first_day: str,
    last_day: str,
    max_transfers: int = MAX_EDGES,
    max_neighbours: int = MAX_NEIGHBOURS,
) -> DataFrame:
    """One row per alerted account with its transfers and its direct neighbours.

    Totals count everything, ``transfers`` lists the latest ``max_transfers`` of the days asked for and ``neighbours`` the
    largest ``max_neighbours`` (both lists are bounded as a feature; :func:`alert_transfers` and :func:`k_hop` give all as
    rows). Places are found before the shuffle, so a hub sends no more than its lists hold. An account without transfers
    has zeros and empty lists; repeated alerts and null accounts count once, the latter without transfers.
    """
    alerts = cut_lineage(alerts.select("account_id").distinct())
    dated = alert_transfers(alerts, transfers, first_day, last_day)
    totals = dated.groupBy("account_id").agg(F.count("*").alias("transfers_total"))
    listed = ["ts", "other", "sent", "received"]
    latest = Window.partitionBy("account_id").orderBy(F.desc("ts"), "other", "sent", "received")
    lists = (
        dated.withColumn("place", F.row_number().over(latest)).filter(F.col("place") <= max_transfers)
        .groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("place", *listed))).alias("transfers"))
    )
    near = cut_lineage(k_hop(transfers, alerts.withColumnRenamed("account_id", "seed_id"), 1))
    counted = near.groupBy("seed_id").agg(F.count("*").alias("neighbours_total"))
    largest = cap_neighbours(near, max_neighbours).groupBy("seed_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "account_id", "total_amount", "transaction_count"))).alias("neighbours")
    )
    around = counted.join(largest, "seed_id", "left").withColumnRenamed("seed_id", "account_id")
    bundle = alerts.join(totals, "account_id", "left").join(lists, "account_id", "left").join(around, "account_id", "left")
    empty = {c: F.coalesce(F.col(c), F.array().cast(bundle.schema[c].dataType)) for c in ("transfers", "neighbours")}
    return bundle.fillna(0, ["transfers_total", "neighbours_total"]).withColumns(empty)


def alert_subgraphs(
    alerts: DataFrame, transfers: DataFrame, max_edges: int = MAX_EDGES, max_neighbours: int | None = MAX_NEIGHBOURS
) -> DataFrame:
    """Edges among each alert's account and its ``max_neighbours`` largest neighbours, of ``neighbours_total``.

    Members are bounded by the cap and stay rows, so the pairs of an alert's senders and receivers are
    looked up among the edges between members; no neighbour's own edges are expanded. Pairs are always shuffled:
    Spark takes them to be as small as the members' table and would gather them in the driver. Without a
    cap pairs grow with the square of the neighbours, so None is for accounts known to have few.
    """
    seeds = alerts.select(F.col("account_id").alias("seed_id"))
    reached = k_hop(transfers, seeds, 1)
    total = F.count("*").over(Window.partitionBy("seed_id"))
    near = cap_neighbours(reached.withColumn("neighbours_total", total), max_neighbours)
    near = cut_lineage(near.select("seed_id", "account_id", "neighbours_total"))
    counted = near.groupBy("seed_id").agg(F.max("neighbours_total").alias("neighbours_total"))
    members = near.select("seed_id", "account_id").unionByName(counted.select("seed_id", F.col("seed_id").alias("account_id")))
    edges = cut_lineage(edge_totals(both_ends_in(transfers, members.select("account_id").distinct())))
    senders = members.withColumnRenamed("account_id", "from_id").join(edges, "from_id", "left_semi")
    receivers = members.withColumnRenamed("account_id", "to_id").join(edges, "to_id", "left_semi")
    pairs = senders.hint("merge").join(receivers, "seed_id")
    edges = pairs.hint("merge").join(edges, ["from_id", "to_id"])
    order = Window.partitionBy("seed_id").orderBy(F.desc("total_amount"), "from_id", "to_id")
    ranked = edges.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_edges + 1)
    found = ranked.groupBy("seed_id").agg(
        F.count_if(F.col("place") <= max_edges).alias("subgraph_edges"),
        (F.sum(F.when(F.col("place") <= max_edges, units("total_amount"))) / 100).alias("subgraph_amount"),
        F.bool_or(F.col("place") > max_edges).alias("truncated"),
    )
    return found.join(counted, "seed_id")


def enrich(discovered: DataFrame, transfers: DataFrame, entries: DataFrame, window_days: int = 30, threshold: float = SMALL_DEPOSIT) -> DataFrame:
    """Add subgraph size, structuring signal, and listed details where the screening matched; the screening runs once."""
    discovered = cut_lineage(discovered)
    alerts = discovered.select("account_id")
    graph = alert_subgraphs(alerts, transfers).withColumnRenamed("seed_id", "account_id")
    signal = structuring_check(
        transfers.join(alerts.withColumnRenamed("account_id", "to_id"), "to_id", "left_semi"), window_days, threshold, accounts=alerts
    ).select("account_id", "window_days", "deposit_count", "total_deposits", "flagged", "rationale")
    details = entries.select(F.col("ent_num").alias("entry_id"), F.col("program").alias("listed_program"))
    matched = F.when(F.col("is_match"), F.col("listed_program"))
    return (
        discovered.join(graph, "account_id", "left")
        .join(signal, "account_id", "left")
        .join(details, "entry_id", "left")
        .withColumn("listed_program", matched)
    )


def assess(enriched: DataFrame) -> DataFrame:
    """Risk level and findings: a match is high, structuring medium unless already high."""
    # The finding texts.
    match = F.coalesce("is_match", F.lit(False))
    structuring = F.coalesce("flagged", F.lit(False))
    found = F.array_compact(
        F.array(
            F.when(
                match,
                F.concat(F.lit("Sanctions match: '"), "matched_name", F.lit("' (score "), F.format_number("score", 0), F.lit(")")),
            ),
            F.when(
                structuring,
                F.concat(
                    F.lit("Structuring signature: "), F.col("deposit_count").cast("string"), F.lit(" sub-threshold deposits totaling "),
                    F.regexp_replace(F.format_number("total_deposits", 2), ",", ""), F.lit(" within "), F.col("window_days").cast("string"), F.lit(" days"),
                ),
            ),
        )
    )
    none = F.array(F.lit("No sanctions match or structuring signal found in available evidence"))
    return enriched.withColumn("risk_level", F.when(match, "high").when(structuring, "medium").otherwise("low")).withColumn(
        "key_findings", F.when(F.size(found) > 0, found).otherwise(none)
    )


def disposition(risk: Column) -> Column:
    return F.when(risk == "high", DISPOSITION["high"]).when(risk == "medium", DISPOSITION["medium"]).when(risk == "low", DISPOSITION["low"])


def recommend(assessed: DataFrame, recorded_at: str) -> DataFrame:
    """Disposition per alert in the shape of the append-only disposition log."""
    return assessed.withColumn("disposition", disposition(F.col("risk_level"))).withColumn(
        "recorded_at", F.lit(recorded_at).cast("timestamp")
    )


def report(recommended: DataFrame) -> DataFrame:
    # The report texts.
    summary = F.concat(
        F.lit("Account "), "account_id", F.lit(": "), "risk_level", F.lit(" risk, recommended disposition '"), "disposition", F.lit("'."),
    )
    narrative = F.concat(F.lit("Findings: "), F.array_join("key_findings", "; "), F.lit("."))
    return recommended.select(
        "account_id", "risk_level", "disposition", summary.alias("summary"), narrative.alias("narrative"),
        F.lit("Manual review recommended (automated narrative unavailable).").alias("next_steps"),
    )
