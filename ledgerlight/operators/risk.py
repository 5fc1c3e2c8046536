"""Session features, risk, anomaly flags, routing, incidents and review evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.frames import DAY, MINUTE, framed_sums, last_rows, row_positions, sums_to_date, trailing_sums
from ledgerlight.operators.audit import DECISION_STATUSES

# Thresholds of the anomaly and incident rules and of the routing.
MIN_PRIOR_WINDOWS = 3
ZSCORE_FLAG, ZSCORE_HIGH = 3.0, 5.0
DENIALS_FLAG, DENIALS_HIGH = 3, 5
RISK_ROUTE, RISK_INCIDENT = 0.5, 0.8
RECENT_CALLS = 20


def is_decision() -> Column:
    return F.col("status").isin(DECISION_STATUSES) & F.col("parent_id").isNull()


def rate_buckets(
    rows: DataFrame, keys: list[str] | None = None, bucket_us: int = 5 * MINUTE, buckets: int = 12
) -> DataFrame:
    """Counts of the last ``buckets`` disjoint time slices looking back from each row, newest first.

    A slice is half-open and the newest one ends just after the row, so the row
    counts itself.
    """
    frames = {
        f"_b{i}": (F.lit(1), 1 - bucket_us * (i + 1), -bucket_us * i) for i in range(buckets)
    }
    counted = trailing_sums(rows, keys or ["agent_id"], "ts", frames)
    return counted.withColumn("rate_buckets", F.array(*frames)).drop(*frames)


def rate_zscore(buckets: Column) -> Column:
    """(newest - mean of the others) / sample deviation; null with too little or constant history."""
    prior = F.slice(buckets, 2, F.greatest(F.size(buckets) - 1, F.lit(0)))
    n = F.size(prior)
    mean = F.aggregate(prior, F.lit(0.0), lambda acc, x: acc + x) / n
    # The mean is carried in the accumulator, so it is computed once per row.
    spread = F.aggregate(
        prior, F.struct(mean.alias("mean"), F.lit(0.0).alias("ss")),
        lambda acc, x: F.struct(acc["mean"].alias("mean"), (acc["ss"] + (x - acc["mean"]) * (x - acc["mean"])).alias("ss")),
    )
    deviation = F.sqrt(spread["ss"] / (n - 1))
    usable = (n >= MIN_PRIOR_WINDOWS) & (deviation > 0)
    return F.when(usable, F.try_divide(F.element_at(buckets, 1) - spread["mean"], deviation))


def recent_denials(rows: DataFrame, window_us: int = 15 * MINUTE, name: str = "denials_recent") -> DataFrame:
    denied = F.when(F.col("status") == "DENIED", 1).otherwise(0)
    return trailing_sums(rows, ["agent_id"], "ts", {name: (denied, -window_us, 0)})


def session_features(rows: DataFrame, minute_us: int = MINUTE) -> DataFrame:
    """Per row, over its session so far: calls in the last minute, calls, tools, holds and denials."""
    return framed_sums(
        rows,
        ["session_id"],
        "ts",
        trailing={"calls_per_minute": (F.lit(1), -minute_us, 0)},
        to_date={
            "total_calls": F.lit(1),
            "hitl_ticket_count": F.when(F.col("status") == "HELD", 1).otherwise(0),
            "denial_count": F.when(F.col("status") == "DENIED", 1).otherwise(0),
        },
        distinct_to_date={"unique_tools_count": "tool"},
    )


def session_risk() -> Column:
    score = (
        0.05 * F.col("calls_per_minute")
        + 0.3 * F.least("denial_count", F.lit(3))
        + 0.2 * F.least("hitl_ticket_count", F.lit(3))
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def session_totals(rows: DataFrame) -> DataFrame:
    """The same counts per whole session."""
    return rows.groupBy("session_id").agg(
        F.count("*").alias("total_calls"),
        F.count_distinct("tool").alias("unique_tools_count"),
        F.count_if(F.col("status") == "HELD").alias("hitl_ticket_count"),
        F.count_if(F.col("status") == "DENIED").alias("denial_count"),
    )


def risk_snapshots(audit: DataFrame, minute_us: int = MINUTE) -> DataFrame:
    """Features and risk of every decision event."""
    return session_features(audit, minute_us).filter(is_decision()).withColumn("risk_score", session_risk())


def risk_histogram(snapshots: DataFrame) -> DataFrame:
    risk = F.col("risk_score")
    bucket = (
        F.when(risk < 0.2, "0.0-0.2").when(risk < 0.4, "0.2-0.4").when(risk < 0.6, "0.4-0.6").when(risk < 0.8, "0.6-0.8").otherwise("0.8-1.0")
    )
    return snapshots.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("value"))


def detect(zscore: Column, denials: Column) -> tuple[Column, Column]:
    """(type, severity): a rate spike is looked for before repeated denials."""
    spike = F.coalesce(F.abs(zscore) > ZSCORE_FLAG, F.lit(False))
    repeated = denials >= DENIALS_FLAG
    kind = F.when(spike, "rate_spike").when(repeated, "repeated_denials")
    severity = (
        F.when(spike & (F.abs(zscore) >= ZSCORE_HIGH), "high")
        .when(spike, "med")
        .when(repeated & (denials >= DENIALS_HIGH), "high")
        .when(repeated, "med")
    )
    return kind, severity


def anomaly_signals(audit: DataFrame, bucket_us: int = 5 * MINUTE, denial_us: int = 15 * MINUTE) -> DataFrame:
    """Rate slices, z-score and recent denials of every decision event, in one window pass per agent."""
    denied = F.when(F.col("status") == "DENIED", 1).otherwise(0)
    frames = {f"_b{i}": (F.lit(1), 1 - bucket_us * (i + 1), -bucket_us * i) for i in range(12)}
    frames["denials_recent"] = (denied, -denial_us, 0)
    counted = trailing_sums(audit, ["agent_id"], "ts", frames).filter(is_decision())
    sliced = counted.withColumn("rate_buckets", F.array(*[f"_b{i}" for i in range(12)])).drop(*[f"_b{i}" for i in range(12)])
    return sliced.withColumn("zscore", F.round(rate_zscore(F.col("rate_buckets")), 4))


def anomaly_flags(events: DataFrame) -> DataFrame:
    """Flags of the assessed events whose route has an anomaly step."""
    return events.filter(F.contains("path", F.lit("anomaly")) & F.col("anomaly_type").isNotNull())


def signal_flags(signals: DataFrame) -> DataFrame:
    """Flags that the signals of every decision would raise, whatever its route."""
    kind, severity = detect(F.col("zscore"), F.col("denials_recent"))
    return signals.withColumn("anomaly_type", kind).withColumn("anomaly_severity", severity).filter("anomaly_type IS NOT NULL")


def route() -> Column:
    """Which steps an event goes through; needs outcome, risk_score and anomaly_severity."""
    high = F.coalesce(F.col("anomaly_severity") == "high", F.lit(False))
    return (
        F.when(F.col("outcome") == "DENY", "escalate")
        .when(F.col("outcome") == "HOLD", "enrich>evidence")
        .when((F.col("outcome") == "PASS") & (F.col("risk_score") > RISK_ROUTE) & high, "enrich>anomaly>escalate")
        .when((F.col("outcome") == "PASS") & (F.col("risk_score") > RISK_ROUTE), "enrich>anomaly")
        .otherwise("enrich")
    )


def assessed_events(
    audit: DataFrame, bucket_us: int = 5 * MINUTE, denial_us: int = 15 * MINUTE, minute_us: int = MINUTE
) -> DataFrame:
    """Decision events with features, risk, anomaly and route."""
    risk = risk_snapshots(audit, minute_us)
    signals = anomaly_signals(audit, bucket_us, denial_us).select("id", "rate_buckets", "zscore", "denials_recent")
    kind, severity = detect(F.col("zscore"), F.col("denials_recent"))
    joined = risk.join(signals, "id").withColumn("anomaly_type", kind).withColumn("anomaly_severity", severity)
    return joined.withColumn("path", route())


def promotion_rule(single_sanctions_denial: bool = False) -> Column:
    first = F.when(F.col("denials_recent") >= DENIALS_FLAG, "repeated_denials")
    rule = first.when(F.coalesce(F.col("anomaly_severity") == "high", F.lit(False)), "high_severity_anomaly").when(
        (F.col("outcome") == "HOLD") & (F.col("risk_score") > RISK_INCIDENT), "high_risk_pending_hitl"
    )
    if single_sanctions_denial:
        rule = rule.when((F.col("outcome") == "DENY") & (F.col("server") == "ofac-sanctions"), "sanctions_denial")
    return rule


def incident_severity() -> Column:
    high = F.coalesce(F.col("anomaly_severity") == "high", F.lit(False))
    return F.when(F.col("promotion_rule").isin("high_severity_anomaly", "high_risk_pending_hitl") | high, "high").otherwise("med")


def incidents(events: DataFrame, all_paths: bool = False, single_sanctions_denial: bool = False) -> DataFrame:
    """Events promoted to incidents, with the fallback text and response.

    Only events routed to escalation count unless ``all_paths``. On the direct
    route of a denial no anomaly was looked for, so none is taken into account.
    """
    seen = events.withColumn(
        "anomaly_severity",
        F.when(F.lit(all_paths) | F.col("path").contains("anomaly"), F.col("anomaly_severity")),
    )
    if not all_paths:
        seen = seen.filter(F.col("path").endswith("escalate"))
    # The fallback text.
    text = F.concat(
        F.lit("Incident promoted under rule '"), F.col("promotion_rule"), F.lit("' for agent "), F.col("agent_id"),
        F.lit(" on "), F.col("server"), F.lit("/"), F.col("tool"), F.lit("; manual review required."),
    )
    return (
        seen.withColumn("promotion_rule", promotion_rule(single_sanctions_denial))
        .filter("promotion_rule IS NOT NULL")
        .withColumn("severity", incident_severity())
        .withColumn("narrative", text)
        .withColumn("recommended_response", F.lit("investigate"))
    )


def recent_incidents(found: DataFrame, as_of: str, days: int = 30, n: int = 50) -> DataFrame:
    return recent(found, "ts", as_of, days).orderBy(F.desc("ts"), F.desc("id")).limit(n)


def recent(df: DataFrame, ts: str, as_of: str, days: int = 30) -> DataFrame:
    """Rows of the last ``days`` before ``as_of``, which is a parameter and never the clock."""
    return df.filter(F.col(ts) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def flags_by_severity(flags: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return recent(flags, "ts", as_of, days).groupBy(F.col("anomaly_severity").alias("severity")).agg(F.count("*").alias("value"))


def prior_reviews(audit: DataFrame) -> DataFrame:
    decided = audit.filter("hitl_decision IS NOT NULL")
    return decided.groupBy("agent_id", "tool", "hitl_decision").agg(F.count("*").alias("decisions"))


def recent_calls(audit: DataFrame, n: int = RECENT_CALLS) -> DataFrame:
    """Last ``n`` rows of each session; the row-number limit is applied before the shuffle too."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("id"))
    return audit.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= n)


def evidence_packets(audit: DataFrame, minute_us: int = MINUTE) -> DataFrame:
    """Review packet of every held call: recent calls, earlier decisions, risk, rules and fallback text."""
    placed = row_positions(audit, ["session_id"], "ts", "id")
    item = F.concat_ws(":", "tool", "status")
    traced = last_rows(
        placed.select("id", "session_id", "tool", "status", "parent_id", "position"), ["session_id"], "position", item, RECENT_CALLS, "recent_calls"
    ).filter("status = 'HELD'").select("id", "recent_calls")
    decided = sums_to_date(
        audit.select("id", "agent_id", "tool", "ts", "hitl_decision", "status"),
        ["agent_id", "tool"],
        "ts",
        {
            "prior_approved": F.when(F.col("hitl_decision") == "APPROVED", 1).otherwise(0),
            "prior_denied": F.when(F.col("hitl_decision") == "DENIED", 1).otherwise(0),
        },
        bucket_us=DAY,
    ).filter("status = 'HELD'").select("id", "prior_approved", "prior_denied")
    held = risk_snapshots(audit, minute_us).filter("status = 'HELD'")
    # The fallback text.
    text = F.concat(
        F.lit("HITL hold on "), F.col("tool"), F.lit(" ("), F.col("server"), F.lit(") for agent "), F.col("agent_id"),
        F.lit(", fired policy '"), F.col("fired_policy"),
        F.lit("'; manual review required with no automated recommendation."),
    )
    return (
        held.join(traced, "id")
        .join(decided, "id")
        .withColumn("narrative", text)
        .withColumn("recommended_action", F.lit("escalate"))
        .withColumn("confidence", F.lit(0.0))
    )


def checks_then_write(
    calls: DataFrame, min_checks: int = 5, check_us: int = MINUTE, follow_us: int = MINUTE
) -> DataFrame:
    """Write calls with a burst of sanctions checks by the same agent shortly before.

    A burst is ``min_checks`` checks within ``check_us``; the write must follow
    within ``follow_us`` of a check that completes a burst.
    """
    check = F.col("tool").isin("check_entity", "check_alias")
    write = F.col("tool") == "mark_investigated"
    relevant = calls.filter(check | write)
    bursts = trailing_sums(relevant, ["agent_id"], "ts", {"checks_before": (F.when(check, 1).otherwise(0), -check_us, 0)})
    full = F.when(check & (F.col("checks_before") >= min_checks), 1).otherwise(0)
    return trailing_sums(bursts, ["agent_id"], "ts", {"bursts_before": (full, -follow_us, 0)}).filter(
        write & (F.col("bursts_before") > 0)
    )


def usage_ratios(calls: DataFrame) -> DataFrame:
    """Per session: read/write ratio and share of sanctions checks."""
    write = F.col("tool") == "mark_investigated"
    counted = calls.groupBy("session_id").agg(
        F.count_if(~write).alias("reads"), F.count_if(write).alias("writes"),
        F.count_if(F.col("server") == "ofac-sanctions").alias("checks"), F.count("*").alias("n"),
    )
    return counted.select(
        "session_id", "reads", "writes",
        F.round(F.try_divide("reads", "writes"), 4).alias("read_write_ratio"),
        F.round(F.col("checks") / F.col("n"), 4).alias("sanctions_share"),
    )


def tool_baseline_zscores(calls: DataFrame) -> DataFrame:
    """Per agent, tool and day: calls against that agent's and tool's own daily mean."""
    daily = calls.groupBy("agent_id", "tool", "day").agg(F.count("*").alias("calls"))
    base = daily.groupBy("agent_id", "tool").agg(
        F.avg("calls").alias("mean"), F.stddev_samp("calls").alias("deviation")
    )
    return daily.join(base, ["agent_id", "tool"]).select(
        "agent_id", "tool", "day", "calls",
        F.when(F.col("deviation") > 0, F.round((F.col("calls") - F.col("mean")) / F.col("deviation"), 3)).alias("zscore"),
    )
