"""Structured Streaming forms of the call-log operators.

Event time is ``ts`` with a ten-minute watermark; later rows are dropped from a
stream and show up in reconciliation against the batch tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlight.operators.audit import decision_events
from ledgerlight.operators.telemetry import SKETCH_SIZE, latency_sketch, telemetry_hourly
from ledgerlight.sources.files import replace_partitions

WATERMARK = "10 minutes"
NEVER = -(1 << 62)


def stream_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_events(audit: DataFrame) -> DataFrame:
    """Decision events of a stream of audit rows."""
    return decision_events(audit)


def stream_hourly(calls: DataFrame, watermark: str = WATERMARK, accuracy: int = 10_000) -> DataFrame:
    percentiles = [
        F.percentile_approx("latency_ms", q, accuracy).alias(f"latency_p{int(q * 100)}_ms") for q in (0.50, 0.95, 0.99)
    ]
    return (
        calls.withWatermark("ts", watermark)
        .groupBy(F.window("ts", "1 hour").alias("w"), "server", "tool", F.col("status").alias("outcome"))
        .agg(
            F.count("*").alias("call_count"),
            F.count_if(F.col("status") == "UPSTREAM_ERROR").alias("error_count"),
            *percentiles,
        )
        .select(F.col("w.start").alias("hour"), "*")
        .drop("w")
    )


def stream_hourly_sketches(calls: DataFrame, watermark: str = WATERMARK, k: int = SKETCH_SIZE) -> DataFrame:
    """``hourly_sketches`` as a stream; its output merges with that of batch runs."""
    return (
        calls.withWatermark("ts", watermark)
        .groupBy(F.window("ts", "1 hour").alias("w"), "server", "tool", F.col("status").alias("outcome"))
        .agg(F.count("*").alias("call_count"), F.count_if(F.col("status") == "UPSTREAM_ERROR").alias("error_count"), latency_sketch(k))
        .select(F.col("w.start").alias("hour"), "*")
        .drop("w")
    )


def stream_call_rate(calls: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    counted = calls.withWatermark("ts", watermark).groupBy(F.window("ts", "5 minutes").alias("w"), "agent_id")
    return counted.agg(F.count("*").alias("calls")).select(F.col("w.start").alias("window_start"), "agent_id", "calls")


def stream_denials(
    calls: DataFrame, least: int = 3, length: str = "15 minutes", slide: str = "1 minute", watermark: str = WATERMARK
) -> DataFrame:
    """Agents with repeated denials per sliding window; the slide is the granularity of the batch form's range."""
    denied = calls.filter("status = 'DENIED'").withWatermark("ts", watermark)
    counted = denied.groupBy(F.window("ts", length, slide).alias("w"), "agent_id").agg(F.count("*").alias("denials"))
    return counted.filter(F.col("denials") >= least).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "agent_id", "denials"
    )


def stream_dedup(calls: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """A re-delivered row of the same trace and span is dropped within the watermark."""
    return calls.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["trace_id", "span_id"])


def stream_review_timeout(
    held: DataFrame, decisions: DataFrame, timeout_seconds: int = 3600, watermark: str = WATERMARK
) -> DataFrame:
    """Held calls with the decision that came in time, or null once the watermark has passed the deadline.

    ``held(id, ts, agent_id)`` and ``decisions(ticket_id, decided_at, decision)``.
    """
    left = held.withWatermark("ts", watermark)
    right = decisions.withWatermark("decided_at", watermark)
    in_time = F.expr(
        f"id = ticket_id AND decided_at >= ts AND decided_at <= ts + INTERVAL {timeout_seconds} SECONDS"
    )
    return left.join(right, in_time, "left_outer").select(
        "id", "ts", "agent_id", "decision",
        F.when(F.col("decision").isNull(), "hitl_timeout").alias("reason"),
    )


class _InOrder(StatefulProcessor):
    """Rows of a key wait in list state until the watermark has passed them and are handled in (ts, id) order.

    So rows that come late (within the watermark) or in another order of files give the same answer. One event-time
    timer per key wakes at its earliest waiting row and, once none waits, when its state has no use any more; then
    all of it is removed. ``columns`` are the waiting ones (``ts`` in microseconds), ``state`` the schema of what is
    kept, ``handle_in_order`` takes the kept values (None at first) with the rows and returns the new ones, the time
    in microseconds from which they are of no use, and the output.
    """

    columns = ""
    state = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)
        self.kept = handle.getValueState("kept", f"{self.state}, expires bigint")

    def wake_at(self, millis: int) -> None:
        timers = list(self.handle.listTimers())
        if timers and min(timers) <= millis:
            return
        for timer in timers:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(millis)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in self.columns.split(", ")]
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf["ts"] = pdf["ts"].astype("datetime64[us]").astype("int64")
        values = pdf[names].astype(object).where(pdf[names].notna(), None)
        self.waiting.appendList(list(values.itertuples(index=False, name=None)))
        self.wake_at(int(pdf["ts"].min()) // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        names = [part.split()[0] for part in self.columns.split(", ")]
        rows = sorted(map(tuple, self.waiting.get()), key=lambda row: (row[1], row[0]))
        due = [row for row in rows if row[1] <= passed]
        kept = tuple(self.kept.get()) if self.kept.exists() else None
        out, expires = None, None if kept is None else kept[-1]
        if due:
            kept, expires, out = self.handle_in_order(key, None if kept is None else kept[:-1], pd.DataFrame(due, columns=names))
            self.kept.update((*kept, expires))
        rest = rows[len(due) :]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][1] // 1000)
        else:
            self.waiting.clear()
            if expires is None or expires <= passed:
                self.kept.clear()
            else:
                self.handle.registerTimer(expires // 1000 + 1)
        return iter([] if out is None else [out])

    def close(self) -> None:
        pass


class FixedWindowLimits(_InOrder):
    """Window start and calls used per rule of an agent, a map of policies in the state of the agent."""

    columns = "id bigint, ts bigint, tool string"
    state = "windows map<string, struct<start: bigint, used: bigint>>"

    def __init__(self, limits: list[tuple[str, str | None, int, int]]):
        self.limits = limits

    def handle_in_order(self, key, kept, rows):
        windows = {} if kept is None else {policy: tuple(window) for policy, window in kept[0].items()}
        times, tools = rows["ts"].to_numpy(), rows["tool"].to_numpy()
        denied_by = np.full(len(rows), None, dtype=object)
        expires = 0
        for policy, tool, limit, seconds in self.limits:
            width = seconds * 1_000_000
            # A call that an earlier rule denied is not charged to a later one.
            charged = np.flatnonzero([by is None for by in denied_by] & ((tools == tool) if tool is not None else np.ones(len(rows), bool)))
            start, used = windows.get(policy, (None, 0))
            at, now = 0, times[charged]
            while at < len(now):  # one step per window
                if start is None or now[at] - start >= width:
                    start, used = int(now[at]), 0
                end = int(np.searchsorted(now, start + width, side="left"))
                over = charged[at + max(0, limit - used) : end]
                denied_by[over] = policy
                used, at = used + end - at, end
            if start is not None:
                windows[policy] = (start, used)
                expires = max(expires, start + width)
        out = pd.DataFrame({"id": rows["id"].astype("int64"), "agent_id": [key[0]] * len(rows), "allowed": [by is None for by in denied_by], "denied_by": denied_by})
        return (windows,), expires, out


def stream_rate_limit(
    calls: DataFrame, limits: list[tuple[str, str | None, int, int]], watermark: str = WATERMARK
) -> DataFrame:
    """Fixed-window limits per (policy, agent), in the order of the rules, as ``fixed_window_limit`` in batch.

    ``limits`` are (policy, tool or None for any, calls, seconds). Rows come out once the watermark has passed them;
    the state of an agent is removed once its last window is over. Rows without a time are left out.
    """
    rows = calls.select("id", "ts", "agent_id", "tool").filter("ts IS NOT NULL").withWatermark("ts", watermark)
    return rows.groupBy("agent_id").transformWithStateInPandas(
        FixedWindowLimits(limits), "id bigint, agent_id string, allowed boolean, denied_by string", "Append", "EventTime"
    )


class SessionRisk(_InOrder):
    """Running counts per session, dropped a day of event time after the last call."""

    columns = "id bigint, ts bigint, tool string, status string"
    state = "calls bigint, held bigint, denied bigint, tools array<string>, recent array<bigint>"

    def __init__(self, minute_us: int, ttl_ms: int):
        self.minute, self.ttl = minute_us, ttl_ms * 1000

    def handle_in_order(self, key, kept, rows):
        calls, held, denied, tools, recent = (0, 0, 0, [], []) if kept is None else kept
        times = rows["ts"].to_numpy()
        upto = np.searchsorted(times, times, side="right")  # rows of the same time see each other, as in batch

        def so_far(base: int, hit: pd.Series) -> np.ndarray:
            return base + np.cumsum(hit.to_numpy())[upto - 1]

        new_tool = rows["tool"].notna() & ~rows["tool"].isin(list(tools)) & ~rows["tool"].duplicated()
        held_now, denied_now = so_far(held, rows["status"].eq("HELD")), so_far(denied, rows["status"].eq("DENIED"))
        known = so_far(len(tools), new_tool)
        seen = np.concatenate([np.array(list(recent), dtype=np.int64), times])
        lately = np.searchsorted(seen, times, side="right") - np.searchsorted(seen, times - self.minute, side="left")
        risk = 0.05 * lately + 0.3 * np.minimum(denied_now, 3) + 0.2 * np.minimum(held_now, 3)
        out = pd.DataFrame({
            "id": rows["id"].astype("int64"), "session_id": [key[0]] * len(rows), "total_calls": calls + upto, "tools": known,
            "calls_per_minute": lately, "risk_score": [round(min(1.0, max(0.0, x)), 4) for x in risk.tolist()],
        })
        last = int(times[-1])
        tools = [*tools, *rows["tool"][new_tool]]
        recent = seen[seen >= last - self.minute].tolist()
        return (calls + len(rows), int(held_now[-1]), int(denied_now[-1]), tools, recent), last + self.ttl, out


def stream_session_risk(
    audit: DataFrame, minute_us: int = 60_000_000, ttl_ms: int = 86_400_000, watermark: str = WATERMARK
) -> DataFrame:
    """Session features and risk of every call, once the watermark has passed it; rows without a time are left out."""
    rows = audit.select("id", "ts", "session_id", "tool", "status").filter("ts IS NOT NULL").withWatermark("ts", watermark)
    return rows.groupBy("session_id").transformWithStateInPandas(
        SessionRisk(minute_us, ttl_ms),
        "id bigint, session_id string, total_calls bigint, tools bigint, calls_per_minute bigint, risk_score double",
        "Append",
        "EventTime",
    )


class SessionFlag(_InOrder):
    """A flagged response marks its session for a day; later calls of the session see the mark."""

    columns = "id bigint, ts bigint, flagged boolean"
    state = "until bigint"

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms * 1000

    def handle_in_order(self, key, kept, rows):
        times, flagged = rows["ts"].to_numpy(), rows["flagged"].eq(True).to_numpy()
        first = NEVER if kept is None else kept[0]
        until = np.maximum.accumulate(np.concatenate([[first], np.where(flagged, times + self.ttl, NEVER)]))
        out = pd.DataFrame({"id": rows["id"].astype("int64"), "session_id": [key[0]] * len(rows), "session_flagged": times < until[:-1]})
        return (int(until[-1]),), int(until[-1]), out


def stream_session_flag(responses: DataFrame, ttl_ms: int = 86_400_000, watermark: str = WATERMARK) -> DataFrame:
    """Whether the session of a response was flagged before it, once the watermark has passed it; rows without a time are left out."""
    rows = responses.select("id", "ts", "session_id", "flagged").filter("ts IS NOT NULL").withWatermark("ts", watermark)
    return rows.groupBy("session_id").transformWithStateInPandas(
        SessionFlag(ttl_ms), "id bigint, session_id string, session_flagged boolean", "Append", "EventTime"
    )


def publish_touched_days(log_path: str, table_path: str, ledger_path: str, schema: str):
    """A ``foreachBatch`` function: rebuild the hourly table for the days a batch touches, and only those.

    The log is partitioned by ``day`` and read by those partitions alone (a batch's days come to the driver). Days are
    rebuilt from the log, not added to, so a batch that failed half-way is right after its next try; the ledger gets the
    batch's number last, and a number that stands there already is not published again.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if published_batches(spark, ledger_path).filter(F.col("batch_id") == batch_id).limit(1).count():
            return
        days = [r.day for r in batch.select(F.to_date("ts").alias("day")).filter("day IS NOT NULL").distinct().collect()]
        if days:
            log = spark.read.schema(f"{schema}, day DATE").parquet(log_path).filter(F.col("day").isin(days))
            hourly = telemetry_hourly(log).withColumn("day", F.to_date("hour"))
            replace_partitions(hourly, table_path, "day")
        noted = spark.createDataFrame([(batch_id, d) for d in days or [None]], LEDGER)
        replace_partitions(noted.coalesce(1), ledger_path, "batch_id")

    return publish


LEDGER = "batch_id BIGINT, published_day DATE"


def published_batches(spark: SparkSession, ledger_path: str) -> DataFrame:
    """(batch_id, published_day) of every batch that is published whole; without a ledger, none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema("published_day DATE, batch_id BIGINT").parquet(ledger_path).select("batch_id", "published_day")
