"""Every stream gives the batch answer on the same rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from paths import SF_DIR
from ledgerlight.operators import audit as au
from ledgerlight.operators import rate_limit, risk, telemetry
from ledgerlight.sources import adapters as ad
from ledgerlight.sources.files import replace_partitions
from ledgerlight.streaming import calls as st


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stream")
    calls = ad.calls(spark, SF_DIR).drop("day").withColumns({"trace_id": F.col("id").cast("string"), "span_id": F.lit("0")})
    calls.orderBy("ts").coalesce(1).write.parquet(f"{root}/calls")
    audit = ad.audit(spark, SF_DIR).select("id", "parent_id", "ts", "agent_id", "session_id", "tool", "status", "outcome", "hitl_decision", "k")
    audit.orderBy("ts").coalesce(1).write.parquet(f"{root}/audit")
    return root


def run(stream, tmp_path, mode="append"):
    name = "out_" + tmp_path.name.replace("-", "_")
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def source(spark, root, name):
    schema = spark.read.parquet(f"{root}/{name}").schema
    return st.stream_table(spark, f"{root}/{name}", schema), spark.read.parquet(f"{root}/{name}")


def same(a, b, columns):
    left = sorted(map(tuple, a.select(*columns).collect()), key=repr)
    right = sorted(map(tuple, b.select(*columns).collect()), key=repr)
    assert left == right and left


def test_events(spark, tables, tmp_path):
    stream, batch = source(spark, tables, "audit")
    same(run(st.stream_events(stream), tmp_path), au.decision_events(batch), ["id", "status"])


def test_hourly(spark, tables, tmp_path):
    stream, batch = source(spark, tables, "calls")
    got = run(st.stream_hourly(stream), tmp_path, "complete")
    same(got, telemetry.telemetry_hourly(batch), ["hour", "server", "tool", "outcome", "call_count", "error_count", "latency_p95_ms"])


def test_hourly_append_emits_closed_hours(spark, tables, tmp_path):
    stream, batch = source(spark, tables, "calls")
    got = run(st.stream_hourly(stream), tmp_path)
    last = batch.agg(F.max("ts")).first()[0]
    closed = telemetry.telemetry_hourly(batch).filter(
        F.col("hour") + F.expr("INTERVAL 1 HOUR") <= F.lit(last) - F.expr("INTERVAL 10 MINUTES")
    )
    same(got, closed, ["hour", "server", "tool", "outcome", "call_count"])


def test_call_rate(spark, tables, tmp_path):
    stream, batch = source(spark, tables, "calls")
    got = run(st.stream_call_rate(stream), tmp_path, "complete")
    same(got, telemetry.call_rate(batch, ["agent_id"]), ["window_start", "agent_id", "calls"])


def test_denials(spark, tables, tmp_path):
    stream, batch = source(spark, tables, "calls")
    got = run(st.stream_denials(stream, 2, "2 days", "6 hours"), tmp_path, "complete")
    wanted = (
        batch.filter("status = 'DENIED'").groupBy(F.window("ts", "2 days", "6 hours").alias("w"), "agent_id")
        .agg(F.count("*").alias("denials")).filter("denials >= 2").select(F.col("w.start").alias("window_start"), "agent_id", "denials")
    )
    same(got, wanted, ["window_start", "agent_id", "denials"])


def test_dedup(spark, tables, tmp_path):
    _, batch = source(spark, tables, "calls")
    folder = str(tmp_path / "twice")
    batch.limit(50).write.parquet(folder)
    batch.limit(50).write.mode("append").parquet(folder)
    got = run(st.stream_dedup(st.stream_table(spark, folder, batch.schema)), tmp_path)
    assert got.count() == 50


def shuffled(rows, tmp_path, order):
    """A stream that reads one file of ``rows`` per micro-batch, in the given order, then a row so much later that the watermark passes them all.

    Each file spans all times, so its rows are late by as much and the watermark has to allow for it.
    """
    folder = str(tmp_path / "parts")
    spark = rows.sparkSession
    last = rows.agg(F.max("ts")).first()[0]
    for number in order:
        rows.filter(F.pmod("id", F.lit(len(order))) == number).coalesce(1).write.mode("append").parquet(folder)
    end = spark.createDataFrame([(-1, last + datetime.timedelta(days=90))], "id bigint, ts timestamp")
    rows.limit(0).unionByName(end, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_limits_of_two_rules_over_reordered_batches(spark, tables, tmp_path):
    _, batch = source(spark, tables, "calls")
    busy = F.when(F.col("id") % 3 == 0, "agent-busy").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("agent_id"))
    rows = batch.select("id", "ts", busy.alias("agent_id"), "tool").cache()
    tool = rows.groupBy("tool").count().orderBy(F.desc("count"), "tool").first()[0]
    stream = st.stream_rate_limit(shuffled(rows, tmp_path, [2, 0, 1]), [("p1", tool, 1, 21600), ("p2", None, 2, 43200)], "60 days")
    one = rate_limit.fixed_window_limit(rows.filter(F.col("tool") == tool), ["agent_id"], 1, 21600).select("id", F.col("allowed").alias("first"))
    left = rows.join(one, "id", "left").fillna({"first": True}).cache()
    two = rate_limit.fixed_window_limit(left.filter("first").drop("first"), ["agent_id"], 2, 43200).select("id", F.col("allowed").alias("second"))
    wanted = left.join(two, "id", "left").select(
        "id", "agent_id", (F.col("first") & F.coalesce("second", F.lit(True))).alias("allowed"),
        F.expr("CASE WHEN NOT first THEN 'p1' WHEN NOT second THEN 'p2' END").alias("denied_by"),
    )
    got = run(stream, tmp_path).filter("id >= 0")
    same(got, wanted, ["id", "agent_id", "allowed", "denied_by"])
    assert {r[0] for r in got.select("denied_by").distinct().collect()} == {None, "p1", "p2"}


def test_session_risk_over_reordered_batches(spark, tables, tmp_path):
    _, batch = source(spark, tables, "audit")
    got = run(st.stream_session_risk(shuffled(batch, tmp_path, [1, 2, 0]), 3_600_000_000, watermark="60 days"), tmp_path).filter("id >= 0")
    wanted = risk.session_features(batch, 3_600_000_000).withColumn("risk_score", risk.session_risk())
    wanted = wanted.withColumn("tools", F.col("unique_tools_count"))
    same(got, wanted, ["id", "total_calls", "tools", "calls_per_minute", "risk_score"])


def test_session_flag_of_late_rows(spark, tmp_path):
    first = [(1, "2024-01-01 00:00:00", "s", False), (2, "2024-01-01 03:00:00", "s", True), (4, "2024-01-02 02:30:00", "s", False), (7, "2024-01-01 02:00:00", None, True)]
    late = [(3, "2024-01-01 02:00:00", "s", True), (5, "2024-01-02 03:00:00", "s", False), (6, "2024-01-01 02:30:00", "t", None), (8, "2024-01-01 02:00:01", None, False), (9, None, "s", True)]
    end = [(0, "2024-02-01 00:00:00", "z", False)]
    folder = str(tmp_path / "r")
    for rows in (first, late, end):
        df = spark.createDataFrame(rows, "id bigint, ts string, session_id string, flagged boolean").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = run(st.stream_session_flag(stream, watermark="2 days"), tmp_path)
    marks = {r["id"]: r["session_flagged"] for r in got.collect()}
    # the late flag of 02:00 neither shortens the one of 03:00 nor is lost: 03:00 sees it
    assert marks == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False, 8: True}


def test_limit_state_empties_after_the_window(spark, tmp_path):
    folder = str(tmp_path / "r")
    for rows in ([(1, "2024-01-01 00:00:00", "a", "t"), (2, "2024-01-01 00:00:30", "a", "t")], [(3, "2024-01-03 00:00:00", "b", "t")], [(4, "2024-01-05 00:00:00", "c", "t")]):
        df = spark.createDataFrame(rows, "id bigint, ts string, agent_id string, tool string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    limited = st.stream_rate_limit(stream, [("p", None, 1, 60)])
    query = limited.writeStream.format("memory").queryName("emptied").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    assert {r["id"]: r["allowed"] for r in spark.table("emptied").collect()} == {1: True, 2: False, 3: True}
    kept = spark.read.format("statestore").option("stateVarName", "kept").load(str(tmp_path / "ck"))
    assert kept.count() == 0


def test_review_timeout(spark, tmp_path):
    held_schema = "id bigint, ts timestamp, agent_id string"
    decision_schema = "ticket_id bigint, decided_at timestamp, decision string"

    def write(rows, columns, times, folder):
        df = spark.createDataFrame(rows, columns)
        for t in times:
            df = df.withColumn(t, F.col(t).cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(folder)

    h, d = str(tmp_path / "h"), str(tmp_path / "d")
    write([(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:10:00", "a"), (3, "2024-01-01 00:20:00", "a")], ["id", "ts", "agent_id"], ["ts"], h)
    write([(1, "2024-01-01 00:30:00", "APPROVED"), (2, "2024-01-01 01:30:00", "APPROVED")], ["ticket_id", "decided_at", "decision"], ["decided_at"], d)
    # Later rows on both sides move the watermark past every deadline.
    write([(9, "2024-01-02 00:00:00", "z")], ["id", "ts", "agent_id"], ["ts"], h)
    write([(8, "2024-01-02 00:00:00", "DENIED")], ["ticket_id", "decided_at", "decision"], ["decided_at"], d)
    held = spark.readStream.schema(held_schema).parquet(h)
    decided = spark.readStream.schema(decision_schema).parquet(d)
    got = run(st.stream_review_timeout(held, decided, 3600), tmp_path)
    found = {r["id"]: (r["decision"], r["reason"]) for r in got.collect()}
    assert found == {1: ("APPROVED", None), 2: (None, "hitl_timeout"), 3: (None, "hitl_timeout")}


def test_merged_sketches_stay_within_their_bound(spark, tables, tmp_path):
    rows = spark.range(60_000).selectExpr(
        "timestamp_seconds(1704067200 + id * 2) AS ts", "'s' AS server", "concat('t', id % 3) AS tool", "if(id % 50 = 0, 'UPSTREAM_ERROR', 'COMPLETED') AS status",
        "CAST(pmod(xxhash64(id), 100000) AS INT) AS latency_ms", "id")
    size = 512
    whole = telemetry.merged_sketches(telemetry.hourly_sketches(rows, size), "server")
    got = telemetry.sketch_percentiles(whole).first()
    assert (got.call_count, got.error_count) == (60_000, 1200)
    for q, found in ((0.50, got.latency_p50_ms), (0.95, got.latency_p95_ms), (0.99, got.latency_p99_ms)):
        assert abs(rows.filter(F.col("latency_ms") <= found).count() / 60_000 - q) < 0.02
    none = rows.limit(3).withColumn("latency_ms", F.lit(None).cast("int"))
    empty = telemetry.sketch_percentiles(telemetry.merged_sketches(telemetry.hourly_sketches(none), "server")).first()
    assert (empty.call_count, empty.latency_p50_ms) == (3, None)
    stream, batch = source(spark, tables, "calls")
    streamed = run(st.stream_hourly_sketches(stream), tmp_path)
    hours = streamed.select("hour").distinct()
    wanted = telemetry.hourly_sketches(batch).join(hours, "hour", "left_semi")
    merged = [sorted(map(tuple, telemetry.sketch_percentiles(telemetry.merged_sketches(df, "server")).collect())) for df in (streamed, wanted)]
    assert merged[0] == merged[1] and merged[0]


LOG = "id BIGINT, ts TIMESTAMP, agent_id STRING, session_id STRING, server STRING, tool STRING, status STRING, hitl_decision STRING, latency_ms INT, k INT"


def totals(spark, table):
    return {str(r["day"]): (r["n"], r["least"]) for r in spark.read.parquet(table).groupBy("day").agg(F.sum("call_count").alias("n"), F.min("call_count").alias("least")).collect()}


def test_publish_replaces_only_touched_days_and_survives_replays(spark, tables, tmp_path):
    _, batch = source(spark, tables, "calls")
    log, table, ledger, incoming = (str(tmp_path / n) for n in ("log", "table", "ledger", "in"))
    batch.drop("day").withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(log)
    wanted = {str(r["day"]): r["n"] for r in batch.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).collect()}
    stale = telemetry.telemetry_hourly(batch).withColumn("day", F.to_date("hour")).withColumn("call_count", F.lit(-1).cast("bigint"))
    replace_partitions(stale, table, "day")
    early = batch.filter("ts < '2024-01-03'")
    early.write.parquet(incoming)
    publish = st.publish_touched_days(log, table, ledger, LOG)
    query = (
        st.stream_table(spark, incoming, batch.schema).writeStream.foreachBatch(publish)
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    touched = {str(r["day"]) for r in early.select(F.to_date("ts").alias("day")).distinct().collect()}
    got = totals(spark, table)
    assert touched and all(got[d] == (wanted[d], got[d][1]) and got[d][1] > 0 for d in touched)
    assert all(got[d][1] == -1 for d in set(wanted) - touched)
    noted = st.published_batches(spark, ledger).collect()
    assert {r.batch_id for r in noted} == {0} and {str(r.published_day) for r in noted} == touched

    # A replay of a published batch changes nothing, also when the table was changed since.
    spoilt = stale.filter(F.col("day").cast("string").isin(sorted(touched)))
    replace_partitions(spoilt, table, "day")
    publish(early, 0)
    assert all(totals(spark, table)[d][1] == -1 for d in touched)

    # A batch that fails before its ledger entry is published whole by its next try.
    def fails(*_):
        raise OSError("no ledger")

    kept, st.replace_partitions = st.replace_partitions, lambda df, path, *by: fails() if path == ledger else replace_partitions(df, path, *by)
    try:
        with pytest.raises(OSError):
            publish(early, 1)
    finally:
        st.replace_partitions = kept
    publish(early, 1)
    assert {d: n for d, (n, _) in totals(spark, table).items() if d in touched} == {d: wanted[d] for d in touched}
    publish(early.filter("false"), 2)
    assert {r.batch_id for r in st.published_batches(spark, ledger).collect()} == {0, 1, 2}
