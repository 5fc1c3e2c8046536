import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import audit as au

SCHEMA = """id BIGINT, trace_id STRING, span_id STRING, parent_id BIGINT, timestamp TIMESTAMP, status STRING, agent_id STRING,
 session_id STRING, server STRING, tool STRING, args_hash STRING, args_redacted STRUCT<text: STRING>,
 policies_fired ARRAY<STRUCT<policy: STRING, effect_type: STRING>>, decision STRUCT<outcome: STRING>, latency_ms INT,
 tokens STRING, prev_hash STRING, this_hash STRING, hitl_ticket_id STRING, hitl_reviewer STRING, hitl_decision STRING, hitl_rationale STRING"""
COLUMNS = [c.split()[0] for c in SCHEMA.replace("\n", " ").replace("STRUCT<policy: STRING, effect_type: STRING>", "X").split(",")]


def python_hash(prev, entry):
    kept = {k: v for k, v in entry.items() if k not in ("id", "this_hash")}
    text = json.dumps(kept, sort_keys=True, separators=(",", ":"), default=lambda o: o.replace(tzinfo=dt.timezone.utc).isoformat())
    return hashlib.sha256((prev + text).encode()).hexdigest()


def entry(i, **changes):
    base = {
        "id": i, "trace_id": "11111111-1111-1111-1111-111111111111", "span_id": "22222222-2222-2222-2222-222222222222",
        "parent_id": None, "timestamp": dt.datetime(2026, 7, 22, 12, 0, 0, 250 if i % 2 else 0), "status": "COMPLETED", "agent_id": "agent-1",
        "session_id": "session-1", "server": "hello-echo", "tool": "echo", "args_hash": "deadbeef",
        "args_redacted": {"text": 'hi "quoted" né 日 😀 \\ \n'}, "policies_fired": [{"effect_type": "tag_only", "policy": "p"}] if i % 2 else [],
        "decision": {"outcome": "PASS"}, "latency_ms": 12, "tokens": None, "prev_hash": au.GENESIS, "this_hash": "",
        "hitl_ticket_id": None, "hitl_reviewer": None, "hitl_decision": None, "hitl_rationale": None,
    }
    return base | changes


def chain(n):
    rows, prev = [], au.GENESIS
    for i in range(1, n + 1):
        row = entry(i * 3, prev_hash=prev)
        row["this_hash"] = prev = python_hash(prev, row)
        rows.append(row)
    return rows


def verify(spark, rows, bucket_rows=4, since=None):
    df = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA)
    checks = au.chain_checks(df, au.entry_hash(df), bucket_rows=bucket_rows).withColumn("ts", F.col("timestamp"))
    return au.verify_chain(checks, since).first()


def test_empty_chain_is_valid(spark):
    r = verify(spark, [])
    assert r.valid and r.checked == 0 and r.first_mismatch_id is None


def test_valid_chain_across_buckets(spark):
    r = verify(spark, chain(9), since="2026-07-22")
    assert r.valid and r.checked == 9 and r.in_scope == 9


def test_broken_genesis(spark):
    rows = chain(3)
    rows[0]["prev_hash"] = "f" * 64
    r = verify(spark, rows)
    assert not r.valid and r.first_mismatch_id == 3 and r.checked == 0 and "expected '" + au.GENESIS in r.detail


def test_changed_field(spark):
    rows = chain(5)
    rows[2]["tool"] = "mark_investigated"
    r = verify(spark, rows)
    assert (r.valid, r.first_mismatch_id, r.checked) == (False, 9, 2) and "content was modified" in r.detail


def test_broken_link_in_the_middle(spark):
    rows = chain(4)
    rows[2]["prev_hash"] = "e" * 64
    assert verify(spark, rows).first_mismatch_id == 9


def test_only_the_first_mismatch_is_reported(spark):
    rows = chain(5)
    rows[1]["tool"] = "x"
    rows[3]["tool"] = "y"
    r = verify(spark, rows)
    assert (r.checked, r.first_mismatch_id) == (1, 6)


def test_canonical_json_equals_python(spark):
    rows = [(1, "é", {"b": 1, "a": ["x\u007f", "日本", "😀"]}, None, dt.datetime(2026, 7, 22, 12))]
    df = spark.createDataFrame(rows, "z INT, b STRING, a STRUCT<b: INT, a: ARRAY<STRING>>, n STRING, t TIMESTAMP")
    got = df.select(au.canonical_json(df)).first()[0]
    wanted = {"z": 1, "b": "é", "a": {"b": 1, "a": ["x\u007f", "日本", "😀"]}, "n": None, "t": "2026-07-22T12:00:00+00:00"}
    assert got == json.dumps(wanted, sort_keys=True, separators=(",", ":"))


def test_redaction_proof(spark):
    df = spark.createDataFrame([(1, {"text": "hi"})], "id INT, args STRUCT<text: STRING>")
    good = hashlib.sha256(b'{"text":"hi"}').hexdigest()
    rows = df.withColumn("h", F.explode(F.array(F.lit(good), F.lit("bad"))))
    assert sorted(r["matches"] for r in au.redaction_proof(rows, "args", "h").collect()) == [False, True]


@pytest.mark.parametrize("age,tier", [(0, "hot"), (30, "hot"), (31, "warm"), (90, "warm"), (91, "cold")])
def test_archive_tiers(spark, age, tier):
    df = spark.createDataFrame([(dt.datetime(2024, 6, 1) - dt.timedelta(days=age),)], "ts TIMESTAMP")
    assert au.archive_tiers(df, "2024-06-01").first()["tier"] == tier


def test_pairs_and_pending(spark):
    from ledgerlight.operators.policy import pending_reviews

    rows = [(1, None, "2024-01-01 00:00:00", "HELD", None), (2, None, "2024-01-01 00:01:00", "HELD", None),
            (3, 1, "2024-01-01 00:00:30", "COMPLETED", "APPROVED"), (4, None, "2024-01-01 00:02:00", "DENIED", None)]
    df = spark.createDataFrame(rows, "id BIGINT, parent_id BIGINT, ts STRING, status STRING, hitl_decision STRING").withColumns({
        "ts": F.col("ts").cast("timestamp"), "latency_ms": F.lit(0), "hitl_reviewer": F.lit(None).cast("string"),
        **{c: F.lit("x") for c in ("agent_id", "session_id", "server", "tool", "outcome", "fired_policy", "reviewer_group", "reason")}})
    pairs = {r["id"]: r for r in au.call_pairs(df).collect()}
    assert pairs[1]["review_wait_seconds"] == 30 and pairs[2]["closed_id"] is None and len(pairs) == 3
    open_rows = pending_reviews(df, "2024-01-01 00:05:00").collect()
    assert [(r["id"], r["age_seconds"]) for r in open_rows] == [(2, 240)]
    assert sorted(r["id"] for r in au.decision_events(df).collect()) == [1, 2, 4]
