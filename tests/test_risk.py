import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import frames
from ledgerlight.operators import risk

START = dt.datetime(2024, 1, 1)
MIN = frames.MINUTE


@pytest.mark.parametrize("buckets,expected", [
    ([5], None), ([5, 1, 2], None), ([5, 2, 2, 2], None), ([10, 1, 2, 3], 8.0), ([20] + [1, 2] * 5 + [1], None)])
def test_zscore(spark, buckets, expected):
    df = spark.createDataFrame([(buckets,)], "b ARRAY<BIGINT>").select(risk.rate_zscore(F.col("b")).alias("z"))
    got = df.first().z
    if len(buckets) == 12:
        assert got > 5
    else:
        assert got == expected


@pytest.mark.parametrize("z,denials,wanted", [
    (None, 0, (None, None)), (2.9, 2, (None, None)), (3.5, 0, ("rate_spike", "med")), (-5.0, 9, ("rate_spike", "high")),
    (None, 3, ("repeated_denials", "med")), (1.0, 5, ("repeated_denials", "high"))])
def test_detect(spark, z, denials, wanted):
    df = spark.createDataFrame([(z, denials)], "z DOUBLE, d INT")
    kind, severity = risk.detect(F.col("z"), F.col("d"))
    assert tuple(df.select(kind, severity).first()) == wanted


@pytest.mark.parametrize("outcome,score,severity,path", [
    ("DENY", 1.0, "high", "escalate"), ("HOLD", 1.0, "high", "enrich>evidence"), ("PASS", 0.5, "high", "enrich"),
    ("PASS", 0.51, None, "enrich>anomaly"), ("PASS", 0.51, "med", "enrich>anomaly"), ("PASS", 0.9, "high", "enrich>anomaly>escalate")])
def test_route(spark, outcome, score, severity, path):
    df = spark.createDataFrame([(outcome, score, severity)], "outcome STRING, risk_score DOUBLE, anomaly_severity STRING")
    assert df.select(risk.route()).first()[0] == path


@pytest.mark.parametrize("outcome,denials,severity,score,rule,level", [
    ("DENY", 2, None, 0.0, None, None), ("DENY", 3, None, 0.0, "repeated_denials", "med"), ("DENY", 3, "high", 0.0, "repeated_denials", "high"),
    ("PASS", 0, "high", 0.6, "high_severity_anomaly", "high"), ("PASS", 0, "med", 0.9, None, None),
    ("HOLD", 0, None, 0.81, "high_risk_pending_hitl", "high"), ("HOLD", 0, None, 0.8, None, None)])
def test_promotion(spark, outcome, denials, severity, score, rule, level):
    df = spark.createDataFrame([(1, outcome, denials, severity, score, "x", "a", "s", "t")],
                               "id INT, outcome STRING, denials_recent INT, anomaly_severity STRING, risk_score DOUBLE, path STRING, agent_id STRING, server STRING, tool STRING")
    got = risk.incidents(df, all_paths=True).collect()
    assert [(r.promotion_rule, r.severity) for r in got] == ([(rule, level)] if rule else [])


def timeline(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for i in range(n):
        t += 0 if rng.random() < 0.1 else rng.expovariate(1 / 40)
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}"
        rows.append((i, START + dt.timedelta(seconds=round(t, 3)), key, rng.choice("abc"), rng.choice(["DENIED", "HELD", "COMPLETED"])))
    return rows, spark.createDataFrame(rows, "id BIGINT, ts TIMESTAMP, session_id STRING, tool STRING, status STRING")


def test_framed_sums_equal_brute_force(spark):
    rows, df = timeline(spark)
    got = frames.framed_sums(
        df, ["session_id"], "ts", trailing={"near": (F.lit(1), -5 * MIN, 0), "before": (F.lit(1), -10 * MIN, -5 * MIN - 1)},
        to_date={"denied": F.when(F.col("status") == "DENIED", 1).otherwise(0)}, distinct_to_date={"tools": "tool"}, bucket_us=15 * MIN)
    found = {r.id: (r.near, r.before, r.denied, r.tools) for r in got.collect()}
    five, ten = dt.timedelta(minutes=5), dt.timedelta(minutes=10)
    for i, t, key, _, _ in rows:
        past = [r for r in rows if r[2] == key and r[1] <= t]
        wanted = (sum(r[1] >= t - five for r in past), sum(t - ten <= r[1] < t - five for r in past),
                  sum(r[4] == "DENIED" for r in past), len({r[3] for r in past}))
        assert found[i] == wanted
    assert len(found) == len(rows)


def test_positions_and_last_rows(spark):
    rows, df = timeline(spark, 300, 2)
    placed = frames.row_positions(df, ["session_id"], "ts", "id", bucket_us=10 * MIN)
    got = {r.id: list(r.last) for r in frames.last_rows(placed, ["session_id"], "position", F.col("id"), 4, "last", block=16).collect()}
    for i, t, key, _, _ in rows:
        past = sorted((r[1], r[0]) for r in rows if r[2] == key and (r[1], r[0]) <= (t, i))
        assert got[i] == [r[1] for r in past][::-1][:4]


def test_rate_buckets_are_half_open(spark):
    rows = [(i, START + dt.timedelta(minutes=m), "a") for i, m in enumerate((0, 5, 10, 12, 60))]
    df = spark.createDataFrame(rows, "id BIGINT, ts TIMESTAMP, agent_id STRING")
    got = {r.id: r.rate_buckets for r in risk.rate_buckets(df).collect()}
    assert got[0] == [1] + [0] * 11 and got[3][:3] == [2, 1, 1]
    assert got[2][:3] == [1, 1, 1] and sum(got[4]) == 4


def test_burst_of_checks_before_a_write(spark):
    rows = [(i, START + dt.timedelta(seconds=s), "a", t) for i, (s, t) in enumerate([(0, "check_entity"), (5, "check_entity"), (9, "check_alias"), (20, "mark_investigated"), (200, "mark_investigated")])]
    df = spark.createDataFrame(rows, "id BIGINT, ts TIMESTAMP, agent_id STRING, tool STRING")
    assert [r.id for r in risk.checks_then_write(df, 3).collect()] == [3]
    assert risk.checks_then_write(df, 4).count() == 0
