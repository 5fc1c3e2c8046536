import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import scenarios, shape, telemetry
from ledgerlight.sources import files

PATTERNS = """BEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 2-degree Fan-Out
2022/09/01 00:06,021174,800737690,012,80011F990,2848.96,Euro,2848.96,Euro,ACH,1
2022/09/01 04:33,021174,800737690,020,80020C5B0,8630.40,Euro,8630.40,Euro,ACH,1
END LAUNDERING ATTEMPT - FAN-OUT

BEGIN LAUNDERING ATTEMPT - CYCLE:  Max 1 hops
2022/09/01 00:06,0050,A,0051,B,1,Euro,1,Euro,ACH,1
END LAUNDERING ATTEMPT - CYCLE
"""


def test_transfers_and_accounts(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
        "2022/09/01 00:20,010,8000EBD30,0011,8000EBD31,3697.34,US Dollar,3697.34,US Dollar,Reinvestment,0\n")
    row = files.read_transfers(spark, str(tmp_path / "t.csv")).first()
    assert (row.from_id, row.to_id, row.ts, row.amount_paid, row.is_laundering) == ("10:8000EBD30", "11:8000EBD31", dt.datetime(2022, 9, 1, 0, 20), 3697.34, 0)
    (tmp_path / "a.csv").write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\nBank,0331579,80B779D80,E1,Corp #1\n")
    assert files.read_accounts(spark, str(tmp_path / "a.csv")).first().account_id == "331579:80B779D80"


def test_bad_transfers_come_with_their_reasons(spark, tmp_path):
    good = "2022/09/01 00:20,010,A1,0011,B1,3697.34,US Dollar,3697.34,US Dollar,Wire,0"
    bad = {
        "2022-09-01,010,A1,0011,B1,1,US Dollar,1,US Dollar,Wire,0": ["ts"],
        "2022/09/01 00:20,x10,A1,0011,,1,US Dollar,1,US Dollar,Wire,0": ["from_bank", "to_account"],
        "2022/09/01 00:20,010,A1,0011,B1,one,US Dollar,NaN,US Dollar,Wire,2": ["amount_received", "amount_paid", "is_laundering"],
        "2022/09/01 00:20,010,A1,0011,B1,1,US Dollar": ["column_count"],
        "2022/09/01 00:20,010,A1,0011,B1,1,US Dollar,1,US Dollar,Wire,0,more": ["column_count"],
    }
    (tmp_path / "t.csv").write_text("\n".join([",".join("abcdefghijk"), good, *bad, good]) + "\n")
    split = files.split_transfers(spark, str(tmp_path / "t.csv"), str(tmp_path / "out"))
    assert split.good.columns == files.read_transfers(spark, str(tmp_path / "t.csv")).columns
    assert [(r.from_id, r.to_id, r.amount_paid) for r in split.good.collect()] == [("10:A1", "11:B1", 3697.34)] * 2
    assert sorted(r.reasons for r in split.rejected.collect()) == sorted(bad.values())
    assert {r.record for r in split.rejected.collect()} >= {t for t, why in bad.items() if why == ["column_count"]}
    assert (split.counts["total"], split.counts["accepted"], split.counts["rejected_column_count"], split.counts["rejected_ts"]) == (7, 2, 2, 1)
    assert split.require(2) is split
    with pytest.raises(ValueError, match="accepted 2 of 7"):
        split.require(3)


def test_bad_accounts_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\nBank,0331579,80B,E1,Corp\nBank,none, ,E1,Corp\n")
    split = files.split_accounts(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"))
    assert [r.account_id for r in split.good.collect()] == ["331579:80B"]
    assert [r.reasons for r in split.rejected.collect()] == [["own_bank", "own_account"]]
    (tmp_path / "e.csv").write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\n")
    empty = files.split_accounts(spark, str(tmp_path / "e.csv"), str(tmp_path / "none"))
    assert (empty.good.count(), empty.rejected.count(), empty.counts["total"]) == (0, 0, 0)


def test_patterns(spark, tmp_path):
    (tmp_path / "p.txt").write_text(PATTERNS)
    rows = files.read_patterns(spark, str(tmp_path / "p.txt")).orderBy("pattern_id", "line").collect()
    assert [(r.typology, r.from_id, r.to_id) for r in rows] == [
        ("FAN-OUT:  Max 2-degree Fan-Out", "21174:800737690", "12:80011F990"), ("FAN-OUT:  Max 2-degree Fan-Out", "21174:800737690", "20:80020C5B0"),
        ("CYCLE:  Max 1 hops", "50:A", "51:B")]
    assert files.read_patterns(spark, str(tmp_path / "p.txt"), 1).count() == 2


def call_rows(spark):
    df = spark.range(6).select(
        "id", F.concat(F.lit("t"), "id").alias("trace_id"), F.lit("s").alias("span_id"), F.lit(None).cast("bigint").alias("parent_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 30_000).alias("timestamp"), F.lit("COMPLETED").alias("status"))
    texts = {"agent_id": "a", "session_id": "s", "server": "x", "tool": "t", "args_hash": "h", "args_redacted": "{}",
             "policies_fired": '[{"policy":"p","effect_type":"tag_only"}]', "decision": '{"outcome":"PASS"}',
             "tokens": '{"prompt":"10","provider":"q","cost_usd":"0.5"}', "hitl_ticket_id": None, "hitl_reviewer": None,
             "hitl_decision": None, "hitl_rationale": None, "tags": '["one","two"]'}
    df = df.withColumns({c: F.lit(v).cast("string") for c, v in texts.items()})
    return df.withColumn("latency_ms", F.lit(5))


def test_calls_round_trip_by_day(spark, tmp_path):
    for files_per_day in (None, 2):
        path = str(tmp_path / f"calls{files_per_day}")
        files.write_by_day(call_rows(spark), path, "timestamp", files_per_day)
        got = files.read_calls(spark, path)
        assert got.count() == 6 and got.select("day").distinct().count() == 2
        row = got.first()
        assert row.decision_parsed.outcome == "PASS" and row.policies_fired_parsed[0].policy == "p" and row.tags_parsed == ["one", "two"] and row.tokens_parsed.prompt == "10"


def test_writers(spark, tmp_path):
    table = str(tmp_path / "agg")
    files.replace_source(spark.createDataFrame([(1,), (2,)], "n INT"), table, "one")
    files.replace_source(spark.createDataFrame([(3,)], "n INT"), table, "two")
    files.replace_source(spark.createDataFrame([(9,)], "n INT"), table, "one")
    assert sorted((r.source, r.n) for r in spark.read.parquet(table).collect()) == [("one", 9), ("two", 3)]
    files.publish_table(call_rows(spark), str(tmp_path / "pub"))
    assert len(spark.read.parquet(str(tmp_path / "pub")).columns) == 19
    files.write_by_month(call_rows(spark), str(tmp_path / "m"), "timestamp")
    assert spark.read.parquet(str(tmp_path / "m")).select("month").distinct().count() == 1
    opened = files.open_table(spark, str(tmp_path / "m"), "id BIGINT, agent_id STRING", ["id"])
    assert dict(opened.dtypes)["id"] == "string" and opened.count() == 6
    people = spark.createDataFrame([("a",), ("b",)], "account_id STRING")
    files.write_accounts(people, people.limit(1), str(tmp_path / "acc"))
    assert spark.read.parquet(str(tmp_path / "acc")).count() == 1
    stats = spark.createDataFrame([("raw", 10, 1, 10.0), ("sampled", 5, 1, 20.0)], "side STRING, total BIGINT, labelled BIGINT, ratio_pct DOUBLE")
    checked = spark.createDataFrame([(2, 2)], "checked BIGINT, fully_preserved BIGINT")
    files.write_report(files.subsample_report(stats, checked, 42, 5), str(tmp_path / "rep"))
    report = spark.read.json(str(tmp_path / "rep")).first()
    assert report.raw.total == 10 and report.sampled.ratio_pct == 20.0 and report.pattern_connectivity.checked == 2


def test_fetch_audit_is_in_order(spark, tmp_path):
    spark.range(50).orderBy(F.desc("id")).write.parquet(str(tmp_path / "log"))
    got = [r.id for r in files.fetch_audit(spark, str(tmp_path / "log")).collect()]
    assert got == sorted(got)


def test_tiers(spark, tmp_path):
    from ledgerlight.operators.audit import archive_tiers

    rows = call_rows(spark).withColumnRenamed("timestamp", "ts").withColumn("day", F.to_date("ts"))
    files.write_tiers(archive_tiers(rows, "2024-02-01"), str(tmp_path / "tiers"))
    assert spark.read.parquet(str(tmp_path / "tiers")).filter("tier = 'warm'").count() == 3


def test_scenarios(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text(
        '{"id":"c1","attack_class":"x","description":"d","calls":[{"server":"s","tool":"t","args":{}}],"expected":{"status":"DENIED","policy_fired":"p",'
        '"response_contains":null,"response_not_contains":null,"tags_include":["a"],"incident_expected":true}}\n')
    cases = files.read_scenarios(spark, str(tmp_path / "s.jsonl"))
    files.write_scenarios(cases, str(tmp_path / "copy"))
    assert files.read_scenarios(spark, str(tmp_path / "copy")).first() == cases.first()
    named = cases.withColumn("agent_id", F.lit("a1"))
    audit = spark.createDataFrame([(1, "a1", "INTENT", None, ["a"], START), (2, "a1", "DENIED", "p", ["a", "b"], START)],
                                  "id BIGINT, agent_id STRING, status STRING, fired_policy STRING, tags ARRAY<STRING>, ts TIMESTAMP")
    answers = spark.createDataFrame([("a1", False, "")], "agent_id STRING, ok BOOLEAN, text STRING")
    agents = spark.createDataFrame([("a1",)], "agent_id STRING")
    judged = scenarios.judge_scenarios(named, audit, answers, agents)
    assert judged.first().passed
    assert scenarios.judge_scenarios(named, audit, answers, agents.filter("false")).first().failure == "no_incident"
    assert scenarios.judge_scenarios(named, audit.filter("false"), answers, agents).first().failure == "no audit entries"
    assert tuple(scenarios.scenario_report(judged).first()) == (1, 1, 0, 1)


START = dt.datetime(2024, 1, 1)


def test_shapes(spark):
    buckets = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0)], "name STRING, weight DOUBLE")
    shares = shape.apportion(buckets, "weight", 8)
    assert {r.name: r.row_count for r in shares.collect()} == {"a": 2, "b": 6, "c": 0}
    assert shape.expand_by_count(shares).count() == 8
    draws = spark.createDataFrame([(0.05,), (0.12,), (0.9,)], "d DOUBLE")
    label = shape.label_by_cumulative(F.col("d"), [("x", 0.1), ("y", 0.06)], "z")
    assert [r[0] for r in draws.select(label).collect()] == ["x", "y", "z"]
    assert [r[0] for r in draws.select(shape.pick(["p", "q"], F.col("d"))).collect()] == ["p", "p", "q"]
    clipped = spark.createDataFrame([(1,), (99999,), (55,)], "v INT").select(shape.clip_latency(F.col("v")))
    assert [r[0] for r in clipped.collect()] == [10, 8000, 55]


def test_exact_percentiles(spark):
    df = spark.range(1, 101).withColumn("g", F.col("id") % 2)
    got = {r.g: (r.p50, r.p99) for r in telemetry.value_percentiles(df, "id", {"p50": 0.5, "p99": 0.99}, ["g"]).collect()}
    assert got == {0: (50, 100), 1: (49, 99)}


def test_in_windows_half_open_and_overlapping(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    rows = spark.createDataFrame([(i, at(i)) for i in range(8)], "id BIGINT, ts TIMESTAMP")
    windows = spark.createDataFrame([(at(1), at(3)), (at(2), at(4)), (at(6), at(6)), (at(6), at(7))], "start TIMESTAMP, end TIMESTAMP")
    got = {r.id for r in shape.in_windows(rows, windows).collect() if r.in_window}
    assert got == {1, 2, 3, 6}
