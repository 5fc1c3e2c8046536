import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import adjacency, graph

SCHEMA = "ts STRING, from_id STRING, to_id STRING, amount_received DOUBLE, amount_paid DOUBLE, payment_format STRING, is_laundering INT"
ROWS = [
    ("2022-08-01 08:00:00", "1:ACC002", "1:ACC001", 50.0, 50.0, "ACH", 0),
    ("2022-09-01 08:00:00", "1:ACC002", "1:ACC001", 9000.0, 9000.0, "ACH", 0),
    ("2022-09-05 09:00:00", "1:ACC003", "1:ACC001", 8500.0, 8500.0, "ACH", 0),
    ("2022-09-10 10:00:00", "1:ACC004", "1:ACC001", 9500.0, 9500.0, "ACH", 0),
    ("2022-09-15 11:00:00", "1:ACC001", "2:ACC010", 50000.0, 50000.0, "Wire", 1),
    ("2022-09-16 12:00:00", "2:ACC010", "3:ACC020", 45000.0, 45000.0, "Wire", 0),
]
IDS = ["1:ACC001", "1:ACC002", "1:ACC003", "1:ACC004", "2:ACC010", "3:ACC020"]


@pytest.fixture
def moves(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(i, "name " + i) for i in [*IDS, "9:NONE"]], "account_id STRING, entity_name STRING")


def test_account_transfers_end_day_is_inclusive(moves):
    got = graph.account_transfers(moves, "1:ACC001", "2022-09-01", "2022-09-10").collect()
    assert [r.amount_paid for r in got] == [9000.0, 8500.0, 9500.0]


def test_account_summary(moves, people):
    got = {r.account_id: r for r in graph.account_summary(moves, people).collect()}
    suspect = got["1:ACC001"]
    assert (suspect.total_transactions, suspect.total_sent, suspect.total_received, suspect.distinct_counterparties) == (5, 50000.0, 27050.0, 4)
    assert suspect.first_activity == dt.datetime(2022, 8, 1, 8) and suspect.last_activity == dt.datetime(2022, 9, 15, 11)
    assert (got["9:NONE"].total_transactions, got["9:NONE"].total_sent, got["9:NONE"].first_activity) == (0, 0.0, None)


def test_self_transfer_counts_once(spark, people):
    df = spark.createDataFrame([("2022-01-01", "9:NONE", "9:NONE", 5.0, 7.0, "ACH", 0)], SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    row = graph.account_summary(df, people.filter("account_id = '9:NONE'")).first()
    assert (row.total_transactions, row.total_sent, row.total_received, row.distinct_counterparties) == (1, 7.0, 5.0, 1)


def hops(moves, spark, seed, n, least=0.0, most=graph.MAX_HOPS):
    seeds = spark.createDataFrame([(seed,)], "seed_id STRING")
    return {r.account_id: (r.hop, r.total_amount, r.transaction_count) for r in graph.k_hop(moves, seeds, n, least, most).collect()}


def test_neighbours(moves, spark):
    one = hops(moves, spark, "1:ACC001", 1)
    assert one == {"1:ACC002": (1, 9050.0, 2), "1:ACC003": (1, 8500.0, 1), "1:ACC004": (1, 9500.0, 1), "2:ACC010": (1, 50000.0, 1)}
    assert hops(moves, spark, "1:ACC001", 2)["3:ACC020"] == (2, 45000.0, 1)
    assert set(hops(moves, spark, "1:ACC001", 9, 10_000, 9)) == {"2:ACC010", "3:ACC020"}
    with pytest.raises(ValueError):
        hops(moves, spark, "1:ACC001", 9)


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [("2022-01-01", f"a{rng.randrange(12)}", f"a{rng.randrange(12)}", float(rng.randrange(1, 100)), float(rng.randrange(1, 100)), "ACH", 0) for _ in range(25)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    frontier, visited, wanted = {"a0"}, {"a0"}, {}
    for hop in (1, 2, 3):
        totals = defaultdict(lambda: [0.0, 0])
        for _, f, t, received, paid, *_ in rows:
            if f in frontier or t in frontier:
                other = t if f in frontier else f
                totals[other][0] += paid if f in frontier else received
                totals[other][1] += 1
        new = {k: v for k, v in totals.items() if k not in visited}
        wanted |= {k: (hop, v[0], v[1]) for k, v in new.items()}
        visited |= set(new)
        frontier = set(new)
    assert hops(df, spark, "a0", 3) == wanted


def test_small_transfers_are_dropped_below_the_join_that_makes_them(spark):
    """The amounts are columns of one side: only rows that pass the threshold may reach the join, for every hop."""
    ends = spark.createDataFrame([(i, f"a{i}") for i in range(4)], "k INT, from_id STRING")
    amounts = spark.createDataFrame([(i % 4, f"a{(i + 1) % 4}", float(i), float(i)) for i in range(40)], "k INT, to_id STRING, amount_paid DOUBLE, amount_received DOUBLE")
    joined = amounts.join(ends, "k").selectExpr("from_id", "to_id", "timestamp '2022-01-01 00:00:00' AS ts", "amount_paid", "amount_received")
    found = graph.k_hop(joined, spark.createDataFrame([("a0",)], "seed_id STRING"), 3, 36.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    drops = [i for i, line in enumerate(plan) if "greatest(amount_paid" in line and "Filter" in line]
    assert drops and all(any("Join Inner" in above and "(k#" in above and depth(above) < depth(plan[i]) for above in plan[:i]) for i in drops), "\n".join(plan)
    assert {r.account_id: (r.hop, r.total_amount) for r in found.collect()} == {"a1": (1, 36.0), "a3": (1, 39.0), "a2": (2, 75.0)}


def test_subgraph(moves, spark):
    chosen = spark.createDataFrame([(i,) for i in IDS], "account_id STRING")
    top = graph.subgraph(moves, chosen, 2).orderBy("place").collect()
    assert [(r.from_id, r.to_id, r.total_amount) for r in top] == [("1:ACC001", "2:ACC010", 50000.0), ("2:ACC010", "3:ACC020", 45000.0)]
    assert all(r.truncated for r in top)
    assert not any(r.truncated for r in graph.subgraph(moves, chosen, 50).collect())


def test_structuring(moves, people):
    got = {r.account_id: r for r in graph.structuring_check(moves, 30, accounts=people).collect()}
    hit = got["1:ACC001"]
    assert (hit.deposit_count, hit.total_deposits, hit.flagged) == (3, 27000.0, True)
    assert hit.rationale == "3 deposits under 10,000 totaling 27,000.00 within the trailing 30 days -- classic structuring signature"
    assert got["3:ACC020"].flagged is False and "0 sub-threshold deposits totaling 0.00" in got["3:ACC020"].rationale
    assert got["9:NONE"].rationale == "no deposits found for this account"
    assert {r.account_id: r for r in graph.structuring_check(moves, 5).collect()}["1:ACC001"].flagged is False


def test_latest_disposition(spark):
    log = spark.createDataFrame([("a", "cleared", "x", "2024-01-01"), ("a", "escalate", "y", "2024-01-02"), ("b", "monitor", "z", "2024-01-01")],
                                "account_id STRING, disposition STRING, rationale STRING, recorded_at STRING")
    assert {r.account_id: r.disposition for r in graph.latest_disposition(log).collect()} == {"a": "escalate", "b": "monitor"}


def test_seed_alert(moves):
    first = graph.seed_alert(moves, 42).first()
    assert first.account_id == "1:ACC001" and first == graph.seed_alert(moves, 42).first()
    with pytest.raises(ValueError):
        graph.seed_alert(moves.filter("is_laundering = 0"))


def test_sample_keeps_labels_and_patterns(moves, spark):
    chosen = graph.sample_accounts(moves, 4, 42)
    ids = {r.account_id for r in chosen.collect()}
    assert len(ids) == 4 and {"1:ACC001", "2:ACC010"} <= ids
    assert {r.account_id for r in graph.sample_accounts(moves, 1, 42).collect()} == {"1:ACC001", "2:ACC010"}
    stats = graph.sample_stats(moves, graph.subsample(moves, 4))
    assert graph.assert_labels_kept(stats).first().kept
    with pytest.raises(Exception, match="labelled transfers were lost"):
        graph.assert_labels_kept(graph.sample_stats(moves, moves.filter("is_laundering = 0"))).collect()
    chains = spark.createDataFrame([(1, "FAN-IN", "1:ACC001", "2:ACC010"), (2, "CYCLE", "1:ACC001", "7:GONE")], "pattern_id INT, typology STRING, from_id STRING, to_id STRING")
    assert [(r.pattern_id, r.account_id) for r in graph.broken_patterns(chains, chosen.select("account_id")).collect()] == [(2, "7:GONE")]
    assert tuple(graph.pattern_connectivity(chains, chosen).first()) == (2, 1)


def test_orphans(moves, spark):
    known = spark.createDataFrame([(i,) for i in IDS[:-1]], "account_id STRING")
    assert [(r.to_id, r.missing_end) for r in graph.orphan_edges(moves, known).collect()] == [("3:ACC020", "to")]


def test_adjacency_reads_only_the_buckets_of_the_frontier(spark, moves, tmp_path):
    table = adjacency.write_adjacency(moves, str(tmp_path / "sides"), 8)
    for n in (1, 2, 3):
        assert hops(table, spark, "1:ACC001", n) == hops(moves, spark, "1:ACC001", n)
    one = spark.createDataFrame([("1:ACC001",), (None,)], "account_id STRING")
    read = table.rows_of(one)
    assert sorted(tuple(r) for r in read.collect()) == sorted(tuple(r) for r in adjacency.touching(moves, one).collect())
    bucket = one.filter("account_id IS NOT NULL").select(table.bucket()).first()[0]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert f"(bucket#" in plan and f"= {bucket})" in plan and "PartitionFilters" in plan
    assert table.rows_of(one.filter("false")).count() == 0


def test_three_seeds_do_not_shuffle_all_transfers(spark, moves):
    seeds = spark.createDataFrame([("1:ACC001",), ("2:ACC010",), ("3:ACC020",)], "seed_id STRING")
    found = graph.k_hop(moves, seeds, 1)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan and "SortMergeJoin" not in plan


def test_sides_with_null_ends(spark):
    rows = [("2022-01-01", None, "b", 1.0, 2.0, "ACH", 0), ("2022-01-01", "a", None, 3.0, 4.0, "ACH", 0), ("2022-01-01", None, None, 5.0, 6.0, "ACH", 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(r.account_id, r.other, r.sent, r.received) for r in adjacency.sides(df).collect()}
    assert got == {(None, "b", 2.0, 0.0), ("b", None, 0.0, 1.0), ("a", None, 4.0, 0.0), (None, "a", 0.0, 3.0), (None, None, 6.0, 5.0)}


def test_bundles_list_transfers_and_neighbours(spark, moves, tmp_path):
    alerts = spark.createDataFrame([("1:ACC001",), ("1:ACC001",), ("9:NONE",), (None,)], "account_id STRING")
    table = adjacency.write_adjacency(moves, str(tmp_path / "sides"), 4)
    for source in (moves, table):
        got = {r.account_id: r for r in graph.alert_bundles(alerts, source, "2022-09-01", "2022-09-10", 2, 3).collect()}
        suspect = got["1:ACC001"]
        assert len(got) == 3 and (suspect.transfers_total, suspect.neighbours_total) == (3, 4)
        assert [(t.other, t.received) for t in suspect.transfers] == [("1:ACC004", 9500.0), ("1:ACC003", 8500.0)]
        assert [(n.account_id, n.total_amount, n.transaction_count) for n in suspect.neighbours] == [
            ("2:ACC010", 50000.0, 1), ("1:ACC004", 9500.0, 1), ("1:ACC002", 9050.0, 2)]
        for empty in ("9:NONE", None):
            assert (got[empty].transfers_total, got[empty].neighbours_total, got[empty].transfers, got[empty].neighbours) == (0, 0, [], [])


def test_cap_of_the_subgraph_is_a_parameter(spark, moves):
    alerts = spark.createDataFrame([("1:ACC001",)], "account_id STRING")
    few = graph.alert_subgraphs(alerts, moves, max_neighbours=1).first()
    whole = graph.alert_subgraphs(alerts, moves, max_neighbours=None).first()
    assert (few.neighbours_total, few.subgraph_edges) == (4, 1) and (whole.neighbours_total, whole.subgraph_edges, whole.truncated) == (4, 4, False)


def test_subgraph_pairs_are_shuffled_and_right(spark):
    draw = random.Random(5)
    ids = [f"1:{i}" for i in range(12)]
    rows = [("2022-01-01", draw.choice(ids), draw.choice(ids), float(a), float(a), "ACH", 0) for a in range(1, 61)]
    moves = spark.createDataFrame([*rows, ("2022-01-01", None, "1:0", 9.0, 9.0, "ACH", 0)], SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    alerts = spark.createDataFrame([(i,) for i in [*ids[:5], None, "9:NONE"]], "account_id STRING")
    found = graph.alert_subgraphs(alerts, moves, max_edges=7, max_neighbours=3)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [from_id" in plan  # the pairs of 26 members each look as small as the members' table, and were broadcast
    got = {r.seed_id: (r.neighbours_total, r.subgraph_edges, r.subgraph_amount, r.truncated) for r in found.collect()}
    edges, around = defaultdict(float), defaultdict(lambda: defaultdict(float))
    for _, a, b, paid, *_ in rows:
        edges[a, b] += paid
        if a != b:
            around[a][b] += paid
            around[b][a] += paid
    want = {}
    for seed in [*ids[:5]]:
        if around[seed]:
            members = {seed, *sorted(around[seed], key=lambda x: (-around[seed][x], x))[:3]}
            inside = sorted((v for (a, b), v in edges.items() if a in members and b in members), reverse=True)
            want[seed] = (len(around[seed]), min(7, len(inside)), sum(inside[:7]), len(inside) > 7)
    assert {k: v for k, v in got.items() if k in ids[:5]} == want and "9:NONE" not in got
