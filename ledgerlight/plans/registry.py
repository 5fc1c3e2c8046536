"""Queries over the driver's tables, one per operator.

Results are presented in plain types: dates and times as text, arrays of text
joined with ``|``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions.frames import DAY, HOUR
from ledgerlight.functions.redact import PII_PATTERNS, has_injection_marker, pattern_hits, redact_in_order, redact_json, redact_text
from ledgerlight.operators import audit as au
from ledgerlight.operators import clusters, graph, policy, quality, rate_limit, responses, risk, scenarios, screening, shape
from ledgerlight.operators import telemetry as te
from ledgerlight.operators.adjacency import write_adjacency
from ledgerlight.plans.packs import extended_pack, rules_table
from ledgerlight.session import cut_lineage, ensure_checkpoint_dir
from ledgerlight.sources import adapters as ad
from ledgerlight.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the runs on the sparse test tables.
AS_OF = "2024-01-31"
BUCKET_US, DENIAL_US, MINUTE_US = 4 * HOUR, DAY, HOUR
WINDOW_DAYS = 90
DEPOSIT_LIMIT = 10_000.0
TARGET_ACCOUNTS = 1_000
SEED = 42
PROFILE_UNTIL = "2024-01-16"
CLUSTERS, LLOYD_ROUNDS = 4, 3


def present(df: DataFrame) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), "|")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: present(fn(spark, sf_dir))
    return fn


def _calls(s, d):
    return ad.with_policies(ad.calls(s, d))


def _pairs(s, d):
    return au.call_pairs(ad.audit(s, d))


def _rules(s):
    return rules_table(s, extended_pack())


# ---- telemetry ------------------------------------------------------------------------------------


@query
def telemetry_hourly(s, d):
    return te.telemetry_hourly(ad.calls(s, d))


@query
def policy_fires_daily(s, d):
    return te.policy_fires_daily(_calls(s, d))


@query
def review_daily(s, d):
    return te.review_daily(_pairs(s, d))


def _aml_calls(s, d):
    asked = ad.screened_names(s, d)
    wanted = asked.select("query", F.lit("entity").alias("sdn_type")).distinct()
    judged = screening.screen_best(wanted, ad.watchlist(s, d)).select("query", "is_match")
    matches = asked.join(judged, "query").select("id", "is_match")
    return _calls(s, d).join(matches, "id", "left")


@query
def aml_daily(s, d):
    return te.aml_daily(_aml_calls(s, d))


@query
def merged_latency(s, d):
    """Days and servers merged from hourly sketches; the days of the test tables are small enough for exact answers."""
    hourly = cut_lineage(te.hourly_sketches(ad.calls(s, d)))
    return te.sketch_percentiles(te.merged_sketches(hourly, F.to_date("hour").alias("day"), "server"))


@query
def merge_daily(s, d):
    calls = _calls(s, d)
    writes = calls.filter("tool = 'mark_investigated'")
    frames = [
        te.count_by(calls.filter("server = 'ofac-sanctions'"), "day", name="ofac_calls"),
        te.count_by(calls.filter("server = 'transaction-graph'"), "day", name="transaction_graph_calls"),
        te.count_by(calls.filter(F.array_contains("tags", "incident:structuring")), "day", name="structuring_alerts"),
        te.count_by(writes.filter("status = 'DENIED'"), "day", name="writes_denied"),
        te.count_by(writes.filter("hitl_decision = 'APPROVED'"), "day", name="writes_approved"),
    ]
    return te.merge_daily(frames)


@query
def cost_daily(s, d):
    return te.cost_daily(ad.call_costs(s, d))


@query
def call_counter(s, d):
    return te.call_counter(_pairs(s, d))


@query
def error_counter(s, d):
    return te.error_counter(ad.audit(s, d))


@query
def duration_histogram(s, d):
    return te.duration_histogram(ad.calls(s, d), ["server", "tool"])


@query
def histogram_quantiles(s, d):
    return te.histogram_quantile(te.duration_histogram(ad.calls(s, d), ["server"]), ["server"], [0.5, 0.95, 0.99])


@query
def policy_fire_counter(s, d):
    return te.policy_fire_counter(_calls(s, d))


@query
def call_rate_by_outcome(s, d):
    return te.call_rate(_calls(s, d), ["outcome"])


@query
def call_rate_by_server(s, d):
    return te.call_rate(ad.calls(s, d), ["server"])


@query
def upstream_error_rate(s, d):
    return te.call_rate(ad.calls(s, d).filter("status = 'UPSTREAM_ERROR'"), ["server"])


@query
def error_ratio(s, d):
    return te.error_ratio(ad.calls(s, d))


@query
def in_flight(s, d):
    """Every hundredth call is left open."""
    closed = F.when(F.col("id") % 100 != 0, F.col("closed_at"))
    return te.in_flight(_pairs(s, d).withColumn("closed_at", closed))


@query
def fires_panel(s, d):
    return te.fires_panel(te.policy_fires_daily(_calls(s, d)))


@query
def cost_by_provider(s, d):
    return te.cost_by(te.cost_daily(ad.call_costs(s, d)), "day", "provider")


@query
def cost_by_agent_day(s, d):
    return te.cost_by(te.cost_daily(ad.call_costs(s, d)), "day", "agent_id")


@query
def top_agents(s, d):
    return te.top_agents(te.cost_daily(ad.call_costs(s, d)))


@query
def top_agent_days(s, d):
    return te.top_agent_days(te.cost_daily(ad.call_costs(s, d)))


@query
def projected_month_cost(s, d):
    return te.projected_month_cost(te.cost_daily(ad.call_costs(s, d)))


@query
def over_budget(s, d):
    return te.over_budget(te.cost_daily(ad.call_costs(s, d)), limit=0.005)


@query
def review_mean_by_group(s, d):
    return te.review_mean_by_group(te.review_daily(_pairs(s, d)))


@query
def review_ratio(s, d):
    return te.stack_sums(
        te.review_daily(_pairs(s, d)), {"approved": "Approved", "denied": "Denied", "timed_out": "Timed out"}
    )


@query
def write_outcomes(s, d):
    return te.stack_sums(
        te.aml_daily(_calls(s, d).withColumn("is_match", F.lit(False))),
        {
            "mark_investigated_denied": "Denied",
            "mark_investigated_approved": "Approved",
            "mark_investigated_auto_passed": "Auto-passed",
            "structuring_alerts": "Structuring alerts",
        },
    )


@query
def sanctions_panel(s, d):
    return te.stack_daily(te.aml_daily(_aml_calls(s, d)), {"ofac_calls": "Sanctions calls", "sanctions_matches": "Sanctions matches"})


@query
def alerts_total(s, d):
    daily = te.aml_daily(_calls(s, d).withColumn("is_match", F.lit(False)))
    return daily.agg(F.sum("structuring_alerts").alias("value"))


@query
def reconcile(s, d):
    calls = ad.calls(s, d)
    return te.reconcile(calls, te.telemetry_hourly(calls))


@query
def audit_growth(s, d):
    rows = te.count_by(ad.audit(s, d).withColumn("day", F.to_date("ts")), "day", name="audit_rows")
    return te.growth(rows, te.count_by(ad.calls(s, d), "day"))


@query
def flagged_tools_top(s, d):
    flags = risk.anomaly_flags(_events(s, d))
    counted = te.count_by(flags, "tool", "anomaly_severity", name="flags")
    return te.top_n(counted, "flags", 10, "tool", "anomaly_severity")


@query
def review_percentiles(s, d):
    return te.review_percentiles(_pairs(s, d))


@query
def volume_by_outcome(s, d):
    return te.count_by(_pairs(s, d).withColumn("result", te.call_outcome()), "result")


@query
def slo_report(s, d):
    return te.slo_report(_pairs(s, d))


@query
def calls_by_agent(s, d):
    return te.count_by(ad.calls(s, d), "agent_id")


@query
def calls_by_tool(s, d):
    return te.count_by(ad.calls(s, d), "server", "tool")


@query
def cost_by_agent_policy(s, d):
    return te.cost_by_agent_policy(ad.call_costs(s, d), _calls(s, d))


@query
def top_policies(s, d):
    return te.top_policies(te.policy_fires_daily(_calls(s, d)), AS_OF)


# ---- audit log ------------------------------------------------------------------------------------


@query
def call_pairs(s, d):
    return _pairs(s, d)


@query
def agent_actions(s, d):
    return au.agent_actions(ad.audit(s, d), "agent-0007", "2024-01-05", "2024-01-20").select(
        "id", "ts", "server", "tool", "status", "reason"
    )


@query
def session_replay(s, d):
    return au.session_replay(ad.audit(s, d), "s-7-2024-01-10").select("id", "parent_id", "ts", "server", "tool", "status")


@query
def reviewer_decisions(s, d):
    return au.reviewer_decisions(ad.audit(s, d)).select("id", "hitl_reviewer", "hitl_decision", "hitl_rationale")


@query
def decision_events(s, d):
    return au.decision_events(ad.audit(s, d)).groupBy("status", "outcome").agg(
        F.count("*").alias("events"), F.max("id").alias("last_id")
    )


@query
def archive_tiers(s, d):
    tiered = au.archive_tiers(ad.calls(s, d), "2024-03-15")
    return tiered.groupBy("tier").agg(F.count("*").alias("calls"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query
def redaction_proof(s, d):
    calls = ad.calls(s, d).withColumn("args", F.struct(F.col("tool").alias("z_tool"), "agent_id", "k"))
    text = F.format_string('{"agent_id":"%s","k":%d,"z_tool":"%s"}', "agent_id", "k", "tool")
    stored = calls.withColumn("stored_hash", F.sha2(F.when(F.col("k") == 13, F.concat(text, F.lit(" "))).otherwise(text), 256))
    return au.redaction_proof(stored, "args", "stored_hash").select("id", "recomputed_hash", "matches")


BODY_COLUMNS = ["agent_id", "parent_id", "server", "session_id", "status", "timestamp", "tool"]


def _entries(s, d):
    rows = ad.audit(s, d).withColumnRenamed("ts", "timestamp")
    return rows.select("id", "timestamp", au.canonical_json(rows, BODY_COLUMNS).alias("body"))


@query
def canonical_entries(s, d):
    entries = _entries(s, d)
    return entries.select("id", "body", F.sha2(F.concat(F.lit(au.GENESIS), "body"), 256).alias("entry_hash"))


@query
def chain_build(s, d):
    return au.build_chain(_entries(s, d)).select("id", "block", "prev_hash", "this_hash")


@query
def chain_seal(s, d):
    return au.seal_blocks(au.build_chain(_entries(s, d)))


@query
def chain_root(s, d):
    return au.seal_root(au.build_chain(_entries(s, d)))


@query
def canonical_numbers(s, d):
    """Doubles of all sizes, and a map, as canonical JSON."""
    price, quantity, discount = (F.col(f"l_{c}").cast("double") for c in ("extendedprice", "quantity", "discount"))
    rows = ad.table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", price.alias("price"), (price / quantity).alias("each"), (discount / 1e7).alias("tiny"), (price * 1e15).alias("huge"),
        F.create_map(F.lit("z"), quantity / 3, F.lit("a"), discount * 1e4).alias("parts"),
    )
    return rows.select("l_orderkey", "l_linenumber", au.canonical_json(rows, ["price", "each", "tiny", "huge", "parts"]).alias("body"))


def _tampered(s, d):
    """The built chain with one agent's statuses edited and one agent's links cut afterwards."""
    chained = cut_lineage(au.build_chain(_entries(s, d)))
    edited = F.regexp_replace("body", '"status":"COMPLETED"', '"status":"DENIED"')
    return chained.withColumns(
        {
            "body": F.when(F.contains("body", F.lit('"agent_id":"agent-0004"')), edited).otherwise(F.col("body")),
            "prev_hash": F.when(
                F.contains("body", F.lit('"agent_id":"agent-0007"')) & F.contains("body", F.lit('"status":"HELD"')), F.lit("f" * 64)
            ).otherwise(F.col("prev_hash")),
        }
    )


def _checks(rows):
    expected = F.sha2(F.concat("prev_hash", "body"), 256)
    return au.chain_checks(rows, expected, restart="block")


@query
def chain_verify(s, d):
    # A chained log is a stored table; verification reads its hashes twice.
    rows = cut_lineage(au.build_chain(_entries(s, d), keep=("timestamp",)).withColumnRenamed("timestamp", "ts"))
    return au.verify_chain(_checks(rows), since="2024-01-15").select("valid", "checked", "total", "in_scope")


@query
def chain_verify_tampered(s, d):
    return au.verify_chain(_checks(_tampered(s, d))).select("valid", "checked", "first_mismatch_id", "detail", "total")


@query
def tampered_entries(s, d):
    return au.broken_entries(_checks(_tampered(s, d))).select("id", "block", "problem")


# ---- policy ---------------------------------------------------------------------------------------


@query
def match_rules(s, d):
    return policy.match_rules(ad.calls(s, d), _rules(s)).select("server", "tool", "policy", "effect")


@query
def rule_sets(s, d):
    sets = policy.rule_sets(ad.calls(s, d), _rules(s))
    return sets.select("server", "tool", F.col("rules.policy").alias("policies"), "default_deny", "static_tags")


@query
def needs_response_check(s, d):
    return policy.needs_response_check(ad.calls(s, d), _rules(s))


@query
def prior_check(s, d):
    calls = ad.calls(s, d).filter("server = 'transaction-graph'")
    return policy.prior_check(calls, ad.calls(s, d)).select("id", F.col("reason").isNotNull().alias("denied"))


@query
def fixed_window_limit(s, d):
    calls = ad.calls(s, d).select("id", "ts", "agent_id")
    return rate_limit.fixed_window_limit(calls, ["agent_id"], 1, 21600).select("id", "agent_id", "window_start", "call_in_window", "allowed")


@query
def sliding_limit(s, d):
    calls = ad.calls(s, d).select("id", "ts", "agent_id")
    return rate_limit.sliding_limit(calls, ["agent_id"], 2, 21600).select("id", "in_window", "allowed")


@query
def decide_calls(s, d):
    decided = policy.decide_calls(ad.calls(s, d), _rules(s))
    return decided.select(
        "id", "outcome", "fired_policy", "reason", F.col("reviewer_group"),
        F.coalesce("timeout_seconds", F.lit(0)).alias("timeout_seconds"),
        F.col("policies_fired.policy").alias("policies"), "tags",
    )


@query
def cost_cap(s, d):
    from ledgerlight.plans.packs import rules_table as table

    cap = [
        dict(policy="session-cost-cap", server="*", tools=["*"], effect="cost_cap", session_limit_usd=0.01),
        dict(policy="tight-cost-cap", server="transaction-graph", tools=["*"], effect="cost_cap", session_limit_usd=0.005),
    ]
    ruled = policy.attach_rules(ad.calls(s, d), table(s, cap))
    state = policy.cost_cap_state(ruled, ad.call_costs(s, d))
    return state.select("id", F.round("spent_usd", 7).alias("spent_usd"), "cost_state", "cost_policy")


def _held(s, d):
    return ad.audit(s, d).filter("status = 'HELD'").withColumn("timeout_seconds", F.lit(90))


@query
def review_timeout(s, d):
    decided = ad.audit(s, d).filter("hitl_decision IS NOT NULL").select(
        F.col("parent_id").alias("ticket_id"),
        F.col("ts").alias("decided_at"),
        F.col("hitl_decision").alias("decision"),
        F.col("hitl_reviewer").alias("reviewer"),
    )
    return policy.review_timeout(_held(s, d), decided)


@query
def pending_reviews(s, d):
    return policy.pending_reviews(ad.audit(s, d).filter("coalesce(k, 0) <> 17 OR parent_id IS NULL"), "2024-01-20 12:00:00").select(
        "id", "agent_id", "reviewer_group", "age_seconds"
    )


def _responses(s, d):
    texts = ad.table(s, d, "documents").select("doc_id", F.col("text").alias("payload"))
    calls = _calls(s, d)
    joined = calls.join(texts, F.pmod("id", F.lit(texts.count())) == texts["doc_id"])
    flagged = (F.col("tool") == "structuring_check") & (F.col("k") >= 80)
    return joined.select("id", "ts", "session_id", "server", "tool", "payload", flagged.alias("flagged"))


@query
def evaluate_responses(s, d):
    return responses.evaluate_responses(_responses(s, d), _rules(s)).select(
        "id", F.md5("payload").alias("payload_md5"), "tags", "response_tags"
    )


@query
def structuring_flags(s, d):
    return responses.structuring_flags(_responses(s, d)).select("id", "session_id", "flag_from", "flag_until", "tags")


@query
def redact_payloads(s, d):
    clean = redact_text(F.col("text"), list(PII_PATTERNS))
    return ad.payloads(s, d).select("payload_id", F.md5(clean).alias("clean_md5"), (clean != F.col("text")).alias("changed"))


@query
def redact_in_rule_order(s, d):
    """Half of the payloads name their patterns from last to first."""
    names = F.array(*[F.lit(name) for name in PII_PATTERNS])
    clean = redact_in_order(F.col("text"), F.when(F.length("text") % 2 == 0, F.reverse(names)).otherwise(names))
    return ad.payloads(s, d).select("payload_id", F.md5(clean).alias("clean_md5"))


@query
def redact_event_props(s, d):
    digits = F.concat(F.lit('{"note":"ssn 123-45-'), F.lpad(F.pmod("event_id", F.lit(10000)).cast("string"), 4, "0"), F.lit('","props":'), "props", F.lit("}"))
    return ad.table(s, d, "events").select("event_id", redact_json(F.when(F.col("event_id") % 50 == 0, "{broken").otherwise(digits), ["ssn"]).alias("clean"))


@query
def redaction_hits(s, d):
    return pattern_hits(ad.payloads(s, d), "text", list(PII_PATTERNS))


@query
def injection_scan(s, d):
    return responses.injection_scan(ad.payloads(s, d)).groupBy("tags").agg(F.count("*").alias("payloads"))


@query
def policy_version_at(s, d):
    calls = ad.calls(s, d)
    versions = calls.select("server").distinct().select(
        F.col("server").alias("pack_server"),
        F.inline(
            F.array(
                F.struct(F.lit("0.1.0").alias("version"), F.lit("2024-01-01").cast("timestamp").alias("valid_from"), F.lit("2024-01-12").cast("timestamp").alias("valid_to")),
                F.struct(F.lit("0.2.0").alias("version"), F.lit("2024-01-14").cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to")),
            )
        ),
    )
    return policy.policy_version_at(calls, versions).groupBy("server", "version").agg(F.count("*").alias("calls"))


# ---- risk and control plane -----------------------------------------------------------------------


@query
def rate_buckets(s, d):
    return risk.rate_buckets(ad.calls(s, d).select("id", "agent_id", "ts"), bucket_us=BUCKET_US).select("id", "rate_buckets")


@query
def anomaly_signals(s, d):
    return risk.anomaly_signals(ad.audit(s, d), BUCKET_US, DENIAL_US).select("id", "rate_buckets", "zscore", "denials_recent")


@query
def recent_denials(s, d):
    return risk.recent_denials(ad.calls(s, d).select("id", "agent_id", "ts", "status"), DENIAL_US).select("id", "denials_recent")


@query
def session_features(s, d):
    return risk.risk_snapshots(ad.audit(s, d), MINUTE_US).select(
        "id", "calls_per_minute", "unique_tools_count", "total_calls", "hitl_ticket_count", "denial_count", "risk_score"
    )


@query
def session_totals(s, d):
    return risk.session_totals(ad.audit(s, d))


@query
def risk_histogram(s, d):
    return risk.risk_histogram(risk.risk_snapshots(ad.audit(s, d), MINUTE_US))


@query
def anomaly_flags(s, d):
    flags = risk.anomaly_flags(_events(s, d))
    return flags.select("id", "agent_id", "anomaly_type", "anomaly_severity")


@query
def signal_flags(s, d):
    flags = risk.signal_flags(risk.anomaly_signals(ad.audit(s, d), BUCKET_US, DENIAL_US))
    return flags.select("id", "agent_id", "anomaly_type", "anomaly_severity")


@query
def flags_by_severity(s, d):
    flags = risk.anomaly_flags(_events(s, d))
    return risk.flags_by_severity(flags, AS_OF, 20)


def _events(s, d):
    return risk.assessed_events(ad.audit(s, d), BUCKET_US, DENIAL_US, MINUTE_US)


@query
def route_events(s, d):
    return te.count_by(_events(s, d), "path", "outcome", name="events")


@query
def incidents(s, d):
    return risk.incidents(_events(s, d)).select("id", "promotion_rule", "severity", "narrative", "recommended_response")


@query
def incidents_all_paths(s, d):
    found = risk.incidents(_events(s, d), all_paths=True, single_sanctions_denial=True)
    return te.count_by(found, "promotion_rule", "severity", name="incidents")


@query
def recent_incidents(s, d):
    return risk.recent_incidents(risk.incidents(_events(s, d)), AS_OF, 20).select("id", "ts", "agent_id", "promotion_rule", "severity")


@query
def prior_reviews(s, d):
    return risk.prior_reviews(ad.audit(s, d))


@query
def recent_calls(s, d):
    return risk.recent_calls(ad.audit(s, d), 3).select("id", "session_id", "place")


@query
def evidence_packets(s, d):
    return risk.evidence_packets(ad.audit(s, d), MINUTE_US).select(
        "id", "recent_calls", "prior_approved", "prior_denied", "risk_score", "narrative", "recommended_action", "confidence"
    )


@query
def checks_then_write(s, d):
    return risk.checks_then_write(ad.calls(s, d).select("id", "agent_id", "tool", "ts"), 2, DAY, DAY).select("id", "agent_id", "bursts_before")


@query
def usage_ratios(s, d):
    return risk.usage_ratios(ad.calls(s, d))


@query
def tool_baseline_zscores(s, d):
    return risk.tool_baseline_zscores(ad.calls(s, d))


@query
def cluster_outliers(s, d):
    return clusters.cluster_outliers(clusters.agent_profiles(ad.calls(s, d)), CLUSTERS, LLOYD_ROUNDS)


@query
def agent_profiles(s, d):
    return clusters.agent_profiles(ad.calls(s, d))


# ---- transfers ------------------------------------------------------------------------------------


@query
def account_transfers(s, d):
    return graph.account_transfers(ad.transfers(s, d), "S:3", "1996-01-01", "1996-12-31")


@query
def labelled_transfers(s, d):
    return ad.transfers(s, d).filter("is_laundering = 1").groupBy("payment_format").agg(
        F.count("*").alias("transfers"), te.money("amount_paid").alias("amount")
    )


@query
def endpoints(s, d):
    return graph.endpoints(ad.transfers(s, d))


@query
def account_summary(s, d):
    return graph.account_summary(ad.transfers(s, d), ad.accounts(s, d))


@query
def edge_totals(s, d):
    return graph.edge_totals(ad.transfers(s, d))


@query
def account_labels(s, d):
    return graph.account_labels(ad.transfers(s, d))


def _set(s, d):
    return ad.accounts(s, d).filter("bank_id IN ('3', '7', '11')").select("account_id")


@query
def induced_edges(s, d):
    return graph.edge_totals(graph.both_ends_in(ad.transfers(s, d), _set(s, d)))


@query
def top_edges(s, d):
    return graph.subgraph(ad.transfers(s, d), _set(s, d), 25)


def _hops(hops: int, min_amount: float):
    def run(s, d):
        seeds = ad.accounts(s, d).filter("account_id IN ('C:1', 'C:7', 'S:2')").select(F.col("account_id").alias("seed_id"))
        return graph.k_hop(ad.transfers(s, d), seeds, hops, min_amount)

    return run


for _n, _min in ((1, 0.0), (2, 60_000.0), (3, 90_000.0)):
    _run = _hops(_n, _min)
    _run.__name__ = f"neighbours_{_n}_hop"
    query(_run)


@query
def adjacency_hops(s, d):
    """Two hops by lookups in a table of buckets, which a caller would write once and keep."""
    where = f"{ensure_checkpoint_dir(s).rstrip('/')}/tables/{uuid.uuid4().hex}"
    seeds = ad.accounts(s, d).filter("account_id IN ('C:1', 'C:7', 'S:2')").select(F.col("account_id").alias("seed_id"))
    return graph.k_hop(write_adjacency(ad.transfers(s, d), where, 32), seeds, 2, 60_000.0)


@query
def alert_bundles(s, d):
    def cents(row, name):
        return F.round(row[name] * 100).cast("bigint").cast("string")

    found = graph.alert_bundles(_alerts(s, d), ad.transfers(s, d), "1996-01-01", "1996-12-31", 10, 5)
    return found.select(
        "account_id", "transfers_total", "neighbours_total",
        F.transform("transfers", lambda t: F.concat_ws(" ", F.date_format(t["ts"], "yyyy-MM-dd"), t["other"], cents(t, "sent"), cents(t, "received"))).alias("transfers"),
        F.transform("neighbours", lambda n: F.concat_ws(" ", n["account_id"], cents(n, "total_amount"), n["transaction_count"].cast("string"))).alias("neighbours"),
    )


@query
def cap_neighbours(s, d):
    seeds = ad.accounts(s, d).select(F.col("account_id").alias("seed_id"))
    return graph.cap_neighbours(graph.k_hop(ad.transfers(s, d), seeds, 1)).select("seed_id", "account_id", "place")


@query
def structuring_check(s, d):
    return graph.structuring_check(ad.transfers(s, d), WINDOW_DAYS, DEPOSIT_LIMIT, accounts=ad.accounts(s, d))


@query
def rolling_structuring(s, d):
    return graph.rolling_structuring(ad.transfers(s, d), 30, DEPOSIT_LIMIT)


@query
def orphan_edges(s, d):
    known = ad.accounts(s, d).filter("bank_id <> '5'")
    return graph.orphan_edges(ad.transfers(s, d), known)


@query
def broken_patterns(s, d):
    return graph.broken_patterns(ad.patterns(s, d), _set(s, d))


@query
def pattern_connectivity(s, d):
    return graph.pattern_connectivity(ad.patterns(s, d), graph.sample_accounts(ad.transfers(s, d), TARGET_ACCOUNTS))


@query
def remaining_pool(s, d):
    moves = ad.transfers(s, d)
    return graph.remaining_pool(graph.endpoints(moves), graph.account_labels(moves).select("account_id"))


@query
def seeded_fill(s, d):
    moves = ad.transfers(s, d)
    pool = graph.remaining_pool(graph.endpoints(moves), graph.account_labels(moves).select("account_id"))
    return graph.seeded_fill(pool, 500, SEED)


@query
def sample_accounts(s, d):
    return graph.sample_accounts(ad.transfers(s, d), TARGET_ACCOUNTS, SEED)


@query
def accounts_in_sample(s, d):
    return graph.accounts_in_sample(ad.accounts(s, d), graph.sample_accounts(ad.transfers(s, d), TARGET_ACCOUNTS, SEED))


@query
def subsample(s, d):
    kept = graph.subsample(ad.transfers(s, d), TARGET_ACCOUNTS, SEED)
    return kept.groupBy("from_id", "to_id", "is_laundering").agg(F.count("*").alias("transfers"))


@query
def sample_stats(s, d):
    moves = ad.transfers(s, d)
    return graph.sample_stats(moves, graph.subsample(moves, TARGET_ACCOUNTS, SEED))


@query
def rejected_transfers(s, d):
    """Transfers written as CSV, some of them spoilt by rules on their own values, and split again into good and bad."""
    where = f"{ensure_checkpoint_dir(s).rstrip('/')}/tables/{uuid.uuid4().hex}"
    day, month = F.dayofmonth("ts"), F.month("ts")
    paid = F.round(F.col("amount_paid") * 100).cast("bigint").cast("string")
    ad.transfers(s, d).select(
        F.when(day == 30, "soon").otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm")).alias("a"),
        F.when(month == 2, "none").otherwise("017").alias("b"), F.col("from_id").alias("c"), F.lit("0018").alias("d"), F.col("to_id").alias("e"),
        F.when(day == 31, "n/a").otherwise(paid).alias("f"), F.lit("Euro").alias("g"), paid.alias("h"), F.lit("Euro").alias("i"),
        F.col("payment_format").alias("j"), F.when((month == 2) & (day == 1), "2").otherwise(F.col("is_laundering").cast("string")).alias("k"),
    ).write.csv(f"{where}/csv", header=True)
    split = files.split_transfers(s, f"{where}/csv", f"{where}/split")
    good = split.good.agg(F.lit("accepted").alias("why"), F.count("*").alias("transfers"), F.sum(F.col("amount_paid").cast("bigint")).alias("cents"))
    bad = split.rejected.groupBy(F.array_join("reasons", "+").alias("why")).agg(F.count("*").alias("transfers"), F.lit(None).cast("bigint").alias("cents"))
    return good.unionByName(bad)


@query
def missing_accounts(s, d):
    members = ad.patterns(s, d).select(F.explode(F.array("from_id", "to_id")).alias("account_id")).distinct()
    return members.join(_set(s, d), "account_id", "left_anti")


@query
def seed_alert(s, d):
    return graph.seed_alert(ad.transfers(s, d), SEED)


def _alerts(s, d):
    return ad.transfers(s, d).filter("is_laundering = 1").select(F.col("from_id").alias("account_id")).distinct()


def _discovered(s, d):
    people = ad.accounts(s, d)
    alerts = _alerts(s, d)
    asked = people.join(alerts, "account_id", "left_semi").select(F.col("entity_name").alias("query"), F.lit("entity").alias("sdn_type"))
    return graph.discover(alerts, ad.transfers(s, d), people, screening.screen_best(asked.distinct(), ad.watchlist(s, d)))


@query
def discover(s, d):
    return _discovered(s, d).select(
        "account_id", "entity_name", "total_transactions", "total_sent", "distinct_counterparties",
        F.coalesce("entry_id", F.lit("")).alias("entry_id"), "score", "is_match",
    )


def _assessed(s, d):
    found = graph.enrich(_discovered(s, d), ad.transfers(s, d), ad.watchlist(s, d), WINDOW_DAYS, DEPOSIT_LIMIT)
    return graph.assess(found)


@query
def enrich(s, d):
    return _assessed(s, d).select(
        "account_id", "neighbours_total", "subgraph_edges", "subgraph_amount", "truncated", "deposit_count", "flagged", "listed_program"
    )


@query
def assess(s, d):
    return _assessed(s, d).select("account_id", "risk_level", "key_findings")


@query
def investigation_reports(s, d):
    return graph.report(graph.recommend(_assessed(s, d), AS_OF))


def _disposition_log(s, d):
    """Every labelled payment writes a disposition for its sender; the last one counts."""
    moves = ad.transfers(s, d).filter("is_laundering = 1")
    choice = (
        F.when(F.col("payment_format") == "ACH", "cleared").when(F.col("payment_format") == "Wire", "escalate").otherwise("monitor")
    )
    return moves.select(
        F.col("from_id").alias("account_id"), choice.alias("disposition"),
        F.concat(F.lit("paid "), "to_id").alias("rationale"), F.col("ts").alias("recorded_at"),
    )


@query
def latest_disposition(s, d):
    return graph.latest_disposition(_disposition_log(s, d))


# ---- screening ------------------------------------------------------------------------------------


@query
def normalise_names(s, d):
    listed = ad.watchlist(s, d)
    normal = screening.normalise_name(F.col("name"))
    return listed.select(
        "ent_num", normal.alias("normal"), screening.sorted_tokens(normal).alias("sorted"),
        screening.reference_url(F.col("ent_num")).alias("reference_url"),
    )


@query
def clean_fields(s, d):
    raw = ad.watchlist(s, d).select(
        "ent_num",
        F.when(F.col("sdn_type") == "entity", " -0- ").otherwise(F.concat(F.lit(" "), "sdn_type")).alias("raw_type"),
        F.concat("program", F.lit("] ["), F.upper("sdn_type")).alias("raw_program"),
    )
    return raw.select(
        "ent_num",
        F.coalesce(screening.clean_sentinel(F.col("raw_type")), F.lit("entity")).alias("sdn_type"),
        screening.split_programs(F.col("raw_program")).alias("programs"),
    )


@query
def attach_aliases(s, d):
    return screening.attach_aliases(ad.watchlist(s, d), ad.aliases(s, d)).select("ent_num", "name", "alias")


@query
def watchlist_stats(s, d):
    return screening.watchlist_stats(ad.watchlist(s, d), ad.aliases(s, d))


@query
def name_index(s, d):
    index = screening.name_index(ad.watchlist(s, d), ad.aliases(s, d))
    return index.groupBy("sdn_type", "name", "is_alias").agg(
        F.count("*").alias("entries"), F.min(F.col("ent_num").cast("bigint")).alias("first_entry")
    )


@query
def screen_best(s, d):
    queries = ad.name_queries(s, d).select("query", F.explode(F.array(F.lit("entity"), F.lit("vessel"))).alias("sdn_type"))
    return screening.screen_best(queries, ad.watchlist(s, d))


@query
def screen_top(s, d):
    return screening.screen_top(ad.name_queries(s, d), ad.watchlist(s, d), ad.aliases(s, d))


@query
def entry_detail(s, d):
    ids = ad.table(s, d, "lineitem").selectExpr("CAST(l_partkey + l_linenumber * 300 AS STRING) AS ent_num").distinct()
    return screening.entry_detail(ids, ad.watchlist(s, d)).select("ent_num", "name", "sdn_type", "program", "found")


# ---- scenarios, quality, shaping ------------------------------------------------------------------


def _judged(s, d):
    people = ad.calls(s, d).select("agent_id").distinct()
    digit = F.substring("agent_id", -1, 1)
    expected = F.struct(
        F.when(digit.isin("0", "5"), "DENIED").otherwise("COMPLETED").alias("status"),
        F.when(digit == "3", "aml-write-hitl-gate").alias("policy_fired"),
        F.when(digit == "1", "a").alias("response_contains"),
        F.when(digit == "2", "e").alias("response_not_contains"),
        F.when(digit == "4", F.array(F.lit("pack:aml"), F.lit("severity:high"))).otherwise(F.array(F.lit("pack:aml"))).alias("tags_include"),
        (digit == "6").alias("incident_expected"),
    )
    cases = people.select(F.concat(F.lit("case-"), "agent_id").alias("id"), "agent_id", F.concat(F.lit("class-"), digit).alias("attack_class"), expected.alias("expected"))
    last = scenarios.last_entry(ad.audit(s, d))
    answers = last.select("agent_id", (F.col("status") == "COMPLETED").alias("ok"), "last_id")
    turns = ad.table(s, d, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    spread = F.pmod(F.floor(answers["last_id"] / 2), F.lit(turns.count()))
    texted = answers.join(turns, spread == turns["conv_id"], "left").select("agent_id", "ok", "text")
    found = risk.incidents(_events(s, d)).select("agent_id")
    return scenarios.judge_scenarios(cases, ad.audit(s, d), texted, found)


@query
def judge_scenarios(s, d):
    return _judged(s, d)


@query
def scenario_report(s, d):
    return scenarios.scenario_report(_judged(s, d))


@query
def last_entry(s, d):
    return scenarios.last_entry(ad.audit(s, d)).select("agent_id", "last_id", "status", "ts")


@query
def reject_reasons(s, d):
    judged = quality.with_reason(
        ad.calls(s, d),
        {
            "status": F.col("status").isin("COMPLETED", "DENIED"),
            "latency": F.col("latency_ms") <= 1500,
            "review": F.coalesce(F.col("hitl_decision"), F.lit("APPROVED")).isin("APPROVED"),
        },
    )
    return judged.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("result")).agg(F.count("*").alias("calls"))


@query
def invalid_dispositions(s, d):
    log = _disposition_log(s, d).withColumn("disposition", F.when(F.contains("rationale", F.lit("S:1")), "unknown").otherwise(F.col("disposition")))
    return quality.invalid_values(log, "disposition", quality.DISPOSITIONS).groupBy("account_id").agg(F.count("*").alias("rows"))


@query
def seasonal_profile(s, d):
    return shape.seasonal_profile(ad.calls(s, d), PROFILE_UNTIL)


def _windows(s, d):
    """Two hours from the busiest moments: every upstream error opens a window."""
    errors = ad.calls(s, d).filter("status = 'UPSTREAM_ERROR'")
    return errors.select(F.col("ts").alias("start"), F.timestamp_micros(F.unix_micros("ts") + 2 * HOUR).alias("end"))


@query
def in_windows(s, d):
    return shape.in_windows(ad.calls(s, d).select("id", "ts", "status"), _windows(s, d)).select("id", "in_window")


def _apportioned(s, d):
    profile = shape.seasonal_profile(ad.calls(s, d), PROFILE_UNTIL)
    return shape.apportion(profile, "weight", 5_000)


@query
def apportion(s, d):
    return _apportioned(s, d).select("weekday", "hour", "row_count")


@query
def expand_by_count(s, d):
    rows = shape.expand_by_count(_apportioned(s, d))
    draw = shape.keyed_draw("weekday", "hour", "unit")
    label = shape.label_by_cumulative(
        draw, [("DENY", 0.10), ("HELD_APPROVED", 0.06), ("HELD_DENIED", 0.02), ("UPSTREAM_ERROR", 0.02)], "PASS"
    )
    return rows.select("weekday", "hour", "unit", label.alias("label"), shape.pick(["alice", "bob", "carol", "dave"], draw).alias("reviewer"))


@query
def clip_latency(s, d):
    return ad.calls(s, d).select("id", shape.clip_latency(F.col("latency_ms") * 4 - 400).alias("latency_ms"))


@query
def append_burst(s, d):
    calls = ad.calls(s, d).select("id", "agent_id", "tool", "status")
    burst = calls.filter("tool = 'check_entity'").select(
        (F.col("id") + 1_000_000_000).alias("id"), F.lit("agent-0217").alias("agent_id"), "tool", F.lit("DENIED").alias("status")
    )
    return shape.append_burst(calls, burst).groupBy("agent_id", "status").agg(F.count("*").alias("calls"))
