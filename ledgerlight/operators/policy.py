"""Policy evaluation: a table of calls against a table of rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators.rate_limit import busiest_key, fixed_window_limit
from ledgerlight.session import cut_lineage

# Evaluation order of effects.
EFFECT_ORDER = [
    "tag_only", "allowlist", "denylist", "rate_limit", "custom", "hitl_gate", "cost_cap", "pii_redaction",
]
SEVERITIES = ["low", "medium", "high"]
# Which completed calls count as a sanctions check, and what is said when there was none.
SANCTIONS_TOOLS = ["check_entity", "check_alias"]
NO_SANCTIONS_CHECK = (
    "no prior OFAC sanctions check (check_entity/check_alias) found for this "
    "agent before a transaction-graph call"
)

RequestRule = Callable[[DataFrame, DataFrame], DataFrame]
REQUEST_RULES: dict[str, RequestRule] = {}
RESPONSE_RULES: dict[str, Callable[[DataFrame], Column]] = {}


def register_request_rule(name: str) -> Callable[[RequestRule], RequestRule]:
    """Register ``fn(calls, log) -> DataFrame(id, reason)``; a null reason lets the call pass."""

    def add(fn: RequestRule) -> RequestRule:
        if name in REQUEST_RULES:
            raise ValueError(f"a request rule named {name!r} is already registered")
        REQUEST_RULES[name] = fn
        return fn

    return add


def register_response_rule(name: str):
    """Register ``fn(responses) -> Column`` of an array of tags."""

    def add(fn):
        if name in RESPONSE_RULES:
            raise ValueError(f"a response rule named {name!r} is already registered")
        RESPONSE_RULES[name] = fn
        return fn

    return add


@register_request_rule("aml_sanctions_required")
def prior_check(calls: DataFrame, log: DataFrame) -> DataFrame:
    """Deny calls of agents with no earlier completed sanctions check.

    The earliest check per agent is enough, so this is one mergeable ``min`` and
    an equi-join instead of a range join.
    """
    checks = (
        log.filter(
            (F.col("server") == "ofac-sanctions") & F.col("tool").isin(SANCTIONS_TOOLS) & (F.col("status") == "COMPLETED")
        )
        .groupBy("agent_id")
        .agg(F.min("id").alias("first_check"))
    )
    seen = F.coalesce(F.col("first_check") < F.col("id"), F.lit(False))
    return calls.join(checks, "agent_id", "left").select("id", F.when(~seen, F.lit(NO_SANCTIONS_CHECK)).alias("reason"))


def check_rules(rules: DataFrame) -> DataFrame:
    """Rules that break a field check, with the reason."""
    problem = (
        F.when(~F.col("effect").isin(EFFECT_ORDER), "unknown effect")
        .when(~F.col("severity").isin(SEVERITIES), "unknown severity")
        .when(F.col("policy").isNull() | F.col("server").isNull() | F.col("tools").isNull(), "missing field")
        .when(
            (F.col("effect") == "rate_limit")
            & ~F.coalesce((F.col("limit_calls") > 0) & (F.col("window_seconds") > 0), F.lit(False)),
            "rate limit needs a positive limit and window",
        )
        .when(
            (F.col("effect") == "hitl_gate")
            & ~F.coalesce(F.col("reviewer_group").isNotNull() & (F.col("timeout_seconds") > 0), F.lit(False)),
            "hold needs a reviewer group and a positive timeout",
        )
        .when((F.col("effect") == "custom") & F.col("custom_name").isNull(), "custom rule needs a name")
        .when(
            (F.col("effect") == "custom") & ~F.col("stage").isin("request", "response"),
            "custom rule stage must be request or response",
        )
        .when(
            (F.col("effect") == "cost_cap")
            & ~F.coalesce(
                (F.col("session_limit_usd") > 0) & (F.col("warn_at_ratio") > 0) & (F.col("warn_at_ratio") <= 1),
                F.lit(False),
            ),
            "cost cap needs a positive limit and a ratio in (0, 1]",
        )
    )
    return rules.select("policy", problem.alias("problem")).filter("problem IS NOT NULL")


def duplicate_rules(rules: DataFrame) -> DataFrame:
    return rules.groupBy("policy").agg(F.count("*").alias("copies")).filter("copies > 1")


def manifest_drift(rules: DataFrame, manifest: DataFrame) -> DataFrame:
    """Names listed but absent (``missing``) and present but not listed (``extra``)."""
    listed = manifest.select(F.explode("policies").alias("policy"))
    present = rules.select("policy")
    missing = listed.exceptAll(present).distinct().withColumn("drift", F.lit("missing"))
    extra = present.exceptAll(listed).distinct().withColumn("drift", F.lit("extra"))
    return missing.unionByName(extra)


def match_rules(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that apply to each distinct (server, tool) pair of the calls.

    "Equal or wildcard" becomes an equi-join: each pair looks up its four keys
    (server or ``*``, tool or ``*``) among the rules' exploded tools.
    """
    pairs = calls.select("server", "tool").distinct()
    keys = pairs.select(
        "server",
        "tool",
        F.explode(F.array(F.col("server"), F.lit("*"))).alias("rule_server"),
    ).select("*", F.explode(F.array(F.col("tool"), F.lit("*"))).alias("rule_tool"))
    keyed = rules.withColumnRenamed("server", "rule_server").withColumn(
        "rule_tool",
        F.explode(F.when(F.array_contains("tools", "*"), F.array(F.lit("*"))).otherwise(F.array_distinct("tools"))),
    )
    return keys.join(keyed, ["rule_server", "rule_tool"]).drop("rule_server", "rule_tool")


def default_deny_servers(rules: DataFrame) -> DataFrame:
    """Servers named literally by an allow rule; a wildcard does not switch others to deny."""
    return rules.filter((F.col("effect") == "allowlist") & (F.col("server") != "*")).select("server").distinct()


def needs_response_check(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Per (server, tool): does any redaction or response-stage rule apply?"""
    response = (F.col("effect") == "pii_redaction") | ((F.col("effect") == "custom") & (F.col("stage") == "response"))
    matched = match_rules(calls, rules).groupBy("server", "tool").agg(F.bool_or(response).alias("needed"))
    pairs = calls.select("server", "tool").distinct()
    return pairs.join(matched, ["server", "tool"], "left").select(
        "server", "tool", F.coalesce("needed", F.lit(False)).alias("needs_response_check")
    )


def rule_sets(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Per distinct (server, tool): its rules in evaluation order, and what follows from them alone.

    Everything that does not depend on the single call is worked out here, once per
    pair. The collected array is bounded by the number of rules, never by calls.
    """
    rank = F.array_position(F.array(*[F.lit(e) for e in EFFECT_ORDER]), F.col("effect"))
    rule = F.struct(
        rank.alias("rank"), "position", "policy", "effect", "reason", "limit_calls", "window_seconds", "custom_name",
        "stage", "reviewer_group", "timeout_seconds", "session_limit_usd", "warn_at_ratio", "patterns", "tags",
    )
    pairs = calls.select("server", "tool").distinct()
    sets = match_rules(pairs, rules).groupBy("server", "tool").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    deny = default_deny_servers(rules).withColumn("default_deny", F.lit(True))
    joined = pairs.join(sets, ["server", "tool"], "left").join(deny, "server", "left")
    fired = F.transform("rules", lambda r: F.struct(r["policy"].alias("policy"), r["effect"].alias("effect_type")))
    patterns = F.flatten(F.transform(F.filter("rules", lambda r: r["effect"] == "pii_redaction"), lambda r: r["patterns"]))
    response = F.filter("rules", lambda r: (r["effect"] == "custom") & (r["stage"] == "response"))
    nothing = F.array().cast("array<string>")
    return joined.withColumns(
        {
            "default_deny": F.coalesce("default_deny", F.lit(False)),
            "static_tags": static_tags(F.col("rules")),
            "policies_fired": F.coalesce(fired, F.array().cast("array<struct<policy:string,effect_type:string>>")),
            "allow": first_rule("allowlist"),
            "deny": first_rule("denylist"),
            "hold": first_rule("hitl_gate"),
            "caps": F.filter("rules", lambda r: r["effect"] == "cost_cap"),
            "patterns": F.coalesce(F.array_distinct(patterns), nothing),
            "response_rules": F.coalesce(F.transform(response, lambda r: r["custom_name"]), nothing),
        }
    )


def static_tags(rule_array: Column) -> Column:
    """De-duplicated union of every applicable rule's tags, first seen first."""
    return F.coalesce(F.array_distinct(F.flatten(F.transform(rule_array, lambda r: r["tags"]))), F.array().cast("array<string>"))


def first_rule(effect: str, extra: Callable[[Column], Column] | None = None) -> Column:
    """First applicable rule with this effect, or null."""
    def wanted(rule: Column) -> Column:
        hit = rule["effect"] == effect
        return hit & extra(rule) if extra is not None else hit

    return F.try_element_at(F.filter("rules", wanted), F.lit(1))


def attach_rules(calls: DataFrame, rules: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Calls with the facts of their rule set; the join side has one row per (server, tool)."""
    return calls.join(rule_sets(calls, rules) if sets is None else sets, ["server", "tool"], "left")


def decide_calls(
    calls: DataFrame,
    rules: DataFrame,
    log: DataFrame | None = None,
    costs: DataFrame | None = None,
) -> DataFrame:
    """Outcome of every call: allow, deny, rate limit, custom, hold, then cost; the first that applies wins.

    ``log`` is the recorded history used by request rules (the calls themselves by
    default). ``costs(id, cost_usd)`` switches the session cost cap on.
    """
    history = calls if log is None else log
    # The rule sets are a few rows and are used by every stage below, so the pass
    # over the calls that finds them is made once.
    ruled = attach_rules(calls, rules, cut_lineage(rule_sets(calls, rules)))
    allow, deny, hold = F.col("allow"), F.col("deny"), F.col("hold")
    early = ruled.withColumn(
        "early",
        F.when(allow.isNotNull(), F.struct(F.lit("PASS").alias("outcome"), allow["policy"].alias("policy"), F.lit("allowlisted").alias("reason")))
        .when(
            F.col("default_deny"),
            F.struct(F.lit("DENY").alias("outcome"), F.lit(None).cast("string").alias("policy"), F.lit("not_on_allowlist").alias("reason")),
        )
        .when(deny.isNotNull(), F.struct(F.lit("DENY").alias("outcome"), deny["policy"].alias("policy"), deny["reason"].alias("reason"))),
    )
    undecided = early.filter("early IS NULL")
    limited = rate_limited(undecided, rules)
    custom = custom_denials(undecided, rules, history)
    joined = early.join(limited, "id", "left").join(custom, "id", "left")
    cost = F.lit(None).cast("struct<policy:string,reason:string>")
    if costs is not None:
        joined = joined.join(cost_cap_state(undecided, costs), "id", "left")
        cost = F.when(F.col("cost_state") == "over", F.struct(F.col("cost_policy").alias("policy"), F.lit("cost_cap_exceeded").alias("reason")))

    def verdict(outcome: str, policy: Column, reason: Column) -> Column:
        return F.struct(F.lit(outcome).alias("outcome"), policy.alias("policy"), reason.alias("reason"))

    decided = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(F.col("limit_policy").isNotNull(), verdict("DENY", F.col("limit_policy"), F.lit("rate_limit_exceeded")))
        .when(F.col("custom_denial").isNotNull(), verdict("DENY", F.col("custom_denial.policy"), F.col("custom_denial.reason")))
        .when(hold.isNotNull(), verdict("HOLD", hold["policy"], F.lit("hitl_required")))
        .when(cost.isNotNull(), verdict("DENY", cost["policy"], cost["reason"]))
        .otherwise(verdict("PASS", F.lit(None).cast("string"), F.lit(None).cast("string")))
    )
    held = F.col("decision.outcome") == "HOLD"
    keep = [c for c in ("ts", "agent_id", "session_id") if c in calls.columns]
    return joined.withColumn("decision", decided).select(
        "id",
        *keep,
        "server",
        "tool",
        F.col("decision.outcome").alias("outcome"),
        F.col("decision.policy").alias("fired_policy"),
        F.col("decision.reason").alias("reason"),
        F.when(held, hold["reviewer_group"]).alias("reviewer_group"),
        F.when(held, hold["timeout_seconds"]).alias("timeout_seconds"),
        "policies_fired",
        F.col("static_tags").alias("tags"),
    )


def rate_limited(ruled: DataFrame, rules: DataFrame) -> DataFrame:
    """``(id, limit_policy)`` of calls over a limit.

    Limits compose in rule order and a later one is not charged once an earlier
    one denied, so they run one after the other over the survivors; the loop is
    over the few limit rules, each step one distributed plan.
    """
    limits = (
        rules.filter("effect = 'rate_limit'").orderBy("position").select("policy", "limit_calls", "window_seconds").collect()
    )  # a handful of rule rows, never calls
    if not limits:
        return ruled.filter("false").select("id", F.lit(None).cast("string").alias("limit_policy"))
    denied = ruled.filter("false").select("id", F.lit(None).cast("string").alias("limit_policy"))
    policies = F.col("policies_fired.policy")
    subject_to_any = F.arrays_overlap(policies, F.array(*[F.lit(r["policy"]) for r in limits]))
    open_calls = cut_lineage(ruled.filter(subject_to_any).select("id", "ts", "agent_id", policies.alias("policies")))
    for limit in limits:
        subject = open_calls.filter(F.array_contains("policies", limit["policy"]))
        busiest = busiest_key(subject, ["agent_id"])
        judged = fixed_window_limit(
            subject.select("id", "ts", "agent_id"), ["agent_id"], limit["limit_calls"], limit["window_seconds"], busiest=busiest
        )
        over = cut_lineage(judged.filter(~F.col("allowed")).select("id", F.lit(limit["policy"]).alias("limit_policy")))
        denied = denied.unionByName(over)
        open_calls = open_calls.join(over.select("id"), "id", "left_anti")
    return denied


def custom_denials(ruled: DataFrame, rules: DataFrame, history: DataFrame) -> DataFrame:
    """``(id, custom_denial)``: the first request rule, in order, that gives a reason.

    A name without a registered function denies (fail closed).
    """
    request = rules.filter("effect = 'custom' AND stage = 'request'").select("position", "policy", "custom_name").collect()
    found = None
    for rule in request:  # a handful of rule rows
        subject = ruled.filter(F.array_contains("policies_fired.policy", rule["policy"]))
        known = REQUEST_RULES.get(rule["custom_name"])
        if known is None:
            judged = subject.select("id", F.lit("policy_engine_error").alias("reason"))
        else:
            judged = known(subject, history)
        part = judged.filter("reason IS NOT NULL").select(
            "id",
            F.struct(F.lit(rule["position"]).alias("position"), F.lit(rule["policy"]).alias("policy"), "reason").alias("custom_denial"),
        )
        found = part if found is None else found.unionByName(part)
    if found is None:
        return ruled.filter("false").select(
            "id", F.lit(None).cast("struct<position:int,policy:string,reason:string>").alias("custom_denial")
        )
    return found.groupBy("id").agg(F.min("custom_denial").alias("custom_denial"))


def cost_cap_state(ruled: DataFrame, costs: DataFrame) -> DataFrame:
    """``ok``, ``warn`` or ``over`` per call: the session's spend so far against every cap of the call.

    ``cost_policy`` is the first cap that is over, else the first that warns, else the first.
    """
    from ledgerlight.functions.frames import sums_to_date

    capped = ruled.filter(F.size("caps") > 0).select("id", "ts", "session_id", "caps")
    spent = sums_to_date(
        capped.join(costs.select("id", "cost_usd"), "id", "left"),
        ["session_id"],
        "ts",
        {"spent_units": F.round(F.coalesce("cost_usd", F.lit(0.0)) * 10_000_000)},
    )
    def reached(share: Callable[[Column], Column]) -> Column:
        return F.filter("caps", lambda cap: F.col("spent_units") >= F.round(cap["session_limit_usd"] * 10_000_000) * share(cap))

    judged = spent.withColumns({"over": reached(lambda cap: F.lit(1.0)), "warn": reached(lambda cap: cap["warn_at_ratio"])})
    state = F.when(F.size("over") > 0, "over").when(F.size("warn") > 0, "warn").otherwise("ok")
    telling = F.when(F.size("over") > 0, F.col("over")).when(F.size("warn") > 0, F.col("warn")).otherwise(F.col("caps"))
    return judged.select("id", telling[0]["policy"].alias("cost_policy"), (F.col("spent_units") / 10_000_000).alias("spent_usd"), state.alias("cost_state"))


def review_timeout(held: DataFrame, decisions: DataFrame) -> DataFrame:
    """First decision on each held call within its timeout; otherwise denied as timed out."""
    first = decisions.groupBy("ticket_id").agg(F.min(F.struct("decided_at", "decision", "reviewer")).alias("d"))
    deadline = F.unix_micros("ts") + F.col("timeout_seconds").cast("bigint") * 1_000_000
    in_time = F.coalesce(F.unix_micros("d.decided_at") <= deadline, F.lit(False))
    return held.join(first, held["id"] == first["ticket_id"], "left").select(
        "id",
        F.when(in_time, F.col("d.decision")).alias("hitl_decision"),
        F.when(in_time, F.col("d.reviewer")).alias("hitl_reviewer"),
        F.when(in_time & (F.col("d.decision") == "APPROVED"), "PASS").otherwise("DENY").alias("resolution"),
        F.when(~in_time, "hitl_timeout").when(F.col("d.decision") == "DENIED", "hitl_denied").alias("reason"),
    )


def pending_reviews(audit: DataFrame, as_of: str) -> DataFrame:
    """Held rows with no terminal row yet at ``as_of``, with their age."""
    moment = F.lit(as_of).cast("timestamp")
    seen = audit.filter(F.col("ts") <= moment)
    closed = seen.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id"))
    return (
        seen.filter("status = 'HELD'")
        .join(closed, "id", "left_anti")
        .withColumn("age_seconds", F.floor((F.unix_micros(moment) - F.unix_micros("ts")) / 1_000_000))
    )


def policy_version_at(calls: DataFrame, versions: DataFrame) -> DataFrame:
    """Pack version in force at each call: ``versions(server, version, valid_from, valid_to)`` do not overlap."""
    inside = (F.col("ts") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("ts") < F.col("valid_to")))
    return calls.join(versions, (calls["server"] == versions["pack_server"]) & inside, "left").drop("pack_server", "valid_from", "valid_to")
