"""Policy packs as rows of a rules table.

A rule is one row: its name, where it applies, its effect with the fields that
effect needs (null otherwise), and its audit tags. Rows keep declaration order
in ``position``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RULE_SCHEMA = """
    position INT, policy STRING, server STRING, tools ARRAY<STRING>, effect STRING,
    reason STRING, limit_calls INT, window_seconds INT, custom_name STRING, stage STRING,
    reviewer_group STRING, timeout_seconds INT, session_limit_usd DOUBLE, warn_at_ratio DOUBLE,
    patterns ARRAY<STRING>, severity STRING, tags ARRAY<STRING>
"""

# The rules of the three packs.
AML_PACK = [
    dict(policy="aml-audit-tagging", server="*", tools=["*"], effect="tag_only", tags=["pack:aml", "regulation:BSA"]),
    dict(policy="aml-pii-redaction", server="*", tools=["*"], effect="pii_redaction",
         patterns=["ssn", "credit_card", "bank_account"], tags=["aml", "pii-redaction"]),
    dict(policy="aml-rate-limit-sanctions", server="ofac-sanctions", tools=["check_entity"], effect="rate_limit",
         limit_calls=60, window_seconds=60, tags=["aml", "rate-limit"]),
    dict(policy="aml-sanctions-required", server="transaction-graph",
         tools=["query_transactions", "neighbors", "subgraph", "structuring_check", "mark_investigated"],
         effect="custom", custom_name="aml_sanctions_required", stage="request", severity="medium",
         tags=["aml", "sanctions-precondition"]),
    dict(policy="aml-structuring-alert", server="transaction-graph", tools=["structuring_check"], effect="custom",
         custom_name="aml_structuring_alert", stage="response", severity="high", tags=["aml", "structuring-alert"]),
    dict(policy="aml-write-hitl-gate", server="transaction-graph", tools=["mark_investigated"], effect="hitl_gate",
         reviewer_group="aml-analysts", timeout_seconds=3600, severity="high", tags=["aml", "write", "hitl"]),
]
DEMO_PACK = [
    dict(policy="hello-echo-no-dangerous-tool", server="hello-echo", tools=["dangerous_tool"], effect="denylist",
         reason="dangerous_tool is denylisted for this local demo", severity="high", tags=["demo"]),
    dict(policy="hello-echo-hitl-timeout-test-tool", server="hello-echo", tools=["hitl_timeout_tool"],
         effect="hitl_gate", reviewer_group="test-reviewers", timeout_seconds=2, severity="medium", tags=["demo"]),
    dict(policy="hello-echo-hitl-test-tool", server="hello-echo", tools=["hitl_tool"], effect="hitl_gate",
         reviewer_group="test-reviewers", timeout_seconds=30, severity="medium", tags=["demo"]),
    dict(policy="hello-echo-throttle-test-tool", server="hello-echo", tools=["throttled_tool"], effect="rate_limit",
         limit_calls=1, window_seconds=60, tags=["demo"]),
]
ADVERSARIAL_PACK = [
    dict(policy="adversarial-chained-denylist", server="hello-echo", tools=["dangerous_tool"], effect="denylist",
         reason="dangerous_tool is denylisted for this local demo", severity="high", tags=["adversarial"]),
    dict(policy="adversarial-pii-redaction", server="hello-echo", tools=["leaky_echo"], effect="pii_redaction",
         patterns=["ssn", "credit_card", "bank_account"], severity="medium", tags=["adversarial"]),
    dict(policy="adversarial-throttle", server="hello-echo", tools=["throttled_tool"], effect="rate_limit",
         limit_calls=1, window_seconds=60, tags=["adversarial"]),
    dict(policy="adversarial-allowlist", server="hello-echo", tools=["echo"], effect="allowlist", tags=["adversarial"]),
    dict(policy="adversarial-prompt-injection-scan", server="hello-echo", tools=["echo_untrusted"], effect="custom",
         custom_name="hello_echo_prompt_injection_scan", stage="response", severity="high", tags=["adversarial"]),
    dict(policy="adversarial-hitl-gate", server="hello-echo", tools=["hitl_tool"], effect="hitl_gate",
         reviewer_group="adversarial-reviewers", timeout_seconds=2, severity="medium", tags=["adversarial"]),
]
AML_MANIFEST = dict(
    name="aml",
    version="0.1.0",
    policies=["aml-sanctions-required", "aml-write-hitl-gate", "aml-pii-redaction", "aml-rate-limit-sanctions",
              "aml-structuring-alert", "aml-audit-tagging"],
)

_FIELDS = [part.split()[0] for part in RULE_SCHEMA.replace("\n", " ").split(",") if part.strip()]
_FIELDS = [field.strip() for field in _FIELDS]


def rules_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    rows = []
    for position, rule in enumerate(rules):
        defaults = {"severity": "low", "tags": [], "stage": "request" if rule["effect"] == "custom" else None}
        if rule["effect"] == "denylist":
            defaults["reason"] = "denylisted"
        if rule["effect"] == "cost_cap":
            defaults["warn_at_ratio"] = 0.8
        filled = {**defaults, **rule, "position": position}
        rows.append(tuple(filled.get(field) for field in _FIELDS))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def extended_pack() -> list[dict]:
    """The AML pack with a few extra rules so that every effect occurs in the test tables."""
    extra = [
        dict(policy="server-00-allow", server="server-00", tools=["tool_0", "tool_2"], effect="allowlist", tags=["generic"]),
        dict(policy="server-01-deny", server="server-01", tools=["*"], effect="denylist", reason="server retired",
             severity="high", tags=["generic", "retired"]),
        dict(policy="hourly-limit-sanctions", server="ofac-sanctions", tools=["check_entity"], effect="rate_limit",
             limit_calls=3, window_seconds=86400, tags=["aml", "rate-limit"]),
        dict(policy="half-day-limit-generic", server="*", tools=["tool_1", "tool_3", "tool_5"], effect="rate_limit",
             limit_calls=1, window_seconds=43200, tags=["generic"]),
        dict(policy="server-02-unknown", server="server-02", tools=["*"], effect="custom", custom_name="not_registered",
             tags=["generic"]),
    ]
    return AML_PACK + extra
