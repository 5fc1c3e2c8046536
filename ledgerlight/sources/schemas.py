"""Explicit schemas of every table read from files; nothing is inferred."""

TRANSFER_CSV = """
    ts STRING, from_bank STRING, from_account STRING, to_bank STRING, to_account STRING,
    amount_received STRING, receiving_currency STRING, amount_paid STRING, payment_currency STRING,
    payment_format STRING, is_laundering STRING
"""
ACCOUNT_CSV = "bank_name STRING, bank_id STRING, account_number STRING, entity_id STRING, entity_name STRING"
WATCHLIST_CSV = """
    ent_num STRING, name STRING, sdn_type STRING, program STRING, title STRING, call_sign STRING,
    vess_type STRING, tonnage STRING, grt STRING, vess_flag STRING, vess_owner STRING, remarks STRING
"""
ALIAS_CSV = "ent_num STRING, alt_num STRING, alt_type STRING, alt_name STRING, alt_remarks STRING"
CALL_FILES = """
    id BIGINT, trace_id STRING, span_id STRING, parent_id BIGINT, timestamp TIMESTAMP, status STRING,
    agent_id STRING, session_id STRING, server STRING, tool STRING, args_hash STRING, args_redacted STRING,
    policies_fired STRING, decision STRING, latency_ms INT, tokens STRING, hitl_ticket_id STRING,
    hitl_reviewer STRING, hitl_decision STRING, hitl_rationale STRING, tags STRING
"""
DECISION = "outcome STRING, fired_policy STRING, reason STRING"
POLICIES_FIRED = "array<struct<policy:string,effect_type:string>>"
TOKENS = "prompt STRING, completion STRING, provider STRING, cost_usd STRING"
SCENARIO = """
    id STRING, attack_class STRING, description STRING,
    calls ARRAY<STRUCT<server: STRING, tool: STRING, args: STRING>>,
    expected STRUCT<status: STRING, policy_fired: STRING, response_contains: STRING,
        response_not_contains: STRING, tags_include: ARRAY<STRING>, incident_expected: BOOLEAN>
"""
# The 19 columns of the published call table.
PUBLISHED_COLUMNS = [
    "trace_id", "span_id", "timestamp", "status", "agent_id", "session_id", "server", "tool",
    "args_hash", "args_redacted", "policies_fired", "decision", "latency_ms", "tokens", "hitl_ticket_id",
    "hitl_reviewer", "hitl_decision", "hitl_rationale", "tags",
]
