"""The same queries as plain SQL, for comparison on another engine."""

from __future__ import annotations

import re

from ledgerlight.functions.redact import INJECTION_PATTERNS, PII_PATTERNS
from ledgerlight.operators import graph as gr
from ledgerlight.operators.audit import GENESIS
from ledgerlight.operators.policy import EFFECT_ORDER, NO_SANCTIONS_CHECK
from ledgerlight.operators.screening import REFERENCE_URL
from ledgerlight.operators.telemetry import DURATION_BOUNDS
from ledgerlight.plans import registry as rg
from ledgerlight.plans.packs import extended_pack
from ledgerlight.sources.adapters import ENTRY_TYPES, TYPOLOGIES

ORACLES: dict[str, str] = {}
HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def day(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def text_list(x: str) -> str:
    return f"array_to_string({x}, '|')"


def money(x: str, scale: int = 2) -> str:
    return f"coalesce(CAST(sum(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE), 0.0)"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list):
        return "CAST([" + ", ".join(_literal(v) for v in value) + "] AS VARCHAR[])"
    return str(value)


def _rules_cte() -> str:
    rows = []
    for position, rule in enumerate(extended_pack()):
        cells = [
            position, rule["policy"], rule["server"], rule["tools"], rule["effect"], EFFECT_ORDER.index(rule["effect"]) + 1,
            rule.get("reason"), rule.get("custom_name"), rule.get("stage", "request" if rule["effect"] == "custom" else None),
            rule.get("reviewer_group"), rule.get("timeout_seconds"), rule.get("tags", []), rule.get("patterns"),
        ]
        rows.append("(" + ", ".join(_literal(c) for c in cells) + ")")
    return (
        "SELECT * FROM (VALUES " + ",\n".join(rows) + ") r(position, policy, server, tools, effect, rank, reason, custom_name, stage,"
        " reviewer_group, timeout_seconds, tags, patterns)"
    )


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]', ' ', 'g'))"


def _sorted(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda t: t <> '')), ' ')"


def _score(a: str, b: str) -> str:
    def like(x: str, y: str) -> str:
        longest = f"greatest(length({x}), length({y}))"
        return f"(CASE WHEN {longest} = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({x}, {y})::DOUBLE / {longest}::DOUBLE END)"

    def words(x: str) -> str:
        return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))"

    def joined(x: str) -> str:
        return f"length(array_to_string({x}, ' '))"

    n, m = a + ".n", b + ".n"
    longer, shorter = f"greatest(length({n}), length({m}))", f"least(length({n}), length({m}))"
    scale = f"CASE WHEN 2 * {longer} < 3 * {shorter} THEN 1.0::DOUBLE WHEN {longer} <= 8 * {shorter} THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END"
    common = joined(f"list_intersect({words(n)}, {words(m)})")
    fewest = f"greatest(1, least({joined(words(n))}, {joined(words(m))}))"
    sets = f"{common}::DOUBLE / {fewest}::DOUBLE * 0.95::DOUBLE * ({scale})"
    short, long = f"CASE WHEN length({n}) <= length({m}) THEN {n} ELSE {m} END", f"CASE WHEN length({n}) <= length({m}) THEN {m} ELSE {n} END"
    apart = f"list_min(list_transform(range(1, {longer} - {shorter} + 2), lambda i: levenshtein({short}, substring({long}, i, {shorter}))))"
    part = f"CASE WHEN {shorter} > 0 AND 2 * {longer} >= 3 * {shorter} THEN (1.0::DOUBLE - {apart}::DOUBLE / {shorter}::DOUBLE) * ({scale}) ELSE 0.0::DOUBLE END"
    best = f"greatest({like(n, m)}, {like(a + '.s', b + '.s')} * 0.95::DOUBLE, {sets}, {part})"
    return f"floor({best} * 10000::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE"


_TYPES = "[" + ", ".join(f"'{t}'" for t in ENTRY_TYPES) + "]"
_TYPOLOGIES = "[" + ", ".join(f"'{t}'" for t in TYPOLOGIES) + "]"
_B, _D, _M = rg.BUCKET_US, rg.DENIAL_US, rg.MINUTE_US
_BUCKETS = ", ".join(
    f"count(*) OVER (PARTITION BY agent_id ORDER BY epoch_us(ts) RANGE BETWEEN {_B * (i + 1) - 1} PRECEDING AND {_B * i} PRECEDING)"
    for i in range(12)
)

CTES: dict[str, str] = {
    "ev": "SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "calls": """
SELECT event_id AS id, ts, CAST(ts AS DATE) AS day,
  concat('agent-', lpad(CAST(user_id % 500 AS VARCHAR), 4, '0')) AS agent_id,
  concat('s-', CAST(user_id AS VARCHAR), '-', CAST(CAST(ts AS DATE) AS VARCHAR)) AS session_id,
  CASE WHEN event_type = 'click' THEN 'ofac-sanctions'
       WHEN event_type = 'error' THEN concat('server-', lpad(CAST(k % 18 AS VARCHAR), 2, '0'))
       ELSE 'transaction-graph' END AS server,
  CASE event_type WHEN 'click' THEN 'check_entity' WHEN 'view' THEN 'query_transactions'
       WHEN 'signup' THEN 'structuring_check' WHEN 'purchase' THEN 'mark_investigated'
       ELSE concat('tool_', CAST(k % 6 AS VARCHAR)) END AS tool,
  CASE WHEN k < 10 THEN 'DENIED' WHEN k < 16 THEN 'COMPLETED' WHEN k < 18 THEN 'DENIED'
       WHEN k < 20 THEN 'UPSTREAM_ERROR' ELSE 'COMPLETED' END AS status,
  CASE WHEN k >= 10 AND k < 16 THEN 'APPROVED' WHEN k >= 16 AND k < 18 THEN 'DENIED' END AS hitl_decision,
  CAST(10 + floor(value * 10) AS INT) AS latency_ms, k
FROM ev""",
    "callp": """
SELECT *, CASE WHEN fired_policy IS NULL THEN [{'policy': 'aml-audit-tagging', 'effect_type': 'tag_only'}]
     ELSE [{'policy': 'aml-audit-tagging', 'effect_type': 'tag_only'}, {'policy': fired_policy, 'effect_type': fired_effect}] END AS policies_fired,
  CASE WHEN tool = 'structuring_check' AND k >= 80
     THEN ['pack:aml', 'regulation:BSA', 'incident:structuring', 'severity:high'] ELSE ['pack:aml', 'regulation:BSA'] END AS tags
FROM (SELECT *, CASE WHEN k < 10 THEN 'DENY' WHEN k < 18 THEN 'HOLD' ELSE 'PASS' END AS outcome,
  CASE WHEN k < 10 AND server = 'ofac-sanctions' THEN 'aml-rate-limit-sanctions'
       WHEN k < 10 AND server = 'transaction-graph' THEN 'aml-sanctions-required'
       WHEN k < 10 THEN 'generic-denylist' WHEN k < 18 THEN 'aml-write-hitl-gate' END AS fired_policy,
  CASE WHEN k < 10 AND server = 'ofac-sanctions' THEN 'rate_limit' WHEN k < 10 AND server = 'transaction-graph' THEN 'custom'
       WHEN k < 10 THEN 'denylist' WHEN k < 18 THEN 'hitl_gate' END AS fired_effect,
  CASE server WHEN 'transaction-graph' THEN 'aml-analysts' WHEN 'ofac-sanctions' THEN 'sanctions-desk' ELSE 'platform-reviewers' END AS reviewer_group
FROM calls)""",
    "costs": """
SELECT id, ts, day, agent_id, session_id, CASE WHEN k % 10 < 7 THEN 'provider-a' ELSE 'provider-b' END AS provider,
  CAST(100 + k * 15 AS BIGINT) AS prompt_tokens, CAST(20 + k * 5 AS BIGINT) AS completion_tokens,
  CAST((100 + k * 15) * 2 + (20 + k * 5) * 60 AS DOUBLE) / 10000000 AS cost_usd
FROM calls WHERE status = 'COMPLETED'""",
    "costd": f"""
SELECT day, agent_id, provider, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, {money('cost_usd', 8)} AS cost_usd
FROM costs GROUP BY ALL""",
    "audit": """
SELECT id * 2 + leg AS id, CASE WHEN leg = 1 THEN id * 2 END AS parent_id, id AS call_id,
  CASE WHEN leg = 0 THEN ts ELSE make_timestamp(epoch_us(ts) + latency_ms * 1000::BIGINT
       + CASE WHEN outcome = 'HOLD' THEN (30 + k * 5) * 1000000::BIGINT ELSE 0 END) END AS ts,
  agent_id, session_id, server, tool,
  CASE WHEN leg = 1 THEN status WHEN outcome = 'HOLD' THEN 'HELD' WHEN outcome = 'DENY' THEN 'DENIED' ELSE 'INTENT' END AS status,
  outcome, fired_policy,
  CASE WHEN k < 10 THEN 'policy_denied' WHEN k = 17 AND leg = 1 THEN 'hitl_timeout' WHEN k = 18 AND leg = 1 THEN 'upstream_unreachable'
       WHEN k = 19 AND leg = 1 THEN 'response_policy_error' WHEN k < 18 AND leg = 0 THEN 'hitl_required' END AS reason,
  policies_fired, tags, CASE WHEN leg = 1 THEN latency_ms END AS latency_ms,
  CASE WHEN leg = 1 AND k <> 17 THEN hitl_decision END AS hitl_decision,
  CASE WHEN leg = 1 AND k >= 10 AND k < 17 THEN concat('reviewer-', CAST(k % 4 AS VARCHAR)) END AS hitl_reviewer,
  CASE WHEN leg = 1 AND k >= 10 AND k < 17 THEN concat('case ', CAST(id AS VARCHAR)) END AS hitl_rationale,
  reviewer_group, CASE WHEN outcome = 'HOLD' THEN 30 + k * 5 END AS review_seconds, k
FROM callp, (VALUES (0), (1)) legs(leg) WHERE leg = 0 OR k >= 10""",
    "pairs": """
SELECT o.id, c.id AS closed_id, o.ts AS opened_at, c.ts AS closed_at, o.agent_id, o.session_id, o.server, o.tool, o.outcome,
  o.fired_policy, o.reviewer_group, o.status AS opened_as, c.status AS final_status, coalesce(c.reason, o.reason) AS reason,
  c.latency_ms, c.hitl_decision, c.hitl_reviewer,
  CASE WHEN o.status = 'HELD' THEN CAST(round((epoch_us(c.ts) - epoch_us(o.ts)) / 1000000 - coalesce(c.latency_ms, 0) / 1000) AS INT) END AS review_wait_seconds
FROM audit o LEFT JOIN audit c ON c.parent_id = o.id WHERE o.parent_id IS NULL""",
    "outcomes": """
SELECT *, CASE WHEN opened_as = 'DENIED' THEN 'deny' WHEN final_status = 'DENIED' AND reason = 'hitl_timeout' THEN 'hold_timeout'
  WHEN final_status = 'DENIED' THEN 'hold_denied' WHEN final_status = 'UPSTREAM_ERROR' THEN 'upstream_error'
  WHEN final_status = 'COMPLETED' THEN 'completed' ELSE 'open' END AS result FROM pairs""",
    "transfers": """
SELECT concat('C:', CAST(o.o_custkey AS VARCHAR)) AS from_id, concat('S:', CAST(l.l_suppkey AS VARCHAR)) AS to_id,
  l.l_shipdate AS ts, l.l_extendedprice AS amount_paid, floor(l.l_extendedprice * (1 - l.l_discount) * 100 + 0.5) / 100 AS amount_received,
  CASE l.l_returnflag WHEN 'A' THEN 'ACH' WHEN 'R' THEN 'Wire' ELSE 'Cheque' END AS payment_format,
  CASE WHEN l.l_partkey % 100 = 0 THEN 1 ELSE 0 END AS is_laundering
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "accounts": """
SELECT concat('C:', CAST(c_custkey AS VARCHAR)) AS account_id,
  CASE WHEN c_mktsegment = 'MACHINERY' AND p_name IS NOT NULL THEN concat(p_brand, ' ', p_name) ELSE c_name END AS entity_name,
  CAST(c_nationkey AS VARCHAR) AS bank_id FROM customer LEFT JOIN part ON c_custkey = p_partkey
UNION ALL SELECT concat('S:', CAST(s_suppkey AS VARCHAR)), s_name, CAST(s_nationkey AS VARCHAR) FROM supplier""",
    "watch": f"""
SELECT CAST(p_partkey AS VARCHAR) AS ent_num, concat(p_name, ' ', p_brand) AS name, list_extract({_TYPES}, p_size % 4 + 1) AS sdn_type,
  p_type AS program FROM part""",
    "alias": "SELECT CAST(p_partkey AS VARCHAR) AS ent_num, concat(p_brand, ' ', p_name) AS alias FROM part",
    "asked": "SELECT substring(concat(p_name, ' ', p_brand), 2) AS query FROM part UNION SELECT s_name FROM supplier",
    "patterns": f"""
SELECT to_id AS pattern_id, list_extract({_TYPOLOGIES}, CAST(substring(to_id, 3) AS INT) % 7 + 1) AS typology, from_id, to_id
FROM transfers WHERE is_laundering = 1""",
    "members": "SELECT DISTINCT pattern_id, typology, unnest([from_id, to_id]) AS account_id FROM patterns",
    "payloads": """
SELECT concat('d-', CAST(doc_id AS VARCHAR)) AS payload_id, text FROM documents
UNION ALL SELECT concat('c-', CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)), text FROM conversations""",
    "rules": _rules_cte(),
    "call_pairs_st": "SELECT DISTINCT server, tool FROM calls",
    "matched": """
SELECT p.server, p.tool, r.position, r.policy, r.effect, r.rank, r.reason, r.custom_name, r.stage, r.reviewer_group, r.timeout_seconds, r.tags, r.patterns
FROM call_pairs_st p JOIN rules r ON (r.server = '*' OR r.server = p.server) AND (list_contains(r.tools, '*') OR list_contains(r.tools, p.tool))""",
    "denyset": "SELECT DISTINCT server FROM rules WHERE effect = 'allowlist' AND server <> '*'",
    "tagrows": """
SELECT server, tool, rank, position, unnest(tags) AS tag, unnest(range(len(tags))) AS spot FROM matched""",
    "tagsets": """
SELECT server, tool, list(tag ORDER BY rank, position, spot) AS tags FROM (
  SELECT *, row_number() OVER (PARTITION BY server, tool, tag ORDER BY rank, position, spot) AS nth FROM tagrows) WHERE nth = 1 GROUP BY server, tool""",
    "sets": """
SELECT p.server, p.tool, list(m.policy ORDER BY m.rank, m.position) FILTER (m.policy IS NOT NULL) AS policies,
  p.server IN (SELECT server FROM denyset) AS default_deny, any_value(t.tags) AS tags,
  arg_min(m.policy, m.position) FILTER (m.effect = 'allowlist') AS allow_policy,
  arg_min(m.policy, m.position) FILTER (m.effect = 'denylist') AS deny_policy,
  arg_min(m.reason, m.position) FILTER (m.effect = 'denylist') AS deny_reason,
  arg_min(m.policy, m.position) FILTER (m.effect = 'hitl_gate') AS hold_policy,
  arg_min(m.reviewer_group, m.position) FILTER (m.effect = 'hitl_gate') AS hold_group,
  arg_min(m.timeout_seconds, m.position) FILTER (m.effect = 'hitl_gate') AS hold_timeout
FROM call_pairs_st p LEFT JOIN matched m ON p.server = m.server AND p.tool = m.tool
LEFT JOIN tagsets t ON p.server = t.server AND p.tool = t.tool GROUP BY p.server, p.tool""",
    "feat": f"""
SELECT a.*, CAST(count(*) OVER m AS BIGINT) AS calls_per_minute, CAST(sum(first_use) OVER s AS BIGINT) AS unique_tools_count,
  CAST(count(*) OVER s AS BIGINT) AS total_calls, CAST(count(*) FILTER (status = 'HELD') OVER s AS BIGINT) AS hitl_ticket_count,
  CAST(count(*) FILTER (status = 'DENIED') OVER s AS BIGINT) AS denial_count
FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY session_id, tool ORDER BY ts, id) = 1 THEN 1 ELSE 0 END AS first_use FROM audit) a
WINDOW s AS (PARTITION BY session_id ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  m AS (PARTITION BY session_id ORDER BY epoch_us(ts) RANGE BETWEEN {_M} PRECEDING AND CURRENT ROW)""",
    "snaps": """
SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.05::DOUBLE * calls_per_minute + 0.3::DOUBLE * least(denial_count, 3)
  + 0.2::DOUBLE * least(hitl_ticket_count, 3))), 4) AS risk_score
FROM feat WHERE status IN ('INTENT', 'HELD', 'DENIED') AND parent_id IS NULL""",
    "sig0": f"""
SELECT *, [{_BUCKETS}] AS rate_buckets,
  count(*) FILTER (status = 'DENIED') OVER (PARTITION BY agent_id ORDER BY epoch_us(ts) RANGE BETWEEN {_D} PRECEDING AND CURRENT ROW) AS denials_recent
FROM audit""",
    "sig": """
SELECT *, CASE WHEN list_aggregate(rate_buckets[2:], 'stddev_samp') > 0 THEN
  round((rate_buckets[1] - list_aggregate(rate_buckets[2:], 'avg')) / list_aggregate(rate_buckets[2:], 'stddev_samp'), 4) END AS zscore
FROM sig0 WHERE status IN ('INTENT', 'HELD', 'DENIED') AND parent_id IS NULL""",
    "sigf": """
SELECT *, CASE WHEN coalesce(abs(zscore) > 3, false) THEN 'rate_spike' WHEN denials_recent >= 3 THEN 'repeated_denials' END AS anomaly_type,
  CASE WHEN coalesce(abs(zscore) > 3, false) THEN CASE WHEN abs(zscore) >= 5 THEN 'high' ELSE 'med' END
       WHEN denials_recent >= 5 THEN 'high' WHEN denials_recent >= 3 THEN 'med' END AS anomaly_severity FROM sig""",
    "evts": """
SELECT *, CASE WHEN outcome = 'DENY' THEN 'escalate' WHEN outcome = 'HOLD' THEN 'enrich>evidence'
  WHEN outcome = 'PASS' AND risk_score > 0.5 AND coalesce(anomaly_severity = 'high', false) THEN 'enrich>anomaly>escalate'
  WHEN outcome = 'PASS' AND risk_score > 0.5 THEN 'enrich>anomaly' ELSE 'enrich' END AS path
FROM (SELECT s.*, f.rate_buckets, f.zscore, f.denials_recent, f.anomaly_type, f.anomaly_severity FROM snaps s JOIN sigf f ON s.id = f.id)""",
    "inc": """
SELECT *, CASE WHEN promotion_rule IN ('high_severity_anomaly', 'high_risk_pending_hitl') OR seen_severity = 'high' THEN 'high' ELSE 'med' END AS severity
FROM (SELECT *, CASE WHEN denials_recent >= 3 THEN 'repeated_denials' WHEN seen_severity = 'high' THEN 'high_severity_anomaly' END AS promotion_rule
  FROM (SELECT *, coalesce(CASE WHEN contains(path, 'anomaly') THEN anomaly_severity END, '') AS seen_severity FROM evts WHERE path LIKE '%escalate'))
WHERE promotion_rule IS NOT NULL""",
    "entries": """
SELECT id, ts, concat('{"agent_id":"', agent_id, '","parent_id":', coalesce(CAST(parent_id AS VARCHAR), 'null'), ',"server":"', server,
  '","session_id":"', session_id, '","status":"', status, '","timestamp":"',
  regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', ''), '+00:00","tool":"', tool, '"}') AS body FROM audit""",
    "blocks": "SELECT id // 64 AS block, list(body ORDER BY id) AS bodies, list(id ORDER BY id) AS ids FROM entries GROUP BY 1",
    "chain": f"""
SELECT ids[i] AS id, block, bodies[i] AS body,
  list_reduce(list_prepend('{GENESIS}', bodies[1:i - 1]), lambda acc, x: sha256(acc || x)) AS prev_hash,
  list_reduce(list_prepend('{GENESIS}', bodies[1:i]), lambda acc, x: sha256(acc || x)) AS this_hash
FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM blocks)""",
    "tampered": f"""
SELECT id, block, this_hash,
  CASE WHEN contains(body, '"agent_id":"agent-0004"') THEN replace(body, '"status":"COMPLETED"', '"status":"DENIED"') ELSE body END AS body,
  CASE WHEN contains(body, '"agent_id":"agent-0007"') AND contains(body, '"status":"HELD"') THEN repeat('f', 64) ELSE prev_hash END AS prev_hash
FROM chain""",
    "verdicts": f"""
SELECT *, prev_hash = expected_prev AS link_ok, this_hash = sha256(prev_hash || body) AS content_ok, sha256(prev_hash || body) AS recomputed
FROM (SELECT *, coalesce(lag(this_hash) OVER (PARTITION BY block ORDER BY id), '{GENESIS}') AS expected_prev FROM tampered)""",
    "names": f"SELECT sdn_type, name, min(CAST(ent_num AS BIGINT)) AS first_entry, {_norm('name')} AS n, {_sorted(_norm('name'))} AS s FROM watch GROUP BY sdn_type, name",
    "screened_calls": """
SELECT c.id, coalesce(concat(p_brand, ' ', p_name), agent_id) AS query
FROM calls c LEFT JOIN part ON c.id = p_partkey WHERE server = 'ofac-sanctions'""",
    "call_match": f"""
SELECT s.id, m.score >= 70 AS is_match FROM screened_calls s JOIN (
  SELECT q.query, max({_score('q', 'l')}) AS score FROM (SELECT query, {_norm('query')} AS n, {_sorted(_norm('query'))} AS s FROM (SELECT DISTINCT query FROM screened_calls)) q,
  (SELECT n, s FROM names WHERE sdn_type = 'entity') l GROUP BY q.query) m ON s.query = m.query""",
    "amld": """
SELECT day, count(*) FILTER (server = 'ofac-sanctions') AS ofac_calls, count(*) FILTER (server = 'ofac-sanctions' AND is_match) AS sanctions_matches,
  count(*) FILTER (server = 'transaction-graph') AS transaction_graph_calls,
  count(*) FILTER (server = 'transaction-graph' AND list_contains(tags, 'incident:structuring')) AS structuring_alerts,
  count(*) FILTER (tool = 'mark_investigated' AND status = 'DENIED') AS mark_investigated_denied,
  count(*) FILTER (tool = 'mark_investigated' AND hitl_decision = 'APPROVED') AS mark_investigated_approved,
  count(*) FILTER (tool = 'mark_investigated' AND status = 'COMPLETED' AND hitl_decision IS NULL) AS mark_investigated_auto_passed
FROM callp LEFT JOIN call_match USING (id) WHERE server IN ('ofac-sanctions', 'transaction-graph') GROUP BY day""",
    "hourly": """
SELECT date_trunc('hour', ts) AS hour, server, tool, status AS outcome, count(*) AS call_count,
  count(*) FILTER (status = 'UPSTREAM_ERROR') AS error_count, quantile_disc(latency_ms, 0.5) AS latency_p50_ms,
  quantile_disc(latency_ms, 0.95) AS latency_p95_ms, quantile_disc(latency_ms, 0.99) AS latency_p99_ms FROM calls GROUP BY ALL""",
    "fires": """
SELECT day, f.policy AS policy_name, f.effect_type, outcome, count(*) AS fire_count
FROM (SELECT day, outcome, unnest(policies_fired) AS f FROM callp) GROUP BY ALL""",
    "reviews": """
SELECT CAST(opened_at AS DATE) AS day, reviewer_group, count(*) AS tickets_created, count(*) FILTER (hitl_decision = 'APPROVED') AS approved,
  count(*) FILTER (hitl_decision = 'DENIED') AS denied, count(*) FILTER (reason = 'hitl_timeout') AS timed_out,
  quantile_disc(review_wait_seconds, 0.5) AS median_response_seconds FROM pairs WHERE opened_as = 'HELD' GROUP BY ALL""",
    "edges": f"SELECT from_id, to_id, {money('amount_paid')} AS total_amount, count(*) AS transaction_count FROM transfers GROUP BY ALL",
    "inset": "SELECT account_id FROM accounts WHERE bank_id IN ('3', '7', '11')",
    "ends": "SELECT from_id AS account_id FROM transfers UNION SELECT to_id FROM transfers",
    "must": "SELECT from_id AS account_id FROM transfers WHERE is_laundering = 1 UNION SELECT to_id FROM transfers WHERE is_laundering = 1",
    "pool": "SELECT account_id FROM ends EXCEPT SELECT account_id FROM must",
    "sampled": f"""
SELECT account_id FROM must UNION ALL SELECT account_id FROM (SELECT account_id, row_number() OVER (ORDER BY sha256(account_id || '|{rg.SEED}'), account_id) AS r FROM pool)
WHERE r <= {rg.TARGET_ACCOUNTS} - (SELECT count(*) FROM must)""",
    "kept": "SELECT * FROM transfers WHERE from_id IN (SELECT account_id FROM sampled) AND to_id IN (SELECT account_id FROM sampled)",
    "summary": f"""
SELECT a.account_id, a.entity_name, a.bank_id, count(t.ts) AS total_transactions,
  coalesce(CAST(sum(CASE WHEN t.from_id = a.account_id THEN CAST(t.amount_paid AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE), 0.0) AS total_sent,
  coalesce(CAST(sum(CASE WHEN t.to_id = a.account_id THEN CAST(t.amount_received AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE), 0.0) AS total_received,
  count(DISTINCT CASE WHEN t.from_id = a.account_id THEN t.to_id ELSE t.from_id END) AS distinct_counterparties,
  min(t.ts) AS first_activity, max(t.ts) AS last_activity
FROM accounts a LEFT JOIN (SELECT from_id AS acct, * FROM transfers UNION ALL SELECT to_id, * FROM transfers WHERE from_id <> to_id) t
  ON a.account_id = t.acct GROUP BY a.account_id, a.entity_name, a.bank_id""",
    "links1": """
SELECT from_id AS a, to_id AS b, CAST(amount_paid AS DECIMAL(18,2)) AS amount FROM transfers
UNION ALL SELECT to_id, from_id, CAST(amount_received AS DECIMAL(18,2)) FROM transfers""",
    "near": """
SELECT * FROM (SELECT a AS seed_id, b AS account_id, row_number() OVER (PARTITION BY a ORDER BY CAST(sum(amount) AS DOUBLE) DESC, b) AS place
  FROM links1 GROUP BY a, b) WHERE place <= 25""",
    "struct0": f"""
SELECT a.account_id, m.max_ts, count(t.ts) AS deposit_count, coalesce(CAST(sum(CAST(t.amount_received AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS total_deposits
FROM accounts a LEFT JOIN (SELECT to_id, max(ts) AS max_ts FROM transfers GROUP BY 1) m ON a.account_id = m.to_id
LEFT JOIN transfers t ON t.to_id = a.account_id AND t.amount_received < {rg.DEPOSIT_LIMIT}
  AND t.ts > m.max_ts - INTERVAL {rg.WINDOW_DAYS} DAY AND t.ts <= m.max_ts GROUP BY a.account_id, m.max_ts""",
    "structs": f"SELECT *, deposit_count >= 3 AND total_deposits >= {rg.DEPOSIT_LIMIT} AS flagged FROM struct0",
    "alerts": "SELECT DISTINCT from_id AS account_id FROM transfers WHERE is_laundering = 1",
    "alert_names": f"SELECT DISTINCT entity_name AS query, {_norm('entity_name')} AS n, {_sorted(_norm('entity_name'))} AS s FROM accounts WHERE account_id IN (SELECT account_id FROM alerts)",
    "alert_hits": f"""
SELECT query, name AS matched_name, CAST(first_entry AS VARCHAR) AS entry_id, score, score >= 70 AS is_match FROM (
  SELECT q.query, l.name, l.first_entry, {_score('q', 'l')} AS score FROM alert_names q, (SELECT * FROM names WHERE sdn_type = 'entity') l)
QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, name) = 1""",
    "sub": """
SELECT seed_id, count(*) FILTER (place <= 500) AS subgraph_edges,
  CAST(sum(CASE WHEN place <= 500 THEN CAST(total_amount AS DECIMAL(18,2)) END) AS DOUBLE) AS subgraph_amount, bool_or(place > 500) AS truncated FROM (
  SELECT x.seed_id, e.*, row_number() OVER (PARTITION BY x.seed_id ORDER BY total_amount DESC, e.from_id, e.to_id) AS place
  FROM mem x JOIN mem y ON x.seed_id = y.seed_id JOIN edges e ON e.from_id = x.account_id AND e.to_id = y.account_id) GROUP BY seed_id""",
    "mem": """
SELECT seed_id, account_id FROM near WHERE seed_id IN (SELECT account_id FROM alerts)
UNION ALL SELECT account_id, account_id FROM alerts WHERE account_id IN (SELECT seed_id FROM near)""",
    "enriched": """
SELECT al.account_id, s.entity_name, s.total_transactions, s.total_sent, s.distinct_counterparties, s.distinct_counterparties AS neighbours_total, h.matched_name, h.entry_id, h.score, h.is_match,
  g.subgraph_edges, g.subgraph_amount, g.truncated, c.deposit_count, c.total_deposits, c.flagged,
  CASE WHEN h.is_match THEN w.program END AS listed_program
FROM alerts al LEFT JOIN summary s ON al.account_id = s.account_id LEFT JOIN alert_hits h ON s.entity_name = h.query
LEFT JOIN sub g ON al.account_id = g.seed_id LEFT JOIN structs c ON al.account_id = c.account_id LEFT JOIN watch w ON w.ent_num = h.entry_id""",
    "assessed": f"""
SELECT *, CASE WHEN is_match THEN 'high' WHEN flagged THEN 'medium' ELSE 'low' END AS risk_level,
  CASE WHEN is_match OR flagged THEN concat_ws('; ', CASE WHEN is_match THEN concat('Sanctions match: ''', matched_name, ''' (score ', format('{{:.0f}}', score), ')') END,
    CASE WHEN flagged THEN concat('Structuring signature: ', deposit_count, ' sub-threshold deposits totaling ', format('{{:.2f}}', total_deposits), ' within {rg.WINDOW_DAYS} days') END)
  ELSE 'No sanctions match or structuring signal found in available evidence' END AS findings FROM enriched""",
    "disp": """
SELECT from_id AS account_id, CASE payment_format WHEN 'ACH' THEN 'cleared' WHEN 'Wire' THEN 'escalate' ELSE 'monitor' END AS disposition,
  concat('paid ', to_id) AS rationale, ts AS recorded_at FROM transfers WHERE is_laundering = 1""",
    "profile": f"""
SELECT weekday, hour, count(*) FILTER (NOT earlier) AS calls, round(count(*) FILTER (earlier) * 168.0::DOUBLE / sum(count(*) FILTER (earlier)) OVER (), 6) AS weight
FROM (SELECT CAST(isodow(ts) - 1 AS INT) AS weekday, CAST(hour(ts) AS INT) AS hour, ts < TIMESTAMP '{rg.PROFILE_UNTIL}' AS earlier FROM calls) GROUP BY weekday, hour""",
    "shares": "SELECT *, CAST(round(weight / (SELECT sum(weight) FROM profile) * 5000) AS BIGINT) AS row_count FROM profile",
    "respond": """
SELECT c.id, c.ts, c.session_id, c.server, c.tool, d.text AS payload, c.tool = 'structuring_check' AND c.k >= 80 AS flagged
FROM callp c JOIN documents d ON c.id % (SELECT count(*) FROM documents) = d.doc_id""",
    "lastrow": "SELECT agent_id, max(id) AS last_id, arg_max(status, id) AS status, arg_max(fired_policy, id) AS fp, arg_max(coalesce(fired_policy, ''), id) AS fired_policy, arg_max(tags, id) AS tags, arg_max(ts, id) AS ts FROM audit GROUP BY agent_id",
    "judged": """
SELECT concat('case-', l.agent_id) AS id, l.agent_id, concat('class-', right(l.agent_id, 1)) AS attack_class,
  CASE WHEN l.status <> CASE WHEN right(l.agent_id, 1) IN ('0', '5') THEN 'DENIED' ELSE 'COMPLETED' END THEN 'status'
       WHEN l.fired_policy <> CASE WHEN right(l.agent_id, 1) = '3' THEN 'aml-write-hitl-gate' ELSE '' END THEN 'fired_policy'
       WHEN right(l.agent_id, 1) = '4' AND NOT list_contains(l.tags, 'severity:high') THEN 'missing_tags'
       WHEN l.status = 'COMPLETED' AND right(l.agent_id, 1) = '1' AND NOT coalesce(contains(t.text, 'a'), false) THEN 'response_contains'
       WHEN l.status = 'COMPLETED' AND right(l.agent_id, 1) = '2' AND coalesce(contains(t.text, 'e'), false) THEN 'response_not_contains'
       WHEN right(l.agent_id, 1) = '6' AND l.agent_id NOT IN (SELECT agent_id FROM inc) THEN 'no_incident' END AS failure
FROM lastrow l LEFT JOIN (SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY 1) t ON t.conv_id = (l.last_id // 2) % (SELECT count(DISTINCT conv_id) FROM conversations)""",
}


def _uses(text: str) -> list[str]:
    read = re.findall(r"(?:FROM|JOIN)\s+(\w+)", text)
    return [name for name in dict.fromkeys(read) if name in CTES]


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """The body with every view it reads in front, each after the views it reads itself."""
    extra = extra or {}
    order: list[str] = []

    def place(name: str) -> None:
        if name in order:
            return
        for other in _uses(CTES[name]):
            place(other)
        order.append(name)

    for text in [body, *extra.values()]:
        for name in _uses(text):
            if name not in extra:
                place(name)
    parts = [f"{name} AS ({CTES[name].strip()})" for name in order] + [f"{name} AS ({text.strip()})" for name, text in extra.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def add(name: str, body: str, extra: dict[str, str] | None = None) -> None:
    assert name in rg.QUERIES, name
    ORACLES[name] = sql(body, extra)


def limit_views(name: str, source: str, limit: int, seconds: int) -> dict[str, str]:
    """Window starts by recursion, then every call's window and place in it."""
    return {
        f"{name}_starts": f"""SELECT agent_id, min(ts) AS start FROM {source} GROUP BY agent_id
UNION ALL SELECT w.agent_id, min(c.ts) FROM {name}_starts w JOIN {source} c ON c.agent_id = w.agent_id AND c.ts >= w.start + INTERVAL {seconds} SECOND GROUP BY w.agent_id, w.start""",
        name: f"""SELECT c.id, c.ts, c.agent_id, w.start AS window_start, row_number() OVER (PARTITION BY c.agent_id, w.start ORDER BY c.ts, c.id) AS call_in_window,
  row_number() OVER (PARTITION BY c.agent_id, w.start ORDER BY c.ts, c.id) <= {limit} AS allowed
FROM {source} c ASOF JOIN {name}_starts w ON c.agent_id = w.agent_id AND c.ts >= w.start""",
    }


# ---- telemetry ------------------------------------------------------------------------------------
add("telemetry_hourly", f"SELECT * REPLACE ({ts('hour')} AS hour) FROM hourly")
add("policy_fires_daily", f"SELECT * REPLACE ({day('day')} AS day) FROM fires")
add("review_daily", f"SELECT * REPLACE ({day('day')} AS day) FROM reviews")
add("aml_daily", f"SELECT * REPLACE ({day('day')} AS day) FROM amld")
add(
    "merged_latency",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS day, server, count(*) AS call_count, count(*) FILTER (status = 'UPSTREAM_ERROR') AS error_count,
  CAST(quantile_disc(latency_ms, 0.5) AS BIGINT) AS latency_p50_ms, CAST(quantile_disc(latency_ms, 0.95) AS BIGINT) AS latency_p95_ms,
  CAST(quantile_disc(latency_ms, 0.99) AS BIGINT) AS latency_p99_ms FROM calls GROUP BY ALL""",
)
add(
    "merge_daily",
    f"""SELECT {day('day')} AS day, count(*) FILTER (server = 'ofac-sanctions') AS ofac_calls, count(*) FILTER (server = 'transaction-graph') AS transaction_graph_calls,
  count(*) FILTER (list_contains(tags, 'incident:structuring')) AS structuring_alerts,
  count(*) FILTER (tool = 'mark_investigated' AND status = 'DENIED') AS writes_denied,
  count(*) FILTER (tool = 'mark_investigated' AND hitl_decision = 'APPROVED') AS writes_approved
FROM callp WHERE server IN ('ofac-sanctions', 'transaction-graph') GROUP BY 1""",
)
add("cost_daily", f"SELECT * REPLACE ({day('day')} AS day) FROM costd")
add("call_counter", "SELECT server, tool, result AS outcome, count(*) AS calls FROM outcomes GROUP BY ALL")
add(
    "error_counter",
    "SELECT reason AS error_type, count(*) AS errors FROM audit WHERE reason IN ('upstream_unreachable', 'response_policy_error', 'policy_engine_error') GROUP BY 1",
)
_BOUND_ROWS = ", ".join(f"({b}::DOUBLE)" for b in DURATION_BOUNDS) + ", ('inf'::DOUBLE)"
add(
    "duration_histogram",
    f"""SELECT server, tool, b.le, count(*) FILTER (latency_ms / 1000 <= b.le) AS cumulative
FROM calls, (VALUES {_BOUND_ROWS}) b(le) GROUP BY ALL""",
)
add(
    "histogram_quantiles",
    """SELECT server, quantile, round(CASE WHEN le = 'inf'::DOUBLE THEN lower ELSE lower + (le - lower) * (rank - below) / (cumulative - below) END, 4) AS seconds
FROM (SELECT *, quantile * total AS rank FROM (SELECT server, le, cumulative, lag(cumulative, 1, 0) OVER w AS below, lag(le, 1, 0.0) OVER w AS lower,
  max(cumulative) OVER (PARTITION BY server) AS total FROM hist WINDOW w AS (PARTITION BY server ORDER BY le)), (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) q(quantile))
WHERE cumulative >= rank AND below < rank""",
    {"hist": f"SELECT server, b.le, count(*) FILTER (latency_ms / 1000 <= b.le) AS cumulative FROM calls, (VALUES {_BOUND_ROWS}) b(le) GROUP BY ALL"},
)
add(
    "policy_fire_counter",
    "SELECT policy_name AS policy, effect_type, outcome, CAST(sum(fire_count) AS BIGINT) AS fires FROM fires GROUP BY ALL",
)
_RATE = f"SELECT {ts('time_bucket(INTERVAL 5 MINUTE, ts)')} AS window_start, {{by}}, count(*) AS calls, round(count(*) / 300, 6) AS per_second FROM {{source}} GROUP BY ALL"
add("call_rate_by_outcome", _RATE.format(by="outcome", source="callp"))
add("call_rate_by_server", _RATE.format(by="server", source="calls"))
add("upstream_error_rate", _RATE.format(by="server", source="calls WHERE status = 'UPSTREAM_ERROR'"))
add(
    "error_ratio",
    f"""SELECT {ts('time_bucket(INTERVAL 5 MINUTE, ts)')} AS window_start, count(*) AS calls, count(*) FILTER (status = 'UPSTREAM_ERROR') AS errors,
  round(count(*) FILTER (status = 'UPSTREAM_ERROR') / count(*), 6) AS error_ratio FROM calls GROUP BY 1""",
)
add(
    "in_flight",
    f"""SELECT {ts('minute')} AS minute, CAST(sum(step) OVER (ORDER BY minute) AS BIGINT) AS open_calls FROM (
  SELECT minute, sum(step) AS step FROM (SELECT date_trunc('minute', opened_at) AS minute, 1 AS step FROM pairs WHERE opened_as <> 'DENIED'
    UNION ALL SELECT date_trunc('minute', closed_at), -1 FROM pairs WHERE opened_as <> 'DENIED' AND closed_at IS NOT NULL AND id % 100 <> 0) GROUP BY minute)""",
)
add(
    "fires_panel",
    f"SELECT {day('day')} AS day, concat(policy_name, ' (', outcome, ')') AS metric, CAST(sum(fire_count) AS BIGINT) AS value FROM fires GROUP BY 1, 2",
)
add("cost_by_provider", f"SELECT {day('day')} AS day, provider, {money('cost_usd', 8)} AS cost_usd FROM costd GROUP BY 1, 2")
add("cost_by_agent_day", f"SELECT {day('day')} AS day, agent_id, {money('cost_usd', 8)} AS cost_usd FROM costd GROUP BY 1, 2")
_TOP = {"topa": f"SELECT agent_id, {money('cost_usd', 8)} AS cost_usd FROM costd GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"}
add("top_agents", "SELECT * FROM topa", _TOP)
add(
    "top_agent_days",
    f"SELECT {day('day')} AS day, agent_id, {money('cost_usd', 8)} AS cost_usd FROM costd WHERE agent_id IN (SELECT agent_id FROM topa) GROUP BY 1, 2",
    _TOP,
)
add("projected_month_cost", f"SELECT round(avg(c) * 30, 4) AS projected_cost_usd FROM (SELECT day, {money('cost_usd', 8)} AS c FROM costd GROUP BY day)")
add(
    "over_budget",
    f"SELECT {day('day')} AS day, agent_id, {money('cost_usd', 8)} AS cost_usd FROM costd GROUP BY 1, 2 HAVING {money('cost_usd', 8)} > 0.005",
)
add("review_mean_by_group", "SELECT reviewer_group, round(avg(median_response_seconds), 4) AS mean_median_seconds FROM reviews GROUP BY 1")
add(
    "review_ratio",
    """SELECT 'Approved' AS metric, CAST(sum(approved) AS BIGINT) AS value FROM reviews UNION ALL SELECT 'Denied', CAST(sum(denied) AS BIGINT) FROM reviews
UNION ALL SELECT 'Timed out', CAST(sum(timed_out) AS BIGINT) FROM reviews""",
)
add(
    "write_outcomes",
    """SELECT 'Denied' AS metric, CAST(sum(mark_investigated_denied) AS BIGINT) AS value FROM amld UNION ALL SELECT 'Approved', CAST(sum(mark_investigated_approved) AS BIGINT) FROM amld
UNION ALL SELECT 'Auto-passed', CAST(sum(mark_investigated_auto_passed) AS BIGINT) FROM amld UNION ALL SELECT 'Structuring alerts', CAST(sum(structuring_alerts) AS BIGINT) FROM amld""",
)
add(
    "sanctions_panel",
    f"SELECT {day('day')} AS day, 'Sanctions calls' AS metric, ofac_calls AS value FROM amld UNION ALL SELECT {day('day')}, 'Sanctions matches', sanctions_matches FROM amld",
)
add("alerts_total", "SELECT CAST(sum(structuring_alerts) AS BIGINT) AS value FROM amld")
add(
    "reconcile",
    """SELECT (SELECT count(*) FROM calls) AS raw_calls, CAST((SELECT sum(call_count) FROM hourly) AS BIGINT) AS rolled_calls,
  0.0::DOUBLE AS gap, (SELECT count(*) FROM calls) = (SELECT sum(call_count) FROM hourly) AS agrees""",
)
add(
    "audit_growth",
    f"""SELECT {day('day')} AS day, audit_rows, calls, audit_rows - lag(audit_rows, 1, 0) OVER (ORDER BY day) AS audit_delta, calls - lag(calls, 1, 0) OVER (ORDER BY day) AS call_delta
FROM (SELECT coalesce(a.day, c.day) AS day, coalesce(a.n, 0) AS audit_rows, coalesce(c.n, 0) AS calls FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM audit GROUP BY 1) a
  FULL JOIN (SELECT day, count(*) AS n FROM calls GROUP BY 1) c ON a.day = c.day)""",
)
add(
    "flagged_tools_top",
    "SELECT tool, anomaly_severity, count(*) AS flags FROM evts WHERE anomaly_type IS NOT NULL AND path LIKE '%anomaly%' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10",
)
add(
    "review_percentiles",
    """SELECT reviewer_group, quantile_disc(review_wait_seconds, 0.5) AS wait_p50, quantile_disc(review_wait_seconds, 0.95) AS wait_p95,
  quantile_disc(review_wait_seconds, 0.99) AS wait_p99 FROM pairs WHERE opened_as = 'HELD' AND review_wait_seconds IS NOT NULL GROUP BY 1""",
)
add("volume_by_outcome", "SELECT result, count(*) AS calls FROM outcomes GROUP BY 1")
add(
    "slo_report",
    """SELECT 'latency_p99_ms' AS objective, CAST(p99 AS DOUBLE) AS value, 100.0::DOUBLE AS target, p99 <= 100 AS met FROM s
UNION ALL SELECT 'audit_complete_ratio', round(complete, 6), 1.0::DOUBLE, complete >= 1 FROM s
UNION ALL SELECT 'median_review_seconds', CAST(review AS DOUBLE), 900.0::DOUBLE, review <= 900 FROM s""",
    {
        "s": """SELECT quantile_disc(latency_ms, 0.99) AS p99, count(*) FILTER (closed_at IS NOT NULL OR opened_as = 'DENIED') / count(*) AS complete,
  quantile_disc(review_wait_seconds, 0.5) FILTER (opened_as = 'HELD') AS review FROM pairs"""
    },
)
add("calls_by_agent", "SELECT agent_id, count(*) AS calls FROM calls GROUP BY 1")
add("calls_by_tool", "SELECT server, tool, count(*) AS calls FROM calls GROUP BY 1, 2")
add(
    "cost_by_agent_policy",
    f"""SELECT c.agent_id, p.policy, {money('cost_usd', 8)} AS cost_usd FROM costs c JOIN (SELECT id, unnest(policies_fired).policy AS policy FROM callp) p ON c.id = p.id GROUP BY 1, 2""",
)
add(
    "top_policies",
    f"""SELECT policy_name, CAST(sum(fire_count) AS BIGINT) AS fires, coalesce(CAST(sum(fire_count) FILTER (outcome = 'PASS') AS BIGINT), 0) AS pass,
  coalesce(CAST(sum(fire_count) FILTER (outcome = 'DENY') AS BIGINT), 0) AS deny, coalesce(CAST(sum(fire_count) FILTER (outcome = 'HOLD') AS BIGINT), 0) AS hold
FROM fires WHERE day > DATE '{rg.AS_OF}' - 30 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)

# ---- audit log ------------------------------------------------------------------------------------
add("call_pairs", f"SELECT * REPLACE ({ts('opened_at')} AS opened_at, {ts('closed_at')} AS closed_at) FROM pairs")
add(
    "agent_actions",
    f"""SELECT id, {ts('ts')} AS ts, server, tool, status, reason FROM audit WHERE agent_id = 'agent-0007' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""",
)
add("session_replay", f"SELECT id, parent_id, {ts('ts')} AS ts, server, tool, status FROM audit WHERE session_id = 's-7-2024-01-10'")
add("reviewer_decisions", "SELECT id, hitl_reviewer, hitl_decision, hitl_rationale FROM audit WHERE hitl_decision IS NOT NULL AND hitl_reviewer IS NOT NULL")
add(
    "decision_events",
    "SELECT status, outcome, count(*) AS events, max(id) AS last_id FROM audit WHERE status IN ('INTENT', 'HELD', 'DENIED') AND parent_id IS NULL GROUP BY 1, 2",
)
add(
    "archive_tiers",
    f"""SELECT CASE WHEN age <= 30 THEN 'hot' WHEN age <= 90 THEN 'warm' ELSE 'cold' END AS tier, count(*) AS calls, {ts('min(ts)')} AS first_ts, {ts('max(ts)')} AS last_ts
FROM (SELECT ts, date_diff('day', day, DATE '2024-03-15') AS age FROM calls) GROUP BY 1""",
)
add(
    "redaction_proof",
    """SELECT id, sha256(concat('{"agent_id":"', agent_id, '","k":', k, ',"z_tool":"', tool, '"}')) AS recomputed_hash, k <> 13 AS matches FROM calls""",
)
add("canonical_entries", f"SELECT id, body, sha256('{GENESIS}' || body) AS entry_hash FROM entries")
add("chain_build", "SELECT id, block, prev_hash, this_hash FROM chain")
add(
    "chain_seal",
    f"""SELECT block // 64 AS segment, CAST(count(*) AS INT) AS blocks, CAST(sum(n) AS BIGINT) AS entries,
  list_reduce(list_prepend('{GENESIS}', list(tail ORDER BY block)), lambda acc, x: sha256(acc || x)) AS digest
FROM (SELECT block, len(bodies) AS n, list_reduce(list_prepend('{GENESIS}', bodies), lambda acc, x: sha256(acc || x)) AS tail FROM blocks) GROUP BY 1""",
)
add(
    "chain_root",
    f"""SELECT root, levels, entries FROM (
  WITH RECURSIVE sealed AS (
    SELECT 0 AS level, list(tail ORDER BY block) AS nodes
    FROM (SELECT block, list_reduce(list_prepend('{GENESIS}', bodies), lambda acc, x: sha256(acc || x)) AS tail FROM blocks)
    UNION ALL
    SELECT level + 1, list_transform(range(0, CAST(len(nodes) AS BIGINT), 64), lambda i: list_reduce(list_prepend('{GENESIS}', nodes[i + 1 : i + 64]), lambda acc, x: sha256(acc || x)))
    FROM sealed WHERE len(nodes) > 1 OR level = 0
  )
  SELECT nodes[1] AS root, CAST(level AS INT) AS levels, (SELECT CAST(sum(len(bodies)) AS BIGINT) FROM blocks) AS entries FROM sealed WHERE len(nodes) = 1 AND level > 0
)""",
)
add(
    "canonical_numbers",
    """SELECT l_orderkey, l_linenumber, concat('{"each":', CAST(price / quantity AS VARCHAR), ',"huge":', CAST(price * 1e15 AS VARCHAR), ',"parts":{"a":', CAST(discount * 1e4 AS VARCHAR),
  ',"z":', CAST(quantity / 3 AS VARCHAR), '},"price":', CAST(price AS VARCHAR), ',"tiny":', CAST(discount / 1e7 AS VARCHAR), '}') AS body
FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_discount AS DOUBLE) AS discount FROM lineitem)""",
)
add(
    "chain_verify",
    "SELECT true AS valid, count(*) AS checked, count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS in_scope FROM audit",
)
add(
    "chain_verify_tampered",
    """SELECT f.id IS NULL AS valid, (SELECT count(*) FROM verdicts v WHERE f.id IS NULL OR v.id < f.id) AS checked, f.id AS first_mismatch_id,
  CASE WHEN NOT f.link_ok THEN concat('entry ', f.id, ' has prev_hash=''', f.prev_hash, ''', expected ''', f.expected_prev, ''' (the prior entry''s this_hash)')
       ELSE concat('entry ', f.id, ' this_hash=''', f.this_hash, ''' does not match recomputed ''', f.recomputed, ''' -- content was modified after writing') END AS detail,
  (SELECT count(*) FROM verdicts) AS total
FROM (SELECT 1) one LEFT JOIN (SELECT * FROM verdicts WHERE NOT (link_ok AND content_ok) ORDER BY id LIMIT 1) f ON true""",
)
add(
    "tampered_entries",
    "SELECT id, block, CASE WHEN NOT link_ok THEN 'broken_link' ELSE 'changed_content' END AS problem FROM verdicts WHERE NOT (link_ok AND content_ok)",
)

# ---- policy ---------------------------------------------------------------------------------------
add("match_rules", "SELECT server, tool, policy, effect FROM matched")
add("rule_sets", f"SELECT server, tool, {text_list('policies')} AS policies, default_deny, {text_list('tags')} AS static_tags FROM sets")
add(
    "needs_response_check",
    """SELECT server, tool, bool_or(effect = 'pii_redaction' OR (effect = 'custom' AND coalesce(stage, '') = 'response')) AS needs_response_check FROM matched GROUP BY 1, 2""",
)
_PRIOR = {
    "first_check": """SELECT agent_id, min(id) AS first_check FROM calls WHERE server = 'ofac-sanctions' AND tool IN ('check_entity', 'check_alias') AND status = 'COMPLETED' GROUP BY 1"""
}
add(
    "prior_check",
    "SELECT id, NOT coalesce(f.first_check < id, false) AS denied FROM calls LEFT JOIN first_check f USING (agent_id) WHERE server = 'transaction-graph'",
    _PRIOR,
)
add(
    "fixed_window_limit",
    f"SELECT id, agent_id, {ts('window_start')} AS window_start, CAST(call_in_window AS INT) AS call_in_window, allowed FROM lim",
    limit_views("lim", "calls", 1, 21600),
)
_SLIDE = "count(*) OVER (PARTITION BY agent_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW)"
add("sliding_limit", f"SELECT id, {_SLIDE} AS in_window, {_SLIDE} <= 2 AS allowed FROM calls")
add(
    "decide_calls",
    f"""SELECT id, outcome, fired_policy, reason, CASE WHEN outcome = 'HOLD' THEN hold_group END AS reviewer_group,
  CASE WHEN outcome = 'HOLD' THEN hold_timeout ELSE 0 END AS timeout_seconds, {text_list('policies')} AS policies, {text_list('tags')} AS tags
FROM (SELECT u.*, CASE WHEN early IS NOT NULL THEN early WHEN limited IS NOT NULL OR custom_policy IS NOT NULL THEN 'DENY' WHEN hold_policy IS NOT NULL THEN 'HOLD' ELSE 'PASS' END AS outcome,
  CASE WHEN early = 'PASS' THEN allow_policy WHEN early = 'DENY' AND default_deny THEN NULL WHEN early = 'DENY' THEN deny_policy
       WHEN limited IS NOT NULL THEN limited WHEN custom_policy IS NOT NULL THEN custom_policy WHEN hold_policy IS NOT NULL THEN hold_policy END AS fired_policy,
  CASE WHEN early = 'PASS' THEN 'allowlisted' WHEN early = 'DENY' AND default_deny THEN 'not_on_allowlist' WHEN early = 'DENY' THEN deny_reason
       WHEN limited IS NOT NULL THEN 'rate_limit_exceeded' WHEN custom_policy = 'server-02-unknown' THEN 'policy_engine_error'
       WHEN custom_policy IS NOT NULL THEN '{NO_SANCTIONS_CHECK}' WHEN hold_policy IS NOT NULL THEN 'hitl_required' END AS reason
FROM (SELECT e.*, CASE WHEN e.id IN (SELECT id FROM l1 WHERE NOT allowed) THEN 'aml-rate-limit-sanctions' WHEN e.id IN (SELECT id FROM l2 WHERE NOT allowed) THEN 'hourly-limit-sanctions'
    WHEN e.id IN (SELECT id FROM l3 WHERE NOT allowed) THEN 'half-day-limit-generic' END AS limited,
  CASE WHEN early IS NULL AND e.server = 'transaction-graph' AND NOT coalesce(f.first_check < e.id, false) THEN 'aml-sanctions-required'
       WHEN early IS NULL AND e.server = 'server-02' THEN 'server-02-unknown' END AS custom_policy
FROM early0 e LEFT JOIN first_check f USING (agent_id)) u)""",
    {
        **_PRIOR,
        "early0": """SELECT c.id, c.ts, c.agent_id, c.server, c.tool, s.policies, s.tags, s.default_deny, s.allow_policy, s.deny_policy, s.deny_reason, s.hold_policy, s.hold_group, s.hold_timeout,
  CASE WHEN allow_policy IS NOT NULL THEN 'PASS' WHEN default_deny OR deny_policy IS NOT NULL THEN 'DENY' END AS early FROM calls c JOIN sets s ON c.server = s.server AND c.tool = s.tool""",
        "src1": "SELECT id, ts, agent_id FROM early0 WHERE early IS NULL AND server = 'ofac-sanctions' AND tool = 'check_entity'",
        **limit_views("l1", "src1", 60, 60),
        "src2": "SELECT id, ts, agent_id FROM src1 WHERE id NOT IN (SELECT id FROM l1 WHERE NOT allowed)",
        **limit_views("l2", "src2", 3, 86400),
        "src3": "SELECT id, ts, agent_id FROM early0 WHERE early IS NULL AND tool IN ('tool_1', 'tool_3', 'tool_5')",
        **limit_views("l3", "src3", 1, 43200),
    },
)
add(
    "cost_cap",
    """SELECT id, round(u / 10000000, 7) AS spent_usd, CASE WHEN u >= 100000 OR graph AND u >= 50000 THEN 'over' WHEN u >= 80000 OR graph AND u >= 40000 THEN 'warn' ELSE 'ok' END AS cost_state,
  CASE WHEN u < 100000 AND graph AND u >= 40000 THEN 'tight-cost-cap' ELSE 'session-cost-cap' END AS cost_policy
FROM (SELECT c.id, c.server = 'transaction-graph' AS graph, CAST(sum(coalesce(CAST(round(k.cost_usd * 10000000) AS BIGINT), 0)) OVER (PARTITION BY c.session_id ORDER BY epoch_us(c.ts) RANGE UNBOUNDED PRECEDING) AS BIGINT) AS u
  FROM calls c LEFT JOIN costs k ON c.id = k.id)""",
)
add(
    "review_timeout",
    """SELECT h.id, CASE WHEN ok THEN d.hitl_decision END AS hitl_decision, CASE WHEN ok THEN d.hitl_reviewer END AS hitl_reviewer,
  CASE WHEN ok AND d.hitl_decision = 'APPROVED' THEN 'PASS' ELSE 'DENY' END AS resolution,
  CASE WHEN NOT ok THEN 'hitl_timeout' WHEN d.hitl_decision = 'DENIED' THEN 'hitl_denied' END AS reason
FROM (SELECT h.id, h.ts, coalesce(epoch_us(d.ts) <= epoch_us(h.ts) + 90000000, false) AS ok FROM audit h LEFT JOIN audit d ON d.parent_id = h.id AND d.hitl_decision IS NOT NULL WHERE h.status = 'HELD') h
LEFT JOIN audit d ON d.parent_id = h.id AND d.hitl_decision IS NOT NULL""",
)
add(
    "pending_reviews",
    """SELECT id, agent_id, reviewer_group, CAST(floor((epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(ts)) / 1000000) AS BIGINT) AS age_seconds
FROM audit h WHERE status = 'HELD' AND ts <= TIMESTAMP '2024-01-20 12:00:00'
  AND NOT EXISTS (SELECT 1 FROM audit c WHERE c.parent_id = h.id AND c.k <> 17 AND c.ts <= TIMESTAMP '2024-01-20 12:00:00')""",
)


def _redacted(x: str, backwards: bool = False) -> str:
    for pattern in reversed(PII_PATTERNS.values()) if backwards else PII_PATTERNS.values():
        x = f"regexp_replace({x}, '{pattern}', '[REDACTED]', 'g')"
    return x


_INJECT = "(?i)" + "|".join(f"(?:{p})" for p in INJECTION_PATTERNS)
_RESPONSE_TAGS = "CASE WHEN flagged THEN ['incident:structuring', 'severity:high'] ELSE CAST([] AS VARCHAR[]) END"
add(
    "evaluate_responses",
    f"""SELECT r.id, md5({_redacted('r.payload')}) AS payload_md5, {text_list(f"list_concat(s.tags, {_RESPONSE_TAGS})")} AS tags, {text_list(_RESPONSE_TAGS)} AS response_tags
FROM respond r JOIN sets s ON r.server = s.server AND r.tool = s.tool""",
)
add(
    "structuring_flags",
    f"""SELECT id, session_id, {ts('ts')} AS flag_from, {ts('ts + INTERVAL 24 HOUR')} AS flag_until, 'incident:structuring|severity:high' AS tags FROM respond WHERE flagged""",
)
add("redact_payloads", f"SELECT payload_id, md5({_redacted('text')}) AS clean_md5, {_redacted('text')} <> text AS changed FROM payloads")
add(
    "redact_in_rule_order",
    f"SELECT payload_id, md5(CASE WHEN length(text) % 2 = 0 THEN {_redacted('text', True)} ELSE {_redacted('text')} END) AS clean_md5 FROM payloads",
)
add(
    "redact_event_props",
    """SELECT event_id, CASE WHEN event_id % 50 = 0 THEN '"[REJECTED: not JSON]"' ELSE concat('{"note":"ssn [REDACTED]","props":', props, '}') END AS clean FROM
  (SELECT event_id, props, lpad(CAST(event_id AS VARCHAR), 4, '0') AS tail FROM events)""",
)
add(
    "redaction_hits",
    " UNION ALL ".join(
        f"SELECT '{name}' AS pattern, count(*) FILTER (regexp_matches(text, '{pattern}')) AS rows_hit FROM payloads" for name, pattern in PII_PATTERNS.items()
    ),
)
add(
    "injection_scan",
    f"SELECT CASE WHEN regexp_matches(text, '{_INJECT}') THEN 'prompt-injection-detected' ELSE '' END AS tags, count(*) AS payloads FROM payloads GROUP BY 1",
)
add(
    "policy_version_at",
    """SELECT server, CASE WHEN ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-12' THEN '0.1.0' WHEN ts >= TIMESTAMP '2024-01-14' THEN '0.2.0' END AS version, count(*) AS calls
FROM calls GROUP BY 1, 2""",
)

# ---- risk -----------------------------------------------------------------------------------------
add("rate_buckets", f"SELECT id, {text_list('b')} AS rate_buckets FROM (SELECT id, [{_BUCKETS}] AS b FROM calls)")
add("anomaly_signals", f"SELECT id, {text_list('rate_buckets')} AS rate_buckets, zscore, denials_recent FROM sig")
add(
    "recent_denials",
    f"SELECT id, count(*) FILTER (status = 'DENIED') OVER (PARTITION BY agent_id ORDER BY epoch_us(ts) RANGE BETWEEN {_D} PRECEDING AND CURRENT ROW) AS denials_recent FROM calls",
)
add("session_features", "SELECT id, calls_per_minute, unique_tools_count, total_calls, hitl_ticket_count, denial_count, risk_score FROM snaps")
add(
    "session_totals",
    """SELECT session_id, count(*) AS total_calls, count(DISTINCT tool) AS unique_tools_count, count(*) FILTER (status = 'HELD') AS hitl_ticket_count,
  count(*) FILTER (status = 'DENIED') AS denial_count FROM audit GROUP BY 1""",
)
add(
    "risk_histogram",
    """SELECT CASE WHEN risk_score < 0.2 THEN '0.0-0.2' WHEN risk_score < 0.4 THEN '0.2-0.4' WHEN risk_score < 0.6 THEN '0.4-0.6' WHEN risk_score < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS bucket,
  count(*) AS value FROM snaps GROUP BY 1""",
)
add("signal_flags", "SELECT id, agent_id, anomaly_type, anomaly_severity FROM sigf WHERE anomaly_type IS NOT NULL")
add("anomaly_flags", "SELECT id, agent_id, anomaly_type, anomaly_severity FROM evts WHERE anomaly_type IS NOT NULL AND path LIKE '%anomaly%'")
add(
    "flags_by_severity",
    f"SELECT anomaly_severity AS severity, count(*) AS value FROM evts WHERE anomaly_type IS NOT NULL AND path LIKE '%anomaly%' AND ts >= TIMESTAMP '{rg.AS_OF}' - INTERVAL 20 DAY GROUP BY 1",
)
add("route_events", "SELECT path, outcome, count(*) AS events FROM evts GROUP BY 1, 2")
add(
    "incidents",
    """SELECT id, promotion_rule, severity, concat('Incident promoted under rule ''', promotion_rule, ''' for agent ', agent_id, ' on ', server, '/', tool, '; manual review required.') AS narrative,
  'investigate' AS recommended_response FROM inc""",
)
add(
    "incidents_all_paths",
    """SELECT promotion_rule, CASE WHEN promotion_rule IN ('high_severity_anomaly', 'high_risk_pending_hitl') OR coalesce(anomaly_severity, '') = 'high' THEN 'high' ELSE 'med' END AS severity,
  count(*) AS incidents FROM (SELECT *, CASE WHEN denials_recent >= 3 THEN 'repeated_denials' WHEN coalesce(anomaly_severity, '') = 'high' THEN 'high_severity_anomaly'
    WHEN outcome = 'HOLD' AND risk_score > 0.8 THEN 'high_risk_pending_hitl' WHEN outcome = 'DENY' AND server = 'ofac-sanctions' THEN 'sanctions_denial' END AS promotion_rule FROM evts)
WHERE promotion_rule IS NOT NULL GROUP BY 1, 2""",
)
add(
    "recent_incidents",
    f"""SELECT id, {ts('ts')} AS ts, agent_id, promotion_rule, severity FROM (SELECT * FROM inc WHERE ts >= TIMESTAMP '{rg.AS_OF}' - INTERVAL 20 DAY ORDER BY ts DESC, id DESC LIMIT 50)""",
)
add("prior_reviews", "SELECT agent_id, tool, hitl_decision, count(*) AS decisions FROM audit WHERE hitl_decision IS NOT NULL GROUP BY 1, 2, 3")
add(
    "recent_calls",
    "SELECT id, session_id, CAST(place AS INT) AS place FROM (SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS place FROM audit) WHERE place <= 3",
)
add(
    "evidence_packets",
    f"""SELECT s.id, e.recent_calls, e.prior_approved, e.prior_denied, s.risk_score,
  concat('HITL hold on ', s.tool, ' (', s.server, ') for agent ', s.agent_id, ', fired policy ''', s.fired_policy, '''; manual review required with no automated recommendation.') AS narrative,
  'escalate' AS recommended_action, 0.0::DOUBLE AS confidence
FROM snaps s JOIN (SELECT id, {text_list('list_reverse(r)')} AS recent_calls, prior_approved, prior_denied FROM (
  SELECT id, list(concat(tool, ':', status)) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS r,
    count(*) FILTER (hitl_decision = 'APPROVED') OVER (PARTITION BY agent_id, tool ORDER BY epoch_us(ts) RANGE UNBOUNDED PRECEDING) AS prior_approved,
    count(*) FILTER (hitl_decision = 'DENIED') OVER (PARTITION BY agent_id, tool ORDER BY epoch_us(ts) RANGE UNBOUNDED PRECEDING) AS prior_denied FROM audit)) e ON s.id = e.id
WHERE s.status = 'HELD'""",
)
add(
    "checks_then_write",
    f"""SELECT id, agent_id, b AS bursts_before FROM (SELECT id, agent_id, tool, CAST(count(*) FILTER (tool = 'check_entity' AND n >= 2) OVER (PARTITION BY agent_id ORDER BY epoch_us(ts) RANGE BETWEEN {DAY_US} PRECEDING AND CURRENT ROW) AS BIGINT) AS b
FROM (SELECT id, agent_id, tool, ts, count(*) FILTER (tool = 'check_entity') OVER (PARTITION BY agent_id ORDER BY epoch_us(ts) RANGE BETWEEN {DAY_US} PRECEDING AND CURRENT ROW) AS n
  FROM calls WHERE tool IN ('check_entity', 'mark_investigated'))) WHERE tool = 'mark_investigated' AND b > 0""",
)
add(
    "usage_ratios",
    """SELECT session_id, r AS reads, w AS writes, round(CASE WHEN w > 0 THEN r / w END, 4) AS read_write_ratio, round(c / n, 4) AS sanctions_share
FROM (SELECT session_id, count(*) FILTER (tool <> 'mark_investigated') AS r, count(*) FILTER (tool = 'mark_investigated') AS w, count(*) FILTER (server = 'ofac-sanctions') AS c, count(*) AS n FROM calls GROUP BY 1)""",
)
add(
    "tool_baseline_zscores",
    f"""SELECT d.agent_id, d.tool, {day('d.day')} AS day, d.calls, CASE WHEN b.s > 0 THEN round((d.calls - b.m) / b.s, 3) END AS zscore
FROM perday d JOIN (SELECT agent_id, tool, avg(calls) AS m, stddev_samp(calls) AS s FROM perday GROUP BY 1, 2) b ON d.agent_id = b.agent_id AND d.tool = b.tool""",
    {"perday": "SELECT agent_id, tool, day, count(*) AS calls FROM calls GROUP BY 1, 2, 3"},
)
add(
    "agent_profiles",
    """SELECT agent_id, round(count(*) / count(DISTINCT day), 6) AS calls_per_day, round(count(*) FILTER (status = 'DENIED') / count(*), 6) AS denied_share,
  round(count(*) FILTER (hitl_decision IS NOT NULL) / count(*), 6) AS held_share, CAST(count(DISTINCT tool) AS DOUBLE) AS tools FROM calls GROUP BY 1""",
)


def _clusters(k: int, rounds: int) -> tuple[str, dict[str, str]]:
    """Farthest-first starts and the rounds, each a view over the one before."""
    names = ["calls_per_day", "denied_share", "held_share", "tools"]
    spot = ", ".join(
        f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0 ELSE CAST(floor(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 1000000 + 0.5) AS BIGINT) END AS x{i}"
        for i, c in enumerate(names)
    )
    gap = " + ".join(f"(p.x{i} - c.x{i}) * (p.x{i} - c.x{i})" for i in range(4))
    cols = ", ".join(f"x{i}" for i in range(4))
    views = {
        "profile": """SELECT agent_id, round(count(*) / count(DISTINCT day), 6) AS calls_per_day, round(count(*) FILTER (status = 'DENIED') / count(*), 6) AS denied_share,
  round(count(*) FILTER (hitl_decision IS NOT NULL) / count(*), 6) AS held_share, CAST(count(DISTINCT tool) AS DOUBLE) AS tools FROM calls GROUP BY 1""",
        "pt": f"SELECT agent_id, {spot} FROM profile",
        "s0": f"SELECT 0 AS cluster, {cols} FROM pt ORDER BY {' + '.join(f'x{i} * x{i}' for i in range(4))}, agent_id LIMIT 1",
    }
    for n in range(1, k):
        views[f"s{n}"] = f"""SELECT * FROM s{n - 1} UNION ALL SELECT * FROM (SELECT {n}, {', '.join(f'p.x{i}' for i in range(4))} FROM pt p, s{n - 1} c
GROUP BY p.agent_id, {', '.join(f'p.x{i}' for i in range(4))} HAVING min({gap}) > 0 ORDER BY min({gap}) DESC, p.agent_id LIMIT 1)"""
    near = f"SELECT p.*, c.cluster, {gap} AS gap FROM pt p, {{0}} c QUALIFY row_number() OVER (PARTITION BY p.agent_id ORDER BY {gap}, c.cluster) = 1"
    before = f"s{k - 1}"
    for r in range(rounds):
        views[f"n{r}"] = near.format(before)
        means = ", ".join(f"coalesce(CAST(floor(sum(n.x{i}) / count(n.x{i}) + 0.5) AS BIGINT), min(c.x{i})) AS x{i}" for i in range(4))
        views[f"r{r}"] = f"SELECT c.cluster, {means} FROM {before} c LEFT JOIN n{r} n ON n.cluster = c.cluster GROUP BY c.cluster"
        before = f"r{r}"
    views["last_near"] = near.format(before)
    views["far"] = "SELECT agent_id, cluster, round(sqrt(CAST(gap AS DOUBLE)) / 1000000, 6) AS distance FROM last_near"
    views["lim"] = """SELECT cluster, round((m + 2.0 * sqrt(greatest(q - m * m, 0))) / 1000000, 6) AS most FROM (
  SELECT cluster, CAST(sum(CAST(round(distance * 1000000) AS BIGINT)) AS DOUBLE) / count(*) AS m,
    CAST(sum(CAST(round(distance * 1000000) AS HUGEINT) * CAST(round(distance * 1000000) AS HUGEINT)) AS DOUBLE) / count(*) AS q FROM far GROUP BY cluster)"""
    return "SELECT agent_id, cluster, distance, distance > most AS is_outlier FROM far JOIN lim USING (cluster)", views


add("cluster_outliers", *_clusters(rg.CLUSTERS, rg.LLOYD_ROUNDS))

# ---- transfers ------------------------------------------------------------------------------------
add(
    "account_transfers",
    f"""SELECT * REPLACE ({ts('ts')} AS ts) FROM transfers WHERE (from_id = 'S:3' OR to_id = 'S:3') AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-01-01'""",
)
add("labelled_transfers", f"SELECT payment_format, count(*) AS transfers, {money('amount_paid')} AS amount FROM transfers WHERE is_laundering = 1 GROUP BY 1")
add("endpoints", "SELECT account_id FROM ends")
add("account_summary", f"SELECT * REPLACE ({ts('first_activity')} AS first_activity, {ts('last_activity')} AS last_activity) FROM summary")
add("edge_totals", "SELECT * FROM edges")
add("account_labels", "SELECT account_id, 1 AS is_laundering FROM must")
_INSIDE = "from_id IN (SELECT account_id FROM inset) AND to_id IN (SELECT account_id FROM inset)"
add("induced_edges", f"SELECT * FROM edges WHERE {_INSIDE}")
add(
    "top_edges",
    f"""SELECT from_id, to_id, total_amount, transaction_count, CAST(place AS INT) AS place, n > 25 AS truncated
FROM (SELECT *, row_number() OVER (ORDER BY total_amount DESC, from_id, to_id) AS place, count(*) OVER () AS n FROM edges WHERE {_INSIDE}) WHERE place <= 25""",
)


def _hops(hops: int, least: float) -> tuple[str, dict[str, str]]:
    views = {
        "lk": f"""SELECT from_id AS a, to_id AS b, CAST(amount_paid AS DECIMAL(18,2)) AS amount FROM transfers WHERE greatest(amount_paid, amount_received) >= {least}
UNION ALL SELECT to_id, from_id, CAST(amount_received AS DECIMAL(18,2)) FROM transfers WHERE greatest(amount_paid, amount_received) >= {least}""",
        "h0": "SELECT account_id AS seed_id, account_id, 0 AS hop FROM accounts WHERE account_id IN ('C:1', 'C:7', 'S:2')",
    }
    for hop in range(1, hops + 1):
        seen = " AND ".join(f"NOT EXISTS (SELECT 1 FROM h{p} v WHERE v.seed_id = f.seed_id AND v.account_id = l.b)" for p in range(hop))
        views[f"h{hop}"] = f"""SELECT f.seed_id, l.b AS account_id, {hop} AS hop, CAST(sum(l.amount) AS DOUBLE) AS total_amount, count(*) AS transaction_count
FROM h{hop - 1} f JOIN lk l ON f.account_id = l.a WHERE {seen} GROUP BY f.seed_id, l.b"""
    body = " UNION ALL ".join(f"SELECT seed_id, account_id, total_amount, transaction_count, hop FROM h{hop}" for hop in range(1, hops + 1))
    return body, views


for _n, _least in ((1, 0.0), (2, 60_000.0), (3, 90_000.0)):
    add(f"neighbours_{_n}_hop", *_hops(_n, _least))
add("cap_neighbours", "SELECT seed_id, account_id, CAST(place AS INT) AS place FROM near")
add(
    "structuring_check",
    f"""SELECT account_id, {rg.WINDOW_DAYS} AS window_days, {rg.DEPOSIT_LIMIT}::DOUBLE AS threshold_amount, deposit_count, total_deposits, flagged,
  CASE WHEN max_ts IS NULL THEN 'no deposits found for this account'
       WHEN flagged THEN concat(deposit_count, ' deposits under {rg.DEPOSIT_LIMIT:,.0f} totaling ', format('{{:,.2f}}', total_deposits), ' within the trailing {rg.WINDOW_DAYS} days -- classic structuring signature')
       ELSE concat(deposit_count, ' sub-threshold deposits totaling ', format('{{:,.2f}}', total_deposits), ' within the trailing {rg.WINDOW_DAYS} days -- below the {gr.MIN_DEPOSITS}-deposit / {rg.DEPOSIT_LIMIT:,.0f} alert bar') END AS rationale
FROM structs""",
)
add(
    "rolling_structuring",
    f"""SELECT account_id, {ts('ts')} AS ts, n AS deposit_count, c / 100 AS total_deposits, n >= 3 AND c / 100 >= {rg.DEPOSIT_LIMIT} AS flagged
FROM (SELECT DISTINCT to_id AS account_id, ts, CAST(count(*) FILTER (amount_received < {rg.DEPOSIT_LIMIT}) OVER w AS BIGINT) AS n,
  CAST(coalesce(sum(CAST(round(amount_received * 100) AS BIGINT)) FILTER (amount_received < {rg.DEPOSIT_LIMIT}) OVER w, 0) AS BIGINT) AS c
  FROM transfers WINDOW w AS (PARTITION BY to_id ORDER BY epoch_us(ts) RANGE BETWEEN {30 * DAY_US - 1} PRECEDING AND CURRENT ROW))""",
)
add(
    "orphan_edges",
    """SELECT DISTINCT from_id, to_id, 'from' AS missing_end FROM transfers WHERE from_id NOT IN (SELECT account_id FROM accounts WHERE bank_id <> '5')
UNION ALL SELECT DISTINCT from_id, to_id, 'to' FROM transfers WHERE to_id NOT IN (SELECT account_id FROM accounts WHERE bank_id <> '5')""",
)
add("broken_patterns", "SELECT pattern_id, typology, account_id FROM members WHERE account_id NOT IN (SELECT account_id FROM inset)")
add(
    "pattern_connectivity",
    """SELECT count(*) AS checked, count(*) FILTER (ok) AS fully_preserved FROM (SELECT pattern_id, bool_and(account_id IN (SELECT account_id FROM sampled)) AS ok FROM members GROUP BY 1)""",
)
add("remaining_pool", "SELECT account_id FROM pool")
add("seeded_fill", f"SELECT account_id FROM pool ORDER BY sha256(account_id || '|{rg.SEED}'), account_id LIMIT 500")
add("sample_accounts", "SELECT account_id FROM sampled")
add("accounts_in_sample", "SELECT account_id, entity_name, bank_id FROM accounts WHERE account_id IN (SELECT account_id FROM sampled)")
add("subsample", "SELECT from_id, to_id, is_laundering, count(*) AS transfers FROM kept GROUP BY 1, 2, 3")
add(
    "sample_stats",
    """SELECT 'raw' AS side, count(*) AS total, count(*) FILTER (is_laundering = 1) AS labelled, round(count(*) FILTER (is_laundering = 1) / count(*) * 100, 4) AS ratio_pct FROM transfers
UNION ALL SELECT 'sampled', count(*), count(*) FILTER (is_laundering = 1), round(count(*) FILTER (is_laundering = 1) / count(*) * 100, 4) FROM kept""",
)
add(
    "rejected_transfers",
    """SELECT CASE WHEN why = '' THEN 'accepted' ELSE why END AS why, count(*) AS transfers,
  CASE WHEN why = '' THEN CAST(sum(CAST(round(amount_paid * 100) AS BIGINT)) AS BIGINT) END AS cents FROM (
  SELECT amount_paid, concat_ws('+', CASE WHEN day(ts) = 30 THEN 'ts' END, CASE WHEN month(ts) = 2 THEN 'from_bank' END,
    CASE WHEN day(ts) = 31 THEN 'amount_received' END, CASE WHEN month(ts) = 2 AND day(ts) = 1 THEN 'is_laundering' END) AS why FROM transfers) GROUP BY why""",
)
add("missing_accounts", "SELECT DISTINCT account_id FROM members WHERE account_id NOT IN (SELECT account_id FROM inset)")
add(
    "seed_alert",
    f"""SELECT from_id AS account_id, 'SUSPICIOUS_WIRE' AS alert_type, concat('Wire activity between ', from_id, ' and ', to_id, ' flagged as laundering in the labeled dataset.') AS narrative_hint
FROM (SELECT *, row_number() OVER (ORDER BY md5(concat(from_id, to_id, strftime(ts, '%Y-%m-%d %H:%M:%S'))), amount_paid) AS r, count(*) OVER () AS n FROM transfers WHERE is_laundering = 1)
WHERE r = {rg.SEED} % n + 1""",
)
add("adjacency_hops", *_hops(2, 60_000.0))
add(
    "alert_bundles",
    """SELECT account_id, coalesce(transfers_total, 0) AS transfers_total, coalesce(neighbours_total, 0) AS neighbours_total,
  coalesce(transfers, '') AS transfers, coalesce(neighbours, '') AS neighbours
FROM alerts LEFT JOIN listed USING (account_id) LEFT JOIN around USING (account_id)""",
    {
        "side": """SELECT * FROM (
  SELECT from_id AS account_id, to_id AS other, ts, CAST(round(amount_paid * 100) AS BIGINT) AS sent, 0 AS received FROM transfers
  UNION ALL SELECT to_id, from_id, ts, 0, CAST(round(amount_received * 100) AS BIGINT) FROM transfers) WHERE account_id IN (SELECT account_id FROM alerts)""",
        "dated": """SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, other, sent, received) AS place
FROM side WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-01-01'""",
        "nearest": """SELECT account_id, other, sum(sent + received) AS amount, count(*) AS n,
  row_number() OVER (PARTITION BY account_id ORDER BY sum(sent + received) DESC, other) AS place FROM side GROUP BY account_id, other""",
        "listed": """SELECT account_id, count(*) AS transfers_total,
  string_agg(concat(strftime(ts, '%Y-%m-%d'), ' ', other, ' ', sent, ' ', received), '|' ORDER BY place) FILTER (place <= 10) AS transfers FROM dated GROUP BY account_id""",
        "around": """SELECT account_id, count(*) AS neighbours_total,
  string_agg(concat(other, ' ', amount, ' ', n), '|' ORDER BY place) FILTER (place <= 5) AS neighbours FROM nearest GROUP BY account_id""",
    },
)
add(
    "discover",
    """SELECT account_id, entity_name, total_transactions, total_sent, distinct_counterparties, coalesce(entry_id, '') AS entry_id, score, is_match FROM enriched""",
)
add("enrich", "SELECT account_id, neighbours_total, subgraph_edges, subgraph_amount, truncated, deposit_count, flagged, listed_program FROM enriched")
add("assess", "SELECT account_id, risk_level, replace(findings, '; Struct', '|Struct') AS key_findings FROM assessed")
add(
    "investigation_reports",
    """SELECT account_id, risk_level, d AS disposition, concat('Account ', account_id, ': ', risk_level, ' risk, recommended disposition ''', d, '''.') AS summary,
  concat('Findings: ', findings, '.') AS narrative, 'Manual review recommended (automated narrative unavailable).' AS next_steps
FROM (SELECT *, CASE risk_level WHEN 'high' THEN 'escalate' WHEN 'medium' THEN 'monitor' ELSE 'cleared' END AS d FROM assessed)""",
)
add(
    "latest_disposition",
    f"""SELECT account_id, disposition, rationale, {ts('recorded_at')} AS recorded_at FROM disp
QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY recorded_at DESC, disposition DESC, rationale DESC) = 1""",
)

# ---- screening ------------------------------------------------------------------------------------
add("normalise_names", f"SELECT ent_num, {_norm('name')} AS normal, {_sorted(_norm('name'))} AS sorted, concat('{REFERENCE_URL}', ent_num) AS reference_url FROM watch")
add("clean_fields", f"SELECT ent_num, sdn_type, {text_list('[program, upper(sdn_type)]')} AS programs FROM watch")
add("attach_aliases", "SELECT w.ent_num, w.name, a.alias FROM watch w LEFT JOIN alias a ON w.ent_num = a.ent_num")
add(
    "watchlist_stats",
    """SELECT concat('type:', sdn_type) AS metric, count(*) AS value FROM watch GROUP BY 1 UNION ALL SELECT 'entries', count(*) FROM watch
UNION ALL SELECT 'aliases', count(*) FROM alias WHERE ent_num IN (SELECT ent_num FROM watch)""",
)
_ALLNAMES = {
    "alln": """SELECT sdn_type, name, ent_num, false AS is_alias FROM watch UNION ALL SELECT w.sdn_type, a.alias, a.ent_num, true FROM alias a JOIN watch w ON a.ent_num = w.ent_num"""
}
add(
    "name_index",
    "SELECT sdn_type, name, is_alias, count(*) AS entries, min(CAST(ent_num AS BIGINT)) AS first_entry FROM alln GROUP BY 1, 2, 3",
    _ALLNAMES,
)
_ASKED = {"askedn": f"SELECT query, {_norm('query')} AS n, {_sorted(_norm('query'))} AS s FROM asked"}
add(
    "screen_best",
    f"""SELECT sdn_type, query, matched_name, score, CAST(first_entry AS VARCHAR) AS entry_id, score >= 70 AS is_match, concat('{REFERENCE_URL}', first_entry) AS reference_url FROM (
  SELECT l.sdn_type, q.query, l.name AS matched_name, l.first_entry, {_score('q', 'l')} AS score FROM askedn q, (SELECT * FROM names WHERE sdn_type IN ('entity', 'vessel')) l)
QUALIFY row_number() OVER (PARTITION BY sdn_type, query ORDER BY score DESC, matched_name) = 1""",
    _ASKED,
)
add(
    "screen_top",
    f"""SELECT DISTINCT t.matched_name, t.query, t.score, CAST(t.place AS INT) AS place, a.ent_num AS entry_id, t.score >= 70 AS is_match FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, matched_name) AS place FROM (
    SELECT q.query, l.name AS matched_name, {_score('q', 'l')} AS score FROM askedn q, (SELECT name, {_norm('name')} AS n, {_sorted(_norm('name'))} AS s FROM (SELECT DISTINCT name FROM alln)) l)
  QUALIFY place <= 5) t JOIN alln a ON a.name = t.matched_name""",
    {**_ALLNAMES, **_ASKED},
)
add(
    "entry_detail",
    """SELECT i.ent_num, w.name, w.sdn_type, w.program, w.ent_num IS NOT NULL AS found FROM (SELECT DISTINCT CAST(l_partkey + l_linenumber * 300 AS VARCHAR) AS ent_num FROM lineitem) i
LEFT JOIN watch w ON i.ent_num = w.ent_num""",
)

# ---- scenarios, quality, shaping ------------------------------------------------------------------
add("judge_scenarios", "SELECT id, agent_id, attack_class, failure IS NULL AS passed, failure FROM judged")
add(
    "scenario_report",
    "SELECT count(*) AS total, count(*) FILTER (failure IS NULL) AS passed, count(*) FILTER (failure IS NOT NULL) AS failed, count(DISTINCT attack_class) AS attack_classes FROM judged",
)
add("last_entry", f"SELECT agent_id, last_id, status, {ts('ts')} AS ts FROM lastrow")
add(
    "reject_reasons",
    """SELECT CASE WHEN status NOT IN ('COMPLETED', 'DENIED') THEN 'status' WHEN latency_ms > 1500 THEN 'latency' WHEN coalesce(hitl_decision, 'APPROVED') <> 'APPROVED' THEN 'review' ELSE 'accepted' END AS result,
  count(*) AS calls FROM calls GROUP BY 1""",
)
add("invalid_dispositions", "SELECT account_id, count(*) AS rows FROM disp WHERE contains(rationale, 'S:1') GROUP BY 1")
add("seasonal_profile", "SELECT * FROM profile")
add(
    "in_windows",
    """SELECT id, EXISTS (SELECT 1 FROM calls w WHERE w.status = 'UPSTREAM_ERROR' AND c.ts >= w.ts AND c.ts < w.ts + INTERVAL 2 HOUR) AS in_window FROM calls c""",
)
add("apportion", "SELECT weekday, hour, row_count FROM shares")
_DRAW = "CAST(('0x' || substring(md5(concat_ws('|', weekday, hour, unit)), 1, 8)) AS BIGINT)::DOUBLE / 4294967296::DOUBLE"
add(
    "expand_by_count",
    """SELECT weekday, hour, unit, CASE WHEN draw < 0.1 THEN 'DENY' WHEN draw < 0.16 THEN 'HELD_APPROVED' WHEN draw < 0.18 THEN 'HELD_DENIED' WHEN draw < 0.2 THEN 'UPSTREAM_ERROR' ELSE 'PASS' END AS label,
  list_extract(['alice', 'bob', 'carol', 'dave'], CAST(floor(draw * 4) AS INT) + 1) AS reviewer FROM drawn""",
    {
        "units": "SELECT weekday, hour, unnest(range(row_count)) AS unit FROM shares WHERE row_count > 0",
        "drawn": f"SELECT *, {_DRAW} AS draw FROM units",
    },
)
add("clip_latency", "SELECT id, CAST(greatest(10, least(8000, latency_ms * 4 - 400)) AS INT) AS latency_ms FROM calls")
add(
    "append_burst",
    """SELECT agent_id, status, count(*) AS calls FROM (SELECT agent_id, status FROM calls UNION ALL SELECT 'agent-0217', 'DENIED' FROM calls WHERE tool = 'check_entity') GROUP BY 1, 2""",
)
