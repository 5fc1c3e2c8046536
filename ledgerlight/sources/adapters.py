"""Views of the driver's tables in the shapes the operators work on.

Each function is one projection (or one join) over the given Parquet files, so
filters and column pruning still reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
TYPOLOGIES = ["FAN-OUT", "FAN-IN", "CYCLE", "GATHER-SCATTER", "SCATTER-GATHER", "BIPARTITE", "STACK"]
ENTRY_TYPES = ["entity", "individual", "vessel", "aircraft"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One terminal row per tool call, from ``events``."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return events.selectExpr(
        "event_id AS id",
        "ts",
        "to_date(ts) AS day",
        "concat('agent-', lpad(CAST(user_id % 500 AS STRING), 4, '0')) AS agent_id",
        "concat('s-', CAST(user_id AS STRING), '-', CAST(to_date(ts) AS STRING)) AS session_id",
        """CASE WHEN event_type = 'click' THEN 'ofac-sanctions'
                WHEN event_type = 'error' THEN concat('server-', lpad(CAST(k % 18 AS STRING), 2, '0'))
                ELSE 'transaction-graph' END AS server""",
        """CASE event_type WHEN 'click' THEN 'check_entity' WHEN 'view' THEN 'query_transactions'
                WHEN 'signup' THEN 'structuring_check' WHEN 'purchase' THEN 'mark_investigated'
                ELSE concat('tool_', CAST(k % 6 AS STRING)) END AS tool""",
        """CASE WHEN k < 10 THEN 'DENIED' WHEN k < 16 THEN 'COMPLETED' WHEN k < 18 THEN 'DENIED'
                WHEN k < 20 THEN 'UPSTREAM_ERROR' ELSE 'COMPLETED' END AS status""",
        "CASE WHEN k >= 10 AND k < 16 THEN 'APPROVED' WHEN k >= 16 AND k < 18 THEN 'DENIED' END AS hitl_decision",
        "CAST(10 + floor(value * 10) AS INT) AS latency_ms",
        "k",
    )


def with_policies(call_rows: DataFrame) -> DataFrame:
    """Add outcome, the deciding policy and every policy that applied."""
    return call_rows.selectExpr(
        "*",
        "CASE WHEN k < 10 THEN 'DENY' WHEN k < 18 THEN 'HOLD' ELSE 'PASS' END AS outcome",
        """CASE WHEN k < 10 AND server = 'ofac-sanctions' THEN 'aml-rate-limit-sanctions'
                WHEN k < 10 AND server = 'transaction-graph' THEN 'aml-sanctions-required'
                WHEN k < 10 THEN 'generic-denylist'
                WHEN k < 18 THEN 'aml-write-hitl-gate' END AS fired_policy""",
        """CASE WHEN k < 10 AND server = 'ofac-sanctions' THEN 'rate_limit'
                WHEN k < 10 AND server = 'transaction-graph' THEN 'custom'
                WHEN k < 10 THEN 'denylist'
                WHEN k < 18 THEN 'hitl_gate' END AS fired_effect""",
        """CASE server WHEN 'transaction-graph' THEN 'aml-analysts'
                WHEN 'ofac-sanctions' THEN 'sanctions-desk' ELSE 'platform-reviewers' END AS reviewer_group""",
    ).selectExpr(
        "*",
        """CASE WHEN fired_policy IS NULL
                THEN array(named_struct('policy', 'aml-audit-tagging', 'effect_type', 'tag_only'))
                ELSE array(named_struct('policy', 'aml-audit-tagging', 'effect_type', 'tag_only'),
                           named_struct('policy', fired_policy, 'effect_type', fired_effect))
           END AS policies_fired""",
        """CASE WHEN tool = 'structuring_check' AND k >= 80
                THEN array('pack:aml', 'regulation:BSA', 'incident:structuring', 'severity:high')
                ELSE array('pack:aml', 'regulation:BSA') END AS tags""",
    )


def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that carry token counts: the ones that completed."""
    return calls(spark, sf_dir).filter("status = 'COMPLETED'").selectExpr(
        "id",
        "ts",
        "day",
        "agent_id",
        "session_id",
        "CASE WHEN k % 10 < 7 THEN 'provider-a' ELSE 'provider-b' END AS provider",
        "CAST(100 + k * 15 AS BIGINT) AS prompt_tokens",
        "CAST(20 + k * 5 AS BIGINT) AS completion_tokens",
        "CAST((100 + k * 15) * 2 + (20 + k * 5) * 60 AS DOUBLE) / 10000000 AS cost_usd",
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two linked rows per forwarded or held call, one row per denied call."""
    base = with_policies(calls(spark, sf_dir))
    both = base.withColumn(
        "leg", F.explode(F.when(F.col("k") < 10, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))
    )
    return both.selectExpr(
        "id * 2 + leg AS id",
        "CASE WHEN leg = 1 THEN id * 2 END AS parent_id",
        "id AS call_id",
        """CASE WHEN leg = 0 THEN ts
                ELSE timestamp_micros(unix_micros(ts) + latency_ms * 1000L
                     + CASE WHEN outcome = 'HOLD' THEN (30 + k * 5) * 1000000L ELSE 0L END) END AS ts""",
        "agent_id",
        "session_id",
        "server",
        "tool",
        """CASE WHEN leg = 1 THEN status WHEN outcome = 'HOLD' THEN 'HELD'
                WHEN outcome = 'DENY' THEN 'DENIED' ELSE 'INTENT' END AS status""",
        "outcome",
        "fired_policy",
        """CASE WHEN k < 10 THEN 'policy_denied'
                WHEN k = 17 AND leg = 1 THEN 'hitl_timeout'
                WHEN k = 18 AND leg = 1 THEN 'upstream_unreachable'
                WHEN k = 19 AND leg = 1 THEN 'response_policy_error'
                WHEN k < 18 AND leg = 0 THEN 'hitl_required' END AS reason""",
        "policies_fired",
        "tags",
        "CASE WHEN leg = 1 THEN latency_ms END AS latency_ms",
        "CASE WHEN leg = 1 AND k <> 17 THEN hitl_decision END AS hitl_decision",
        "CASE WHEN leg = 1 AND k >= 10 AND k < 17 THEN concat('reviewer-', CAST(k % 4 AS STRING)) END AS hitl_reviewer",
        "CASE WHEN leg = 1 AND k >= 10 AND k < 17 THEN concat('case ', CAST(id AS STRING)) END AS hitl_rationale",
        "reviewer_group",
        "CASE WHEN outcome = 'HOLD' THEN 30 + k * 5 END AS review_seconds",
        "k",
    )


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers pay suppliers: one edge per line item."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr(
        "concat('C:', CAST(o_custkey AS STRING)) AS from_id",
        "concat('S:', CAST(l_suppkey AS STRING)) AS to_id",
        "CAST(l_shipdate AS TIMESTAMP) AS ts",
        "l_extendedprice AS amount_paid",
        "floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS amount_received",
        "CASE l_returnflag WHEN 'A' THEN 'ACH' WHEN 'R' THEN 'Wire' ELSE 'Cheque' END AS payment_format",
        "CASE WHEN l_partkey % 100 = 0 THEN 1 ELSE 0 END AS is_laundering",
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers; customers of one market segment trade under a listed name in other word order."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    buyers = table(spark, sf_dir, "customer")
    customers = buyers.join(parts, buyers.c_custkey == parts.p_partkey, "left").selectExpr(
        "concat('C:', CAST(c_custkey AS STRING)) AS account_id",
        "CASE WHEN c_mktsegment = 'MACHINERY' AND p_name IS NOT NULL THEN concat(p_brand, ' ', p_name) ELSE c_name END AS entity_name",
        "CAST(c_nationkey AS STRING) AS bank_id",
    )
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "concat('S:', CAST(s_suppkey AS STRING)) AS account_id",
        "s_name AS entity_name",
        "CAST(s_nationkey AS STRING) AS bank_id",
    )
    return customers.unionByName(suppliers)


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ", ".join(f"'{kind}'" for kind in ENTRY_TYPES)
    return table(spark, sf_dir, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS ent_num",
        "concat(p_name, ' ', p_brand) AS name",
        f"element_at(array({kinds}), p_size % 4 + 1) AS sdn_type",
        "p_type AS program",
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS ent_num", "concat(p_brand, ' ', p_name) AS alias"
    )


def name_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to screen: every listed name with its first letter dropped, and every supplier."""
    altered = table(spark, sf_dir, "part").selectExpr(
        "substring(concat(p_name, ' ', p_brand), 2) AS query",
    )
    plain = table(spark, sf_dir, "supplier").selectExpr("s_name AS query")
    return altered.unionByName(plain).distinct()


def screened_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name each sanctions call asked about."""
    checks = calls(spark, sf_dir).filter("server = 'ofac-sanctions'")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return checks.join(parts, checks["id"] == parts.p_partkey, "left").selectExpr(
        "id", "coalesce(concat(p_brand, ' ', p_name), agent_id) AS query"
    )


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled transfers as chains, one chain per receiver."""
    names = ", ".join(f"'{name}'" for name in TYPOLOGIES)
    return transfers(spark, sf_dir).filter("is_laundering = 1").selectExpr(
        "to_id AS pattern_id",
        f"element_at(array({names}), CAST(substring(to_id, 3) AS INT) % 7 + 1) AS typology",
        "from_id",
        "to_id",
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents and conversation turns."""
    documents = table(spark, sf_dir, "documents").selectExpr(
        "concat('d-', CAST(doc_id AS STRING)) AS payload_id", "text"
    )
    turns = table(spark, sf_dir, "conversations").selectExpr(
        "concat('c-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS payload_id", "text"
    )
    return documents.unionByName(turns)
