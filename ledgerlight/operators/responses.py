"""Response stage: redaction, tagging and session flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.redact import has_injection_marker, redact_in_order
from ledgerlight.operators.policy import RESPONSE_RULES, attach_rules, register_response_rule, rule_sets
from ledgerlight.session import cut_lineage

# Tags and how long a session flag lasts.
STRUCTURING_TAGS = ["incident:structuring", "severity:high"]
INJECTION_TAG = "prompt-injection-detected"
FLAG_SECONDS = 24 * 60 * 60


def _tags(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


@register_response_rule("aml_structuring_alert")
def structuring_tags(responses: DataFrame) -> Column:
    return F.when(F.col("flagged"), _tags(*STRUCTURING_TAGS)).otherwise(_tags())


@register_response_rule("hello_echo_prompt_injection_scan")
def injection_tags(responses: DataFrame) -> Column:
    return F.when(has_injection_marker(F.col("payload")), _tags(INJECTION_TAG)).otherwise(_tags())


def evaluate_responses(responses: DataFrame, rules: DataFrame) -> DataFrame:
    """Redact and tag ``responses(id, server, tool, payload, flagged)``; nothing is ever denied here.

    Patterns of the call's redaction rules are applied in the order in which the rules
    and their lists name them. A response rule without a registered function fails closed:
    ``policy_error`` is set and the payload withheld.
    """
    # The rule sets are a written table: Spark knows how small it is, and the payloads are not shuffled to the few
    # (server, tool) pairs that there are.
    ruled = attach_rules(responses, rules, cut_lineage(rule_sets(responses, rules)))
    redacted = redact_in_order(F.col("payload"), F.coalesce("patterns", _tags()))
    known = F.array(*[F.lit(name) for name in RESPONSE_RULES])
    unknown = F.coalesce(F.size(F.array_except("response_rules", known)) > 0, F.lit(False))
    tags = _tags()
    for name, rule in RESPONSE_RULES.items():
        applies = F.array_contains("response_rules", name)
        tags = F.concat(tags, F.when(F.coalesce(applies, F.lit(False)), rule(responses)).otherwise(_tags()))
    return ruled.select(
        *[c for c in responses.columns if c != "payload"],
        F.when(~unknown, redacted).alias("payload"),
        F.when(unknown, F.lit("response_policy_error")).alias("policy_error"),
        F.array_union("static_tags", tags).alias("tags"),
        F.array_distinct(tags).alias("response_tags"),
    )


def structuring_flags(responses: DataFrame) -> DataFrame:
    """Session flags raised by flagged structuring checks, each valid for 24 hours."""
    return responses.filter(F.col("flagged")).select(
        "id",
        "session_id",
        F.col("ts").alias("flag_from"),
        F.timestamp_micros(F.unix_micros("ts") + FLAG_SECONDS * 1_000_000).alias("flag_until"),
        _tags(*STRUCTURING_TAGS).alias("tags"),
    )


def injection_scan(payloads: DataFrame) -> DataFrame:
    hit = has_injection_marker(F.col("text"))
    return payloads.withColumn("tags", F.when(hit, _tags(INJECTION_TAG)).otherwise(_tags()))
