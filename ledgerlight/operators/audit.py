"""The audit log: pairing, look-ups, canonical text, hash chains and their verification."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.session import cut_lineage

# Fixed value: what the first entry of a chain points back to.
GENESIS = "0" * 64
# Fixed value: decision statuses that start a call.
DECISION_STATUSES = ["INTENT", "HELD", "DENIED"]


def call_pairs(audit: DataFrame) -> DataFrame:
    """One row per call: its first row joined to the row that closed it.

    Both rows share ``coalesce(parent_id, id)``, so one partial aggregation does
    the work of a self-join with a single shuffle of at most two rows per key.
    """
    opening = F.col("parent_id").isNull()
    opened = F.max(
        F.when(
            opening,
            F.struct("id", "ts", "status", "agent_id", "session_id", "server", "tool", "outcome", "fired_policy", "reviewer_group", "reason"),
        )
    )
    closed = F.max(F.when(~opening, F.struct("id", "ts", "status", "reason", "latency_ms", "hitl_decision", "hitl_reviewer")))
    pairs = audit.groupBy(F.coalesce("parent_id", "id").alias("call_key")).agg(opened.alias("o"), closed.alias("c"))
    wait = (F.unix_micros("c.ts") - F.unix_micros("o.ts")) / 1_000_000 - F.coalesce("c.latency_ms", F.lit(0)) / 1000
    return pairs.filter("o IS NOT NULL").select(
        F.col("o.id").alias("id"),
        F.col("c.id").alias("closed_id"),
        F.col("o.ts").alias("opened_at"),
        F.col("c.ts").alias("closed_at"),
        F.col("o.agent_id").alias("agent_id"),
        F.col("o.session_id").alias("session_id"),
        F.col("o.server").alias("server"),
        F.col("o.tool").alias("tool"),
        F.col("o.outcome").alias("outcome"),
        F.col("o.fired_policy").alias("fired_policy"),
        F.col("o.reviewer_group").alias("reviewer_group"),
        F.col("o.status").alias("opened_as"),
        F.col("c.status").alias("final_status"),
        F.coalesce("c.reason", "o.reason").alias("reason"),
        F.col("c.latency_ms").alias("latency_ms"),
        F.col("c.hitl_decision").alias("hitl_decision"),
        F.col("c.hitl_reviewer").alias("hitl_reviewer"),
        F.when(F.col("o.status") == "HELD", F.round(wait).cast("int")).alias("review_wait_seconds"),
    )


def agent_actions(audit: DataFrame, agent_id: str, first: str, last: str) -> DataFrame:
    inside = F.col("ts").between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp"))
    return audit.filter((F.col("agent_id") == agent_id) & inside).orderBy("id")


def session_replay(audit: DataFrame, session_id: str) -> DataFrame:
    return audit.filter(F.col("session_id") == session_id).orderBy("id")


def reviewer_decisions(audit: DataFrame, reviewer: str | None = None) -> DataFrame:
    decided = audit.filter(F.col("hitl_decision").isNotNull() & F.col("hitl_reviewer").isNotNull())
    return decided if reviewer is None else decided.filter(F.col("hitl_reviewer") == reviewer)


def decision_events(audit: DataFrame) -> DataFrame:
    """Rows that define a decision; a denial that follows a hold has a parent and is left out."""
    return audit.filter(F.col("status").isin(DECISION_STATUSES) & F.col("parent_id").isNull())


def archive_tiers(calls: DataFrame, as_of: str) -> DataFrame:
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("ts"))
    return calls.withColumn(
        "tier", F.when(age <= 30, "hot").when(age <= 90, "warm").otherwise("cold")
    )


def _escape_piece(piece: Column) -> Column:
    point = F.ascii(piece)

    def unit(value: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(value.cast("bigint")), 4, "0")))

    above = point - 0x10000
    pair = F.concat(
        unit(F.lit(0xD800) + F.shiftright(above, 10)), unit(F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF)))
    )
    return F.when((point >= 32) & (point <= 126), piece).when(point < 0x10000, unit(point)).otherwise(pair)


def ascii_only(text: Column) -> Column:
    """Write every character outside printable ASCII as ``\\uXXXX`` (UTF-16 units)."""
    pieces = F.regexp_extract_all(text, F.lit("[ -~]+|[^ -~]"), F.lit(0))  # printable runs stay whole
    escaped = F.concat_ws("", F.transform(pieces, _escape_piece))
    return F.when(text.rlike("[^ -~]"), escaped).otherwise(text)


def iso_time(ts: str | Column) -> Column:
    """ISO text with an explicit UTC offset; the fraction is left out when it is zero."""
    column = F.col(ts) if isinstance(ts, str) else ts
    text = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.000000$", ""), F.lit("+00:00"))


def _sorted(field: Column, kind: T.DataType) -> Column:
    """Order struct members by name at every level and turn times into ISO text."""
    if isinstance(kind, T.StructType):
        members = sorted(kind.fields, key=lambda f: f.name)
        ordered = F.struct(*[_sorted(field.getField(f.name), f.dataType).alias(f.name) for f in members])
        return F.when(field.isNotNull(), ordered)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(field, lambda item: _sorted(item, kind.elementType))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso_time(field)
    return field


def _lower_escapes(text: Column) -> Column:
    """Escapes of control characters with small hex digits; a backslash that is itself escaped starts none."""
    lowered = text
    for code in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):
        lowered = F.regexp_replace(lowered, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
    return F.when(text.rlike(r"\\u00[01][A-F]"), lowered).otherwise(text)


def _has(kind: T.DataType, wanted: tuple[type, ...]) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has(f.dataType, wanted) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has(kind.elementType, wanted)
    return isinstance(kind, wanted) or (isinstance(kind, T.MapType) and _has(kind.valueType, wanted))


def _plain(value, kind: T.DataType):
    """An Arrow value as what ``json`` writes for its type; map keys become texts."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _plain(value[f.name], f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [_plain(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {str(k): _plain(v, kind.valueType) for k, v in value}
    return value if isinstance(value, (bool, int, float, str)) else str(value)


def _json_of(row: Column, kind: T.DataType) -> Column:
    """JSON in the JVM where its digits are the canonical ones; doubles and maps go through an Arrow function.

    The JVM lays doubles out by other rules (``1.0E-5`` for ``1e-05``) and not always in the fewest digits, and it doesn't sort maps.
    """
    if not _has(kind, (T.DoubleType, T.FloatType, T.MapType)):
        return _lower_escapes(ascii_only(F.to_json(row, {"ignoreNullFields": "false"})))

    def write(values: pa.Array) -> pa.Array:
        import json

        plain = [_plain(v, kind) for v in values.to_pylist()]
        return pa.array([None if v is None else json.dumps(v, sort_keys=True, separators=(",", ":")) for v in plain], pa.string())

    return F.arrow_udf(write, "string")(row)


def _type_of(kind: T.DataType) -> T.DataType:
    """The type that ``_sorted`` gives."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _type_of(f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_type_of(kind.elementType))
    return T.StringType() if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else kind


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Deterministic JSON of the named columns: sorted keys, no spaces, nulls kept, ASCII only, numbers in the fewest digits."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = sorted(columns or fields)
    row = F.struct(*[_sorted(F.col(name), fields[name]).alias(name) for name in names])
    return _json_of(row, T.StructType([T.StructField(name, _type_of(fields[name])) for name in names]))


def entry_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("id", "this_hash")]


def entry_hash(df: DataFrame) -> Column:
    """Hash of an entry that already carries its ``prev_hash``."""
    return F.sha2(F.concat(F.col("prev_hash"), canonical_json(df, entry_columns(df))), 256)


def args_hash(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    return F.sha2(_json_of(_sorted(F.col(column), kind), _type_of(kind)), 256)


def redaction_proof(df: DataFrame, args: str, stored_hash: str) -> DataFrame:
    """Recompute the hash of the arguments and compare it with the stored one."""
    fresh = args_hash(df, args)
    return df.withColumn("recomputed_hash", fresh).withColumn("matches", fresh == F.col(stored_hash))


def build_chain(entries: DataFrame, block_rows: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chain entries inside fixed blocks of consecutive ids.

    One chain over a whole log is sequential by definition. Here ids are cut into
    blocks of ``block_rows``; each block is folded on its own from the genesis
    value, and :func:`seal_blocks` chains the block digests. A block never holds
    more than ``block_rows`` rows, whatever the agent, server or day. ``entries``
    carry ``id`` and ``body``; ``keep`` names further columns to pass through.
    """
    blocked = entries.withColumn("block", F.floor(F.col("id") / block_rows))
    ordered = F.array_sort(F.collect_list(F.struct("id", "body", *keep)))
    folded = blocked.groupBy("block").agg(ordered.alias("rows"))
    hashes = F.aggregate(
        "rows",
        F.array(F.lit(GENESIS)),
        lambda acc, row: F.array_append(acc, F.sha2(F.concat(F.element_at(acc, -1), row["body"]), 256)),
    )
    return (
        folded.withColumn("hashes", hashes)
        .select("block", F.posexplode("rows").alias("at", "row"), "hashes")
        .select(
            F.col("row.id").alias("id"),
            "block",
            F.col("row.body").alias("body"),
            F.col("hashes")[F.col("at")].alias("prev_hash"),
            F.col("hashes")[F.col("at") + 1].alias("this_hash"),
            *[F.col(f"row.{name}").alias(name) for name in keep],
        )
    )


def seal_blocks(chained: DataFrame, fan_in: int = 64) -> DataFrame:
    """Fold the last hash of each block into one digest per ``fan_in`` blocks."""
    tails = chained.groupBy("block").agg(F.max_by("this_hash", "id").alias("tail"), F.count("*").alias("n"))
    groups = tails.groupBy(F.floor(F.col("block") / fan_in).alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("block", "tail"))).alias("tails"), F.sum("n").alias("entries")
    )
    digest = F.aggregate("tails", F.lit(GENESIS), lambda acc, t: F.sha2(F.concat(acc, t["tail"]), 256))
    return groups.select("segment", F.size("tails").alias("blocks"), "entries", digest.alias("digest"))


def seal_levels(chained: DataFrame, fan_in: int = 64) -> DataFrame:
    """(level, segment, entries, digest): the blocks' last hashes as level 0, then the digests of ``fan_in`` neighbours, up to one root.

    A segment folds the digests below it from the genesis value, so one that is missing or was changed changes every
    digest above it. Each level is a ``fan_in``-th of the one before and is a table of its own.
    """
    level = chained.groupBy(F.col("block").alias("segment")).agg(F.count("*").alias("entries"), F.max_by("this_hash", "id").alias("digest"))
    levels = [cut_lineage(level.select(F.lit(0).alias("level"), "segment", "entries", "digest"))]
    while levels[-1].agg(F.max("segment").alias("last")).first()["last"] or len(levels) == 1:
        groups = levels[-1].groupBy(F.floor(F.col("segment") / fan_in).alias("above")).agg(
            F.array_sort(F.collect_list(F.struct("segment", "digest"))).alias("below"), F.sum("entries").alias("entries")
        )
        digest = F.aggregate("below", F.lit(GENESIS), lambda acc, part: F.sha2(F.concat(acc, part["digest"]), 256))
        levels.append(cut_lineage(groups.select(F.lit(len(levels)).alias("level"), F.col("above").alias("segment"), "entries", digest.alias("digest"))))
        if levels[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def seal_root(chained: DataFrame, fan_in: int = 64) -> DataFrame:
    """One row: the root over all segments, the number of levels and of entries; none for an empty chain."""
    sealed = seal_levels(chained, fan_in)
    top = sealed.agg(F.max("level").alias("levels"), F.max_by(F.struct("digest", "entries"), "level").alias("top"))
    return top.where("levels IS NOT NULL").select(F.col("top.digest").alias("root"), "levels", F.col("top.entries").alias("entries"))


def seal_differences(kept: DataFrame, found: DataFrame) -> DataFrame:
    """(level, segment, problem): segments of the kept seal that are missing or changed now, and those that are new."""
    old = kept.select("level", "segment", F.col("digest").alias("old"))
    both = old.join(found.select("level", "segment", F.col("digest").alias("new")), ["level", "segment"], "full")
    problem = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "changed")
    return both.select("level", "segment", problem.alias("problem")).where("problem IS NOT NULL")


def chain_checks(
    entries: DataFrame, expected_hash: Column, restart: str | None = None, bucket_rows: int = 1 << 20
) -> DataFrame:
    """Per entry: does it point at the stored hash of the entry before it, and is its own hash right?

    Both tests use stored values only, so every row is checked on its own. The
    previous row comes from ``lag`` inside buckets of consecutive ids; the first
    row of a bucket takes the last hash of the previous non-empty bucket, one
    small row per bucket. ``restart`` names a column (such as the block) whose
    change starts a new chain at the genesis value.
    """
    bucketed = entries.withColumn("_bucket", F.floor(F.col("id") / bucket_rows)).withColumn("_expected", expected_hash)
    restart_value = F.col(restart).cast("string") if restart else F.lit("chain")
    bucketed = bucketed.withColumn("_chain", restart_value)
    tails = bucketed.groupBy("_bucket").agg(F.max_by(F.struct("this_hash", "_chain"), "id").alias("_tail"))
    over_buckets = Window.orderBy("_bucket")  # one row per bucket of a million ids
    tails = tails.select("_bucket", F.lag("_tail").over(over_buckets).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy("id")
    previous = F.coalesce(F.lag(F.struct("this_hash", "_chain")).over(inside), F.col("_before"))
    linked = bucketed.join(tails, "_bucket").withColumns(
        {"_previous": previous, "_place": F.row_number().over(inside)}
    )
    expected_prev = F.when(
        F.col("_previous._chain") == F.col("_chain"), F.col("_previous.this_hash")
    ).otherwise(F.lit(GENESIS))
    checked = linked.withColumn("expected_prev", expected_prev)
    return checked.withColumn("link_ok", F.col("prev_hash").eqNullSafe(F.col("expected_prev"))).withColumn(
        "content_ok", F.col("this_hash").eqNullSafe(F.col("_expected"))
    ).drop("_chain", "_before", "_previous")


def broken_entries(checks: DataFrame) -> DataFrame:
    """Every broken entry; a wrong link is reported before wrong content."""
    problem = F.when(~F.col("link_ok"), "broken_link").when(~F.col("content_ok"), "changed_content")
    return checks.withColumn("problem", problem).filter("problem IS NOT NULL")


def verify_chain(checks: DataFrame, since: str | None = None) -> DataFrame:
    """One row: valid, rows checked before the first bad entry, that entry's id and what is wrong.

    Rows before the first bad one all passed, so counting them gives the answer of
    a sequential walk. Two mergeable aggregates, no global sort.
    """
    bad = ~(F.col("link_ok") & F.col("content_ok"))
    # The two texts.
    detail = F.when(
        ~F.col("link_ok"),
        F.concat(
            F.lit("entry "), F.col("id").cast("string"), F.lit(" has prev_hash='"), F.col("prev_hash"),
            F.lit("', expected '"), F.col("expected_prev"), F.lit("' (the prior entry's this_hash)"),
        ),
    ).otherwise(
        F.concat(
            F.lit("entry "), F.col("id").cast("string"), F.lit(" this_hash='"), F.col("this_hash"),
            F.lit("' does not match recomputed '"), F.col("_expected"),
            F.lit("' -- content was modified after writing"),
        )
    )
    scope = F.lit(True) if since is None else F.col("ts") >= F.lit(since).cast("timestamp")
    per_bucket = checks.groupBy("_bucket").agg(
        F.min(F.when(bad, F.struct("id", "_place", detail.alias("detail")))).alias("bad"),
        F.count("*").alias("n"),
        F.count_if(scope).alias("n_in_scope"),
    )
    # One row per bucket of a million ids from here on.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_bucket.withColumn("prior", F.coalesce(F.sum("n").over(before), F.lit(0)))
    first = F.min(
        F.when(
            F.col("bad").isNotNull(),
            F.struct("bad.id", (F.col("prior") + F.col("bad._place") - 1).alias("checked"), "bad.detail"),
        )
    )
    whole = placed.agg(
        first.alias("first"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("n_in_scope"), F.lit(0)).alias("in_scope"),
    )
    return whole.select(
        F.col("first").isNull().alias("valid"),
        F.coalesce("first.checked", "total").alias("checked"),
        F.col("first.id").alias("first_mismatch_id"),
        F.col("first.detail").alias("detail"),
        "total",
        "in_scope",
    )
