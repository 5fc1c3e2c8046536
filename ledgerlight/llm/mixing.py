"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import hex_bucket, running, seeded_key, text_mark, whole_text, word_count

#: Weights given to the sources in code-point order, repeating, null last.
WEIGHTS = (5, 2, 1)
#: For each weight in turn: knots (time, weight) of a piecewise linear schedule over the training time 0 to 1.
SCHEDULES = (((0.0, 1.4), (1.0, 0.6)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.4), (0.5, 1.0), (1.0, 1.6)))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Adds weight, schedule (its index) and target to one row per source (``stratum``, ``source_size``).

    ``share`` of all words is dealt by weight; a target stops at ``most`` times its source and
    the excess goes to the others by weight. The end of that resharing is found directly: all
    targets are min(weight * level, cap), and the level follows from the sources in order of cap / weight.
    The table has a row per source, so its windows are small.
    """
    turn = (F.row_number().over(Window.orderBy("stratum")) - 1) % len(weights)
    rows = sizes.withColumn("schedule", turn.cast("int"))
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("schedule") + 1).cast("long"))
    rows = rows.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("fills_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fills_at", "stratum")
    whole = Window.partitionBy()
    full = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "full_words": F.coalesce(F.sum("cap").over(full), F.lit(0)),
        "open_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(full), F.lit(0)),
        "budget": F.lit(share) * F.sum("source_size").over(whole),
    })
    rows = rows.withColumn("level", (F.col("budget") - F.col("full_words")) / F.col("open_weight"))
    # the level holds from the first source that it doesn't fill
    rows = rows.withColumn("level", F.min(F.when(F.col("level") < F.col("fills_at"), F.struct("fills_at", "stratum", "level"))).over(whole)["level"])
    target = F.when(F.col("level").isNull() | (F.col("fills_at") <= F.col("level")), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return rows.select("stratum", "source_size", "weight", "schedule", target.alias("target"))


def training_time(share: Column, schedule: Column, schedules: Sequence = SCHEDULES) -> Column:
    """The time at which ``share`` (0 to 1) of a source's demand is used up.

    Each schedule is integrated segment by segment and scaled to a demand of 1; the share is
    looked up in the segment's bounds and the segment's quadratic is solved for the time.
    """
    by_schedule = F.lit(None).cast("double")
    for index, knots in enumerate(schedules):
        segments = [(t0, w0, t1, w1, (t1 - t0) * (w0 + w1) / 2) for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
        whole = sum(area for *_, area in segments)
        begun, time = whole, F.lit(None).cast("double")
        for t0, w0, t1, w1, area in reversed(segments):
            begun -= area
            slope = (w1 - w0) / (t1 - t0)
            rest = share * F.lit(whole) - F.lit(begun)
            if slope:
                here = F.lit(t0) + (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
            else:
                here = F.lit(t0) + rest / F.lit(w0)
            time = F.when(rest >= 0, here).otherwise(time) if t0 > knots[0][0] else F.coalesce(time, here)
        by_schedule = F.when(schedule == index, time).otherwise(by_schedule)
    return by_schedule


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence = SCHEDULES, share: float = 1.5, most: int = 2,
    seed: int = 23, rows_per_bucket: int = 2000, carry: bool = False,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, first_at, later_at, last_take.

    A source's documents are shuffled by a seeded key into a stream that starts anew when it is
    used up; the mix takes the stream's first ``target`` words. A document that the end of the
    target falls into is taken in part (``last_take`` words of its last copy). A copy that
    starts after the share u of its source's target is trained at the time when the source's
    integrated weight schedule has reached u: first_at for the first copy, later_at for the others.

    Cumulative words are two-level sums over (source, slice of the key). A null text has no
    words and is never taken; a null source is a source of its own, last in order; documents
    without words, empty sources and empty tables give size 0, taken 0. Rows equal in doc_id,
    source and text share the stream like any others. With ``carry`` the whole input row is
    kept in the struct ``row``.
    """
    rows = docs.select(
        "doc_id", text_mark(F.col("text")).alias("mark"), word_count(whole_text()).alias("size"),
        F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("2")).alias("stratum"), seeded_key(seed, F.col("doc_id")).alias("key"),
        *([F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row")] if carry else []),
    )
    buckets = max(1, docs.select("doc_id").count() // rows_per_bucket)
    targets = source_targets(rows.drop("row").groupBy("stratum").agg(F.sum("size").alias("source_size")), weights, share, most)
    streamed = running(rows.withColumn("part", hex_bucket(F.col("key"), buckets)), ["stratum"], "part", ["key", "doc_id", "mark"], {"begin": "size"})
    placed = streamed.join(targets, "stratum").withColumn("words", F.floor("target"))
    part = lambda e: F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - F.lit(e) * F.col("source_size") - F.col("begin")))
    at = lambda e: F.when(F.col(f"take{e}") > 0, training_time((F.lit(e) * F.col("source_size") + F.col("begin")) / F.col("target"), F.col("schedule"), schedules))
    placed = placed.withColumns({f"take{e}": part(e) for e in range(most)})
    taken = sum((F.col(f"take{e}") for e in range(1, most)), F.col("take0"))
    copies = sum(((F.col(f"take{e}") > 0).cast("int") for e in range(1, most)), (F.col("take0") > 0).cast("int"))
    later = F.array_compact(F.array(*[at(e) for e in range(1, most)])) if most > 1 else F.array().cast("array<double>")
    return placed.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"),
        at(0).alias("first_at"), later.alias("later_at"),
        F.coalesce(*[F.when(F.col(f"take{e}") > 0, F.col(f"take{e}")) for e in reversed(range(most))], F.lit(0)).alias("last_take"),
        *(["row"] if carry else []),
    )


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its ``words``-th word, white space kept."""
    lead = F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0)
    rest = F.substring(text, F.length(lead) + 1, F.length(text))
    return F.concat(lead, F.array_join(F.slice(F.split(rest, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), words), ""))


def training_stream(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``, one per copy, sorted by training time over all partitions.

    The last copy of a document that a target ends in holds the words that are taken, and
    where there is a column n_chars it is counted anew. All columns of ``docs`` are kept.
    """
    taken = mix(docs, carry=True, **options).where("taken > 0")
    copies = taken.select("row", "size", "copies", "last_take", F.posexplode(F.concat(F.array("first_at"), "later_at")).alias("copy", "at"))
    cut = (F.col("copy") + 1 == F.col("copies")) & (F.col("last_take") < F.col("size"))
    text = F.when(cut, first_words(F.col("row.text"), F.col("last_take").cast("int"))).otherwise(F.col("row.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    sorted_rows = copies.repartitionByRange("at", "row.doc_id").sortWithinPartitions("at", "row.doc_id", "copy")
    return sorted_rows.select(*[changed.get(n, F.col(f"row.`{n}`")).alias(n) for n in docs.columns])
