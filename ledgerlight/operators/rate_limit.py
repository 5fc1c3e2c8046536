"""Fixed-window call limits.

A window opens at the first call after the previous one expired, so where a
window starts depends on all earlier calls of the key and no window frame
expresses it. Keys with few calls are folded over their sorted call times. For
busy keys the work is split by (key, time chunk) rather than by key:

1. inside each chunk (a few windows long) every possible entry call is mapped to
   the call at which it leaves the chunk, with numpy pointer jumping;
2. the true entries are found by following those short cuts from the calls that
   certainly open a window (nothing within one window length before them),
   doubling the step each round;
3. each chunk lists its true window starts, and a running maximum gives every
   call its window.

Only distinct call times reach steps 1 and 3. The chunk length is measured: the
busiest stretch of 16 windows decides how many windows fit in a group, so sparse
logs need few groups and a busy key is cut into many.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.session import cut_lineage

GROUP_TIMES = 1_000_000
# Calls of one key that are folded in one array, and a chunk longer than all time.
FOLD_TIMES = 10_000
ONE_SPAN = 1 << 61
_OWN, _BEFORE, _AFTER, _ENTRY = 0, 1, 2, 3
_KEY = "_key"


def _exits(times: np.ndarray, own: np.ndarray, end: int, width: int) -> np.ndarray:
    """For each call: first call of its orbit at or after ``end`` (-1 when none is in sight)."""
    n = len(times)
    jump = np.append(np.searchsorted(times, times + width), n)
    inside = np.append(own & (times < end), False)
    hop = np.where(inside, jump, np.arange(n + 1))
    while True:
        further = hop[hop]
        if np.array_equal(further, hop):
            break
        hop = further
    return np.append(times, -1)[hop][:n]


def _starts(times: np.ndarray, sure: np.ndarray, entry: int | None, width: int) -> list[int]:
    """True window starts of a chunk, walking one window at a time."""
    first = entry if entry is not None else None
    if first is None:
        certain = times[sure]
        if len(certain) == 0:
            return []
        first = int(certain[0])
    found = []
    at = int(np.searchsorted(times, first))
    while at < len(times):
        found.append(int(times[at]))
        at = int(np.searchsorted(times, times[at] + width))
    return found


def busiest_key(calls: DataFrame, keys: list[str]) -> int:
    """Calls of the key that has most of them."""
    return calls.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def fixed_window_limit(
    calls: DataFrame,
    keys: list[str],
    limit: int,
    window_seconds: int,
    chunk_windows: int | None = None,
    fold_times: int = FOLD_TIMES,
    busiest: int | None = None,
) -> DataFrame:
    """``calls(id, ts, keys…)`` with ``window_start``, ``call_in_window`` and ``allowed``.

    Calls are taken in (ts, id) order; denied calls count too. Keys are counted
    first: those with at most ``fold_times`` calls are folded in one expression,
    busier ones go through the chunks (``busiest`` saves the count when it is known). A null key is a key like others.
    """
    width = window_seconds * 1_000_000
    if busiest is None:
        busiest = busiest_key(calls, keys)
    # One key column that is never null, so that joins, groups and windows alike take calls without a key as one key.
    keyed = calls.withColumn(_KEY, F.to_json(F.struct(*keys)))
    if busiest <= fold_times:
        return _numbered(keyed, _folded_starts(keyed, [_KEY], width), [_KEY], limit, width, ONE_SPAN).drop(_KEY)
    sizes = keyed.groupBy(_KEY).agg(F.count("*").alias("_n"))
    busy = sizes.filter(F.col("_n") > fold_times).select(_KEY)
    quiet = keyed.join(busy, _KEY, "left_anti")
    crowded = keyed.join(busy, _KEY, "left_semi")
    if chunk_windows is None:
        chunk_windows = _fitting_windows(crowded, [_KEY], width)
    # A chunk must reach past the two windows that its neighbours look into.
    span = max(2, chunk_windows) * width
    few = _numbered(quiet, _folded_starts(quiet, [_KEY], width), [_KEY], limit, width, ONE_SPAN)
    return few.unionByName(_numbered(crowded, _chunked_starts(crowded, [_KEY], width, span), [_KEY], limit, width, span)).drop(_KEY)


def _folded_starts(calls: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Window starts of keys with few calls: a fold over each key's sorted call times."""
    times = calls.groupBy(*keys).agg(F.array_sort(F.collect_set(F.unix_micros("ts"))).alias("times"))
    nothing = F.expr("CAST(NULL AS struct<last: bigint, starts: array<bigint>>)")

    def opened(acc, t):
        first = F.struct(t.alias("last"), F.array(t).alias("starts"))
        later = F.struct(t.alias("last"), F.array_append(acc["starts"], t).alias("starts"))
        return F.when(acc.isNull(), first).when(t - acc["last"] >= width, later).otherwise(acc)

    return times.select(*keys, F.explode(F.aggregate("times", nothing, opened)["starts"]).alias("_start"))


def _fitting_windows(calls: DataFrame, keys: list[str], width: int, base: int = 16) -> int:
    """Windows per chunk so that a group of distinct call times stays near a million."""
    stretch = F.floor(F.unix_micros("ts") / (base * width)).alias("_stretch")
    counts = calls.groupBy(*keys, stretch).agg(F.count("*").alias("n"))
    busiest = counts.agg(F.max("n")).first()[0] or 1
    return base * max(1, min(GROUP_TIMES // busiest, 1 << 10))


def _chunked_starts(calls: DataFrame, keys: list[str], width: int, span: int) -> DataFrame:
    """Window starts of busy keys, by (key, time chunk)."""
    timed = calls.withColumn("_t", F.unix_micros("ts")).withColumn("_chunk", F.floor(F.col("_t") / span))
    moments = timed.select(*keys, "_chunk", "_t").distinct()
    start, end = F.col("_chunk") * span, (F.col("_chunk") + 1) * span
    here = F.struct(F.col("_chunk").alias("c"), F.lit(_OWN).alias("kind"))
    next_chunk = F.when(F.col("_t") >= end - width, F.struct((F.col("_chunk") + 1).alias("c"), F.lit(_BEFORE).alias("kind")))
    chunk_before = F.when(F.col("_t") < start + 2 * width, F.struct((F.col("_chunk") - 1).alias("c"), F.lit(_AFTER).alias("kind")))
    spread = moments.select(
        *keys, "_t", F.inline(F.array_compact(F.array(here, next_chunk, chunk_before))).alias("_chunk", "_kind")
    )
    key_ddl = ", ".join(f"`{k}` {calls.schema[k].dataType.simpleString()}" for k in keys)

    def ordered(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        pdf = pdf.sort_values("_t")
        return pdf["_t"].to_numpy(), pdf["_kind"].to_numpy()

    def certain(times: np.ndarray, own: np.ndarray) -> np.ndarray:
        gaps = np.diff(times, prepend=times[0] - width) >= width
        return gaps & own

    def short_cuts(pdf: pd.DataFrame) -> pd.DataFrame:
        times, kinds = ordered(pdf)
        own = kinds == _OWN
        begin = int(pdf["_chunk"].iloc[0]) * span
        leave = _exits(times, own, begin + span, width)
        root = certain(times, own)
        keep = own & (leave >= 0) & (root | (times < begin + 2 * width))
        head = pdf[keys].iloc[[0] * int(keep.sum())].reset_index(drop=True)
        return head.assign(_t=times[keep], _exit=leave[keep], _root=root[keep])

    cuts = cut_lineage(
        spread.groupBy(*keys, "_chunk").applyInPandas(short_cuts, f"{key_ddl}, _t bigint, _exit bigint, _root boolean")
    )
    step = cuts.filter("NOT _root").select(*keys, "_t", "_exit")
    reached = cuts.filter("_root").select(*keys, F.col("_exit").alias("_t")).distinct()
    fresh = reached.join(step, [*keys, "_t"], "left_semi")
    while not fresh.isEmpty():
        ahead = reached.join(step, [*keys, "_t"]).select(*keys, F.col("_exit").alias("_t"))
        grown = cut_lineage(reached.unionByName(ahead).distinct())
        onward = step.select(*keys, F.col("_t").alias("_exit"), F.col("_exit").alias("_far"))
        step = cut_lineage(step.join(onward, [*keys, "_exit"]).select(*keys, "_t", F.col("_far").alias("_exit")))
        reached = grown
        fresh = step.join(reached, [*keys, "_t"], "left_semi")

    entries = reached.select(*keys, "_t", F.floor(F.col("_t") / span).alias("_chunk"), F.lit(_ENTRY).alias("_kind"))
    walked = spread.filter(F.col("_kind") != _AFTER).unionByName(entries)

    def list_starts(pdf: pd.DataFrame) -> pd.DataFrame:
        entry_rows = pdf.loc[pdf["_kind"] == _ENTRY, "_t"]
        entry = int(entry_rows.min()) if len(entry_rows) else None
        times, kinds = ordered(pdf[pdf["_kind"] != _ENTRY])
        own = kinds == _OWN
        sure = certain(times, own) if len(times) else own
        if entry is not None and sure.any():
            entry = min(entry, int(times[sure][0]))
        found = _starts(times[own], sure[own], entry, width)
        head = pdf[keys].iloc[[0] * len(found)].reset_index(drop=True)
        return head.assign(_start=np.array(found, dtype="int64"))

    starts = walked.groupBy(*keys, "_chunk").applyInPandas(list_starts, f"{key_ddl}, _start bigint")
    return starts


def _numbered(calls: DataFrame, starts: DataFrame, keys: list[str], limit: int, width: int, span: int) -> DataFrame:
    """Give every call the last start at or before it, and its place in that window."""
    timed = calls.withColumn("_t", F.unix_micros("ts")).withColumn("_chunk", F.floor(F.col("_t") / span))
    starts = starts.withColumn("_chunk", F.floor(F.col("_start") / span))
    reach = F.when(F.col("_start") + width > (F.col("_chunk") + 1) * span, F.array(F.col("_chunk"), F.col("_chunk") + 1))
    openings = starts.withColumn("_chunk", F.explode(F.coalesce(reach, F.array("_chunk"))))
    marked = timed.withColumn("_start", F.lit(None).cast("bigint")).withColumn("_call", F.lit(1)).unionByName(
        openings.withColumn("_t", F.col("_start")).withColumn("_call", F.lit(0)), allowMissingColumns=True
    )
    latest = (
        Window.partitionBy(*keys, "_chunk").orderBy("_t", "_call").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = marked.withColumn("_window", F.max("_start").over(latest)).filter("_call = 1")
    inside = Window.partitionBy(*keys, "_window").orderBy("_t", "id")
    return (
        placed.withColumn("call_in_window", F.row_number().over(inside))
        .withColumn("allowed", F.col("call_in_window") <= limit)
        .withColumn("window_start", F.timestamp_micros("_window"))
        .drop("_t", "_chunk", "_start", "_call", "_window")
    )


def sliding_limit(calls: DataFrame, keys: list[str], limit: int, window_seconds: int) -> DataFrame:
    """Sliding log: a call is over the limit when the window that ends at it holds more than ``limit`` calls."""
    from ledgerlight.functions.frames import trailing_sums

    width = window_seconds * 1_000_000
    counted = trailing_sums(calls, keys, "ts", {"in_window": (F.lit(1), -width, 0)})
    return counted.withColumn("allowed", F.col("in_window") <= limit)
