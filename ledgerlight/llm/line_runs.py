"""Line dedup: repeated line runs found by a suffix array over line-id sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import hex_bucket, running, text_mark, word_count
from ledgerlight.session import cut_lineage

DOC = ["doc_id", "mark"]


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, pos, words, rank) of every line that stands more than once among ``docs``.

    ``rank`` is the number of positions whose line has a smaller digest: the order of suffixes by their first line.
    """
    lines = docs.select("doc_id", text_mark(F.col("text")).alias("mark"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select(*DOC, "pos", F.md5("line").alias("digest"), word_count(F.col("line")).cast("int").alias("words"))
    counted = lines.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    buckets = 1024
    ranked = running(
        counted.withColumn("all", F.lit(0)).withColumn("part", hex_bucket(F.col("digest"), buckets)), ["all"], "part", ["digest"], {"rank": "n"}
    )
    return lines.join(ranked.select("digest", "rank"), "digest").select(*DOC, "pos", "words", "rank")


def run_windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, mark, pos, length): shortest stretches of repeated lines with at least ``min_words`` words.

    From every line forward and from every line backward, within unbroken stretches of repeated lines. A run of repeated
    lines with enough words is the union of such windows, so nothing longer has to be compared.
    """
    in_doc = Window.partitionBy(*DOC).orderBy("pos")
    upto = in_doc.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.dropDuplicates([*DOC, "pos"])  # repeated rows
    rows = rows.withColumn("opens", (F.coalesce(F.lag("pos").over(in_doc), F.lit(-2)) + 1 < F.col("pos")).cast("int"))
    rows = rows.withColumns({"stretch": F.sum("opens").over(upto), "upto": F.sum(F.col("words").cast("long")).over(upto)})
    rows = rows.withColumn("before", F.col("upto") - F.col("words"))
    stretch = Window.partitionBy(*DOC, "stretch")
    rows = rows.withColumns({"low": F.min("before").over(stretch), "high": F.max("upto").over(stretch), "first": F.min("pos").over(stretch), "last": F.max("pos").over(stretch)})
    rows = rows.where(F.col("high") - F.col("low") >= min_words)
    # the next start with enough words in between, seen from the end so that the frame only grows
    ahead = stretch.orderBy(F.col("before").desc()).rangeBetween(Window.unboundedPreceding, -min_words)
    behind = stretch.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words)
    rows = rows.withColumns({
        "stop": F.coalesce(F.min("pos").over(ahead), F.when(F.col("high") - F.col("before") >= min_words, F.col("last") + 1)),
        "start": F.coalesce(F.max("pos").over(behind) + 1, F.when(F.col("upto") - F.col("low") >= min_words, F.col("first"))),
    })
    span = lambda begin, length: F.struct(begin.cast("int").alias("pos"), length.cast("int").alias("length"))
    both = F.array(span(F.col("pos"), F.col("stop") - F.col("pos")), span(F.col("start"), F.col("pos") + 1 - F.col("start")))
    return rows.select(*DOC, "rank", F.col("pos").alias("at"), F.explode(both).alias("w")).select(*DOC, "rank", "at", "w.pos", "w.length")


def double(ranks: DataFrame, span: int, positions: int) -> DataFrame:
    """Ranks by the first 2 * span lines from ranks by the first span lines; suffixes that became unique are left out.

    A new rank is the old one plus the number of suffixes of the old group whose second half sorts
    earlier. Pairs are counted before they are ordered, in two levels, so that a line with very many followers is spread out.
    """
    there = Window.partitionBy(*DOC).orderBy("pos").rangeBetween(span, span)
    halves = ranks.withColumn("then", F.max("rank").over(there)).where("then IS NOT NULL")
    pairs = halves.groupBy("rank", "then").agg(F.count("*").alias("n")).where("n > 1")
    cell = F.floor(F.col("then") / max(1, positions // 256))
    ordered = running(pairs.withColumn("cell", cell), ["rank"], "cell", ["then"], {"ahead": "n"})
    named = ordered.select("rank", "then", (F.col("rank") + F.col("ahead")).alias("renewed"))
    return halves.join(named, ["rank", "then"]).select(*DOC, "pos", F.col("renewed").alias("rank"))


def with_rank(windows: DataFrame, table: DataFrame, at: str, name: str) -> DataFrame:
    """Adds the rank of the suffix at position ``at`` of the window's level; windows without one are unique and go."""
    ranks = table.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("pos").alias("p"), F.col("level").alias("l"), F.col("rank").alias(name))
    here = (F.col("mark") == F.col("m")) & (F.col(at) == F.col("p")) & (F.col("level") == F.col("l")) & F.col("doc_id").eqNullSafe(F.col("d"))
    return windows.join(ranks, here).drop("d", "m", "p", "l")


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, mark, start, stop): the lines of each text that repeat an earlier run, as maximal ranges, stop exclusive.

    A run of lines repeats if the same lines stand in the same order at an earlier place, ordered by
    doc_id (null last), the text's hash and line number, and its lines hold at least ``min_words`` words together.
    Suffixes are sorted by prefix doubling until their order covers the longest window needed; two
    overlapping spans of a power of two lines decide a window. Windows of equal content are an interval of the suffix array with a
    longest common prefix of at least their length; all but its first place are repeats.
    """
    windows = run_windows(repeated_lines(docs), min_words)
    windows = cut_lineage(windows)
    size = windows.agg(F.max("length").alias("longest"), F.count("*").alias("n"), F.max("rank").alias("top")).first()
    if not size["longest"]:
        return windows.select(*DOC, F.col("pos").alias("start"), F.col("pos").alias("stop")).limit(0)
    ranks = windows.select(*DOC, F.col("at").alias("pos"), "rank").dropDuplicates([*DOC, "pos"])
    levels, span = [ranks.withColumn("level", F.lit(0))], 1
    while 2 * span <= size["longest"]:
        ranks = cut_lineage(double(ranks, span, size["top"] + 1))
        levels.append(ranks.withColumn("level", F.lit(len(levels))))
        span *= 2
    table = levels[0].unionByName(levels[1]) if len(levels) > 1 else levels[0]
    for level in levels[2:]:
        table = table.unionByName(level)
    wanted = windows.where("length IS NOT NULL AND length > 0").select(*DOC, "pos", "length").distinct()
    wanted = wanted.withColumn("level", F.expr("cast(floor(log2(length)) as int)"))
    wanted = wanted.withColumn("second", F.expr("pos + length - cast(shiftleft(1, level) as int)"))
    known = with_rank(with_rank(wanted, table, "pos", "head"), table, "second", "tail")
    place = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id"), F.col("mark"), F.col("pos"))
    known = cut_lineage(known)
    interval = ["length", "level", "head", "tail"]
    firsts = known.groupBy(*interval).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = known.join(firsts, interval).where(place > F.col("first")).select(*DOC, F.col("pos").alias("start"), (F.col("pos") + F.col("length")).alias("stop"))
    line = Window.partitionBy(*DOC).orderBy("start", "stop")
    reach = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("opens", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int"))
    later = later.withColumn("run", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return later.groupBy(*DOC, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def drop_repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(row, text, n_lines, n_dropped): each row of ``docs`` as a struct, and its text without the repeated runs.

    A text whose lines all go becomes empty. Null and empty texts stay as they are. Rows equal in doc_id and text are
    one document and are cut alike. Columns of any name may be in ``docs``; only doc_id and text are read.
    """
    runs = repeated_runs(docs.select("doc_id", "text").where("text IS NOT NULL"), min_words)
    spans = runs.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"), F.sum(F.col("stop") - F.col("start")).alias("gone"))
    # a mask with one byte per line up to the last cut: 1 where the line goes
    gaps = F.transform("spans", lambda s, i: F.concat(
        F.repeat(F.lit("0"), s["start"] - F.when(i > 0, F.element_at("spans", F.greatest(i, F.lit(1)))["stop"]).otherwise(0)),
        F.repeat(F.lit("1"), s["stop"] - s["start"]),
    ))
    spans = spans.select(F.col("doc_id").alias("id"), "mark", F.encode(F.array_join(gaps, ""), "utf-8").alias("mask"), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), text_mark(F.col("text")).alias("key"))
    joined = rows.join(spans, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("mark")), "left")
    lines = F.split("row.text", "\n")
    kept = F.array_join(F.filter(lines, lambda line, i: F.coalesce(F.substring(F.col("mask"), i + 1, F.lit(1)) != F.lit(b"1"), F.lit(True))), "\n")
    text = F.when(F.col("mask").isNotNull(), kept).otherwise(F.col("row.text"))
    return joined.select(
        "row", text.alias("text"), F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce("gone", F.lit(0)).cast("long").alias("n_dropped"),
    )
