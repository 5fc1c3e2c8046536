"""Document fingerprints by SimHash, with permuted block tables for the search."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import GAP, order_bounds, order_bucket

LANES = 0x0000000100000001  # bits i and i + 32 of a term hash are counted in the halves of one long


def block_masks(blocks: int) -> list[int]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, print long): the SimHash of each row's text; rows equal in the keys must have equal texts.

    Terms are pairs of neighbouring words, and the last word alone; a term votes as often as it stands, with a
    weight of 1 to 4 that grows with its length, since long words are rarer. Bit b is set where more
    weight has it set than not. A text without words has the print 0. Votes of two bits share a
    long, so a row of a document carries 32 sums, formed before anything is shuffled.
    """
    words = F.split(F.col(text), GAP)
    terms = rows.select(*keys, words.alias("words")).select(*keys, F.explode(F.arrays_zip(F.col("words").alias("one"), F.slice("words", 2, 1 << 30).alias("two"))).alias("term"))
    chars = F.length("term.one") + F.coalesce(F.length("term.two"), F.lit(0))
    weighed = terms.select(
        *keys, F.xxhash64("term.one", "term.two").alias("hash"),
        F.when(chars == 0, 0).otherwise(F.least(F.lit(4), 1 + F.expr("(length(term.one) + coalesce(length(term.two), 0)) div 6"))).cast("long").alias("weight"),
    )
    votes = weighed.groupBy(*keys).agg(
        F.sum("weight").alias("all"),
        *[F.sum(F.shiftrightunsigned("hash", i).bitwiseAND(F.lit(LANES)) * F.col("weight")).alias(f"v{i}") for i in range(32)],
    )
    parts: list[Column] = []
    for i in range(32):
        parts.append(F.when(F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("all"), F.lit(1 << i)).otherwise(F.lit(0)))
        parts.append(F.when(F.shiftrightunsigned(f"v{i}", 32) * 2 > F.col("all"), F.lit(signed(1 << (i + 32)))).otherwise(F.lit(0)))
    print_ = parts[0]
    for p in parts[1:]:
        print_ = print_.bitwiseOR(p)
    return votes.select(*keys, print_.cast("long").alias("print"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def near_prints(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(print, near): all pairs of a query print and a print within ``radius`` bits of it, each once.

    With ``blocks`` blocks, at least blocks - radius of them agree in such a pair. There is a
    table for each choice of so many blocks, keyed by their bits, as if the blocks were permuted to the front;
    a pair is taken from the first table in which it agrees, so nothing has to be made distinct.
    Both inputs are distinct longs in a column ``print``.
    """
    masks = block_masks(blocks)
    chosen = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    keyed = lambda df: df.select(
        "print", F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(signed(m))) for m in chosen])).alias("t", "bits")
    )
    left, right = keyed(queries), keyed(prints.select(F.col("print").alias("print"))).withColumnRenamed("print", "near")
    apart = F.col("print").bitwiseXOR(F.col("near"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(signed(m))) == 0, F.lit(t)) for t, m in enumerate(chosen)])
    return left.join(right, ["t", "bits"]).where((F.bit_count(apart) <= radius) & (F.col("t") == first)).select("print", "near")


def edited_prints(docs: DataFrame, rows_per_bucket: int = 1000, most_buckets: int = 10_000) -> DataFrame:
    """One row per document with the print of its text, of its edited text and of the next document's.

    Columns: doc_id, n_chars, edited_sha256, print, edited_print, next_print. In the edited text the last quarter of the code
    points (rounded down) is replaced by as many from the start of the next document in (doc_id, text)
    order, or all it has; the first document follows the last. A null text is empty, null doc_ids
    come last, repeated rows follow one another. A single document follows itself.

    Documents are dealt to ranges of doc_id by quantiles; the first document of each range
    goes to the range before it as well, so ``lead`` inside a range sees every neighbour.
    Texts are shuffled once and prints are formed where they land.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    part = order_bucket(F.col("doc_id"), order_bounds(docs.select("doc_id"), "doc_id", rows_per_bucket, most_buckets))
    rows = rows.withColumn("part", part)
    # the first document of each range: the least text among those of the least doc_id; a row per range, so it is broadcast
    least = rows.groupBy("part").agg(F.min("doc_id").alias("least"))
    line = Window.orderBy("part")
    whole = Window.partitionBy()
    least = least.withColumn("before", F.coalesce(F.lag("part").over(line), F.max("part").over(whole)))
    heads = rows.join(F.broadcast(least.withColumnRenamed("part", "home")), (F.col("part") == F.col("home")) & F.col("doc_id").eqNullSafe(F.col("least")))
    heads = heads.groupBy(F.col("before").alias("part"), "doc_id").agg(F.min("text").alias("text"))
    both = rows.select("doc_id", "text", "part", F.lit(0).alias("extra")).union(heads.select("doc_id", "text", "part", F.lit(1)))
    order = Window.partitionBy("part").orderBy("extra", F.col("doc_id").asc_nulls_last(), "text")
    follow = both.withColumns({"place": F.row_number().over(order), "after": F.lead("text").over(order)})
    n = F.length("text")
    cut = F.expr("length(text) div 4")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("after", F.lit(1), cut))
    follow = follow.select("part", "place", "extra", "doc_id", n.cast("long").alias("n_chars"), F.explode(
        F.when(F.col("extra") == 1, F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("text"))))
        .otherwise(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("text")), F.struct(F.lit(1).alias("v"), edited.alias("text"))))
    ).alias("version"))
    keys = ["part", "place", "extra", "doc_id", "n_chars", "v", "edited_sha256"]
    told = follow.select(
        "part", "place", "extra", "doc_id", "n_chars", "version.v", F.when(F.col("version.v") == 1, F.sha2(F.col("version.text"), 256)).alias("edited_sha256"), "version.text"
    )
    made = fingerprints(told, keys)
    pairs = made.groupBy("part", "place", "extra", "doc_id", "n_chars").agg(
        F.max("edited_sha256").alias("edited_sha256"), F.max(F.when(F.col("v") == 0, F.col("print"))).alias("print"), F.max(F.when(F.col("v") == 1, F.col("print"))).alias("edited_print")
    )
    after = Window.partitionBy("part").orderBy("place")
    return pairs.withColumn("next_print", F.lead("print").over(after)).where("extra = 0").drop("part", "place", "extra")
