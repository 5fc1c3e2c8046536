"""Merkle manifest of a dataset: digests go up from the leaves, proofs come down, both in the order of node labels."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import running
from ledgerlight.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A task's queue holds the messages of 2**HEIGHT nodes; what goes further up or down waits in a table.
HEIGHT = 10
#: Rows that one range of leaves holds, about.
RANGE = 500_000


def leaf(fields: dict[str, Column]) -> Column:
    """sha256 over the fields one after another: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    parts = []
    for column in fields.values():
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, tree, leaf, changed): ``tree`` is the lang as a key that sorts null first; ``changed`` the leaf of the tampered row.

    Tampering adds 1 to n_chars where ``tampered`` holds; elsewhere ``changed`` is null.
    """
    fields = {n: F.col(f"`{n}`") for n in FIELDS}
    more = F.col("n_chars").cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)")
    changed = F.when(tampered, leaf(fields | {"n_chars": more})) if tampered is not None else F.lit(None).cast("string")
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0")).alias("tree"), leaf(fields).alias("leaf"), changed.alias("changed"))


def placed(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Adds ``at``, the place from 0 of each row in its group by ``order``, and ``depth``, the number of levels above the group's nodes.

    Rows are dealt out by ranges of (group, order, turn), so neither a hot group nor a value that very many rows share is one
    task; a task numbers its sorted rows, and the rows of the ranges before are added from one count per range and group.
    """
    rows = cut_lineage(rows.withColumn("turn", F.monotonically_increasing_id()))
    order = [F.col(group), *order, F.col("turn")]
    ranged = rows.repartitionByRange(rows.count() // RANGE + 1, *order).sortWithinPartitions(*order)
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, part long, place long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, place = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for name in batch.column(group).to_pylist():
                place = place + 1 if name == before else 0
                before = name
                places.append(place)
            columns = [*batch.columns, pa.array([part] * batch.num_rows, pa.int64()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "place"])

    ranged = cut_lineage(ranged.mapInArrow(number, schema))
    counts = ranged.groupBy(group, "part").agg(F.count("*").alias("n"))
    starts = running(counts.withColumn("block", F.floor(F.col("part") / 1000)), [group], "block", ["part"], {"before": "n"})
    total = counts.groupBy(group).agg(F.sum("n").alias("n"))
    levels = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0).cast("int")
    starts = starts.drop("n").join(total.select(group, levels.alias("depth")), group).select(group, "part", "before", "depth")
    return ranged.join(starts, [group, "part"]).withColumn("at", F.col("before") + F.col("place")).drop("part", "place", "before", "turn")


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sweep(first: int, digests: list[str], height: int) -> list[list[str]]:
    """The levels of digests over one block of neighbours whose first place is ``first``, ``height`` levels up.

    Time-forward: the queue gives out messages (label, digest) in the order of labels (level, place); all that were sent
    to one run are taken together, and their digest is sent to the label of the parent, which comes later.
    """
    queue = [(0, first + i, d) for i, d in enumerate(digests)]
    heapify(queue)
    levels: list[list[str]] = [[] for _ in range(height + 1)]
    while queue:
        level, at, found = heappop(queue)
        levels[level].append(found)
        if level == height:
            continue
        run = [found]
        while queue and queue[0][0] == level and queue[0][1] >> 1 == at >> 1:
            run.append(heappop(queue)[2])
            levels[level].append(run[-1])
        heappush(queue, (level + 1, at >> 1, digest(run)))
    return levels


#: Takes the sides out of a proof.
SIDES = {ord(c): None for c in "<>."}


def path(levels: list[list[str]], first: int, at: int) -> str:
    """The siblings of the node at place ``at``, from its level up: ``<`` before one on the left, ``>`` before one on the right, ``.`` for none."""
    steps = []
    for level, row in enumerate(levels[:-1]):
        here, start = at >> level, first >> level
        other = (here ^ 1) - start
        steps.append(("<" if here & 1 else ">") + row[other] if 0 <= other < len(row) else ".")
    return "".join(steps)


def fold(found: str, proof: str) -> str:
    """The root that a digest leads to along the siblings of ``path``."""
    at = 0
    while at < len(proof):
        side = proof[at]
        if side == ".":
            found, at = digest([found]), at + 1
        else:
            other, at = proof[at + 1 : at + 65], at + 65
            found = digest([other, found] if side == "<" else [found, other])
    return found


def by_block(rows: DataFrame, height: int, tops: DataFrame | None = None) -> DataFrame:
    """Blocks of 2**height neighbours of a tree, each together and in order, led by the message of its top if there are ``tops``."""
    rows = rows.withColumn("block", F.shiftright("at", height))
    if tops is not None:
        rows = rows.unionByName(tops.withColumnRenamed("at", "block"), allowMissingColumns=True)
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", F.col("at").asc_nulls_first())


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one block after another, from batches in order."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["tree"], row["block"]) != (held[0]["tree"], held[0]["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def upward(nodes: DataFrame, height: int) -> DataFrame:
    """One round up: (tree, at, digest, depth) of the tops of all blocks; ``depth`` is how many levels are left above a node."""

    def run(batches):
        for rows in blocks(batches):
            tree, first, depth = rows[0]["tree"], rows[0]["at"], rows[0]["depth"]
            up = min(height, depth)
            top = sweep(first, [r["digest"] for r in rows], up)[-1][0]
            yield pa.RecordBatch.from_arrays([
                pa.array([tree]), pa.array([first >> up], pa.int64()), pa.array([top]), pa.array([depth - up], pa.int32()),
            ], names=["tree", "at", "digest", "depth"])

    return by_block(nodes.select("tree", "at", "digest", "depth"), height).mapInArrow(run, "tree string, at long, digest string, depth int")


def downward(nodes: DataFrame, tops: DataFrame, height: int) -> DataFrame:
    """One round down: (tree, at, proof) of the nodes, from the messages (tree, at, proof) of the tops of their blocks."""

    def run(batches):
        for message, *rows in blocks(batches):
            first = rows[0]["at"]
            levels = sweep(first, [r["digest"] for r in rows], min(height, rows[0]["depth"]))
            yield pa.RecordBatch.from_arrays([
                pa.array([r["tree"] for r in rows]), pa.array([r["at"] for r in rows], pa.int64()),
                pa.array([path(levels, first, r["at"]) + message["proof"] for r in rows]),
            ], names=["tree", "at", "proof"])

    nodes = nodes.select("tree", "at", "digest", "depth")
    return by_block(nodes, height, tops.select("tree", "at", "proof")).mapInArrow(run, "tree string, at long, proof string")


def climb(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The tables of nodes after each round up, the given ones first, until every tree is one node."""
    rounds = max(1, -(-(nodes.agg(F.max("depth").alias("d")).first()["d"] or 0) // height))
    tables = [nodes]
    for _ in range(rounds):
        tables.append(cut_lineage(upward(tables[-1], height)))
    return tables


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, proof, folded_root and verified of every row.

    Each row's digest is a leaf of its lang's tree, in order of doc_id; the trees' tops, null lang first and then by
    UTF-8 bytes, are the leaves of a tree over all. A run of two neighbours becomes one node, a last single one too. ``proof`` holds the
    siblings from the leaf to the root with their sides, ``folded_root`` is what they make of the leaf after
    tampering (n_chars plus 1 where ``tampered`` holds and n_chars isn't null), ``verified`` whether this is the root.

    Rows of a block of 2**height leaves are together in a task, and so are the tops of as many blocks in the next round; no
    task holds more of a tree. The way down takes the blocks in reverse: one message with the rest of the proof per block. Rows
    with a null doc_id come first in their tree; rows equal in all fields are leaves of their own, in any order.
    A table without rows gives none. Columns of other names are not read.
    """
    made = leaves(docs, tampered)
    first = cut_lineage(placed(made, "tree", [F.col("doc_id").asc_nulls_first(), F.col("leaf")]).withColumnRenamed("leaf", "digest"))
    trees = climb(first, height)
    subroots = trees[-1].select(F.col("tree").alias("name"), "digest").withColumn("tree", F.lit("all"))
    over = climb(cut_lineage(placed(subroots, "tree", [F.col("name")])), height)
    root = over[-1].select("digest").first()  # one row, or none

    proofs = over[-1].select("tree", "at", F.lit("").alias("proof"))
    for nodes in over[-2::-1]:
        proofs = cut_lineage(downward(nodes, proofs, height))
    tops = over[0].join(proofs, ["tree", "at"]).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("at"), "proof", F.col("digest").alias("subroot"))
    tops = cut_lineage(tops.withColumn("root", F.lit(root["digest"] if root else None).cast("string")))
    proofs = tops.select("tree", "at", "proof")
    for nodes in trees[-2:0:-1]:
        proofs = cut_lineage(downward(nodes, proofs, height))
    messages = proofs.join(tops.select("tree", "subroot", "root"), "tree").select("tree", "at", "proof", "subroot", "root")

    def run(batches):
        for message, *rows in blocks(batches):
            at = rows[0]["at"]
            levels = sweep(at, [r["digest"] for r in rows], min(height, rows[0]["depth"]))
            found = [path(levels, at, r["at"]) + message["proof"] for r in rows]
            folded = [fold(r["changed"] or r["digest"], p) for r, p in zip(rows, found)]
            yield pa.RecordBatch.from_arrays([
                pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([r["digest"] for r in rows]),
                pa.array([message["subroot"]] * len(rows)), pa.array([message["root"]] * len(rows)),
                pa.array([digest([p.translate(SIDES)]) for p in found]), pa.array(found),
                pa.array(folded), pa.array([f == message["root"] for f in folded]),
            ], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "proof", "folded_root", "verified"])

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, proof string, folded_root string, verified boolean"
    return by_block(first.withColumn("doc_id", F.col("doc_id").cast("long")), height, messages).mapInArrow(run, schema)
