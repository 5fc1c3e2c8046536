"""Embedding near-dedup by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import components
from ledgerlight.session import cut_lineage

WIDTH = 2.0
TILE = 2048
SMALL = 12
NAMELESS = 1 << 62


def meets(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised Gaussian projection puts two points at this distance into one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def plan(vectors: int, cosine: float, recall: float, width: float = WIDTH) -> tuple[int, int]:
    """(projections a table, tables): unrelated vectors share a bucket about once a table, pairs at the threshold are found with ``recall``."""
    near, far = meets(math.sqrt(2 - 2 * cosine), width), meets(math.sqrt(2.0), width)
    projections = max(4, math.ceil(math.log(max(2, vectors)) / -math.log(far)))
    return projections, math.ceil(math.log(1 - recall) / math.log1p(-(near**projections)))


def hasher(dimensions: int, projections: int, tables: int, width: float = WIDTH, seed: int = 7):
    """A function from unit vectors to one 64-bit bucket key per table."""
    rng = np.random.default_rng(seed)
    lines = rng.standard_normal((dimensions, tables * projections))
    shift = rng.uniform(0, width, tables * projections)
    odd = rng.integers(1, 1 << 62, tables * projections, dtype=np.int64) * 2 + 1

    def keys(unit: np.ndarray) -> np.ndarray:
        cells = np.floor((unit @ lines + shift) / width).astype(np.int64)
        mixed = (cells * odd).reshape(len(unit), tables, projections).sum(axis=2, dtype=np.int64).view(np.uint64)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)

    return keys


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of length 1; the exponent of the largest component goes first, so no square overflows or vanishes."""
    vectors = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    left = np.ones(len(linked), dtype=bool)
    edges = []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            node = queue.pop()
            for other in np.flatnonzero(linked[node] & left):
                left[other] = False
                edges.append((node, int(other)))
                queue.append(int(other))
    return edges


def compare(ids: np.ndarray, weight: np.ndarray, unit: np.ndarray, keys: np.ndarray, side: np.ndarray, at: int, cosine: float, both: bool):
    """Links inside one tile: (id, weighted number of links) and the edges of a spanning forest.

    A pair counts in table ``at`` only if it shares no bucket of an earlier table. Where ``both`` is set the tile
    is two chunks of a bucket and only pairs across the chunks count.
    """
    linked = unit @ unit.T >= cosine
    np.fill_diagonal(linked, False)
    if both:
        linked &= side[:, None] != side[None, :]
    for t in range(at):
        if not linked.any():
            break
        linked &= keys[:, None, t] != keys[None, :, t]
    return linked @ weight, [(ids[i], ids[j]) for i, j in forest(linked)]


def near_vectors(
    vectors: DataFrame, cosine: float = 0.95, recall: float = 0.99, projections: int | None = None, tables: int | None = None, tile: int = TILE
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    n_links counts the other vectors at a cosine of ``cosine`` or more, in double precision, that were found;
    component_id is the least vec_id reachable by such links, and kept marks the vectors that are their own component's least.
    Equal vectors are one class and linked without hashing. Classes are hashed into ``tables`` tables; every bucket
    is compared in numpy, in tiles of two chunks where it has over ``tile`` classes. Nothing is left out: the only
    loss is a pair that meets in no table, at most 1 - ``recall`` of those right at the threshold and far fewer of closer ones.

    Vectors that are null, empty, zero or hold null or non-finite components have no links and are kept. Vectors of
    different lengths never link. Components are kept as they are if they are floats, else taken as doubles. A null
    vec_id takes part in links: it is never kept, and its component_id is null only if no id is reachable. Ids of
    2^62 and more are reserved for the nodes of vectors without one. Rows repeated in vec_id and vector link with each other like any equal
    vectors, and different vectors under one vec_id count as one node.
    """
    kind = "float32" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "float64"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>" if kind == "float32" else "array<double>").alias("v"))
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(sound, F.col("v")))
    class_of = F.min("vec_id").alias("id")
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(class_of, F.count("*").alias("n"))
    classes = cut_lineage(classes.withColumn("id", F.coalesce("id", F.monotonically_increasing_id() + NAMELESS)))
    total = classes.count()
    sizes = [r["d"] for r in classes.select(F.size("v").alias("d")).distinct().collect()]  # lengths of vectors: a model has one
    counts, edges = None, None
    for dimensions in sizes:
        k, t = plan(total, cosine, recall)
        hits = tiles(classes.where(F.size("v") == dimensions), dimensions, projections or k, tables or t, cosine, tile, kind)
        counts = hits.where("other IS NULL") if counts is None else counts.union(hits.where("other IS NULL"))
        edges = hits.where("other IS NOT NULL") if edges is None else edges.union(hits.where("other IS NOT NULL"))
    if counts is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = counts.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(edges.select("id", "other"), "id", "other")
    found = classes.join(links, "id", "left").join(groups, classes["id"] == groups["node"], "left").select(
        F.col("v").alias("class"), "id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    # rows meet their class by the vector itself; most vectors are alone, and a class is read once
    out = rows.join(found, rows["v"] == found["class"], "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).when(F.col("component_id") < NAMELESS, F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def tiles(classes: DataFrame, dimensions: int, projections: int, tables: int, cosine: float, tile: int, kind: str = "float32") -> DataFrame:
    """(id, links, other): link counts where other is null, else edges, from all buckets with two classes or more."""
    hashes = hasher(dimensions, projections, tables)

    def hashed(batches):
        for pdf in batches:
            raw = [np.asarray(v, dtype=kind).tobytes() for v in pdf["v"]]
            if raw:
                yield pd.DataFrame({"id": pdf["id"], "n": pdf["n"], "raw": raw, "keys": list(hashes(unit_rows(raw, kind)))})

    known = cut_lineage(classes.select("id", "n", "v").mapInPandas(hashed, "id long, n long, raw binary, keys array<long>"))
    spots = known.select("id", F.posexplode("keys").alias("t", "key"))
    shared = spots.groupBy("t", "key").agg(F.count("*").alias("m")).where("m > 1")
    chunks = F.ceil(F.col("m") / tile).cast("int")
    placed = spots.join(shared, ["t", "key"]).withColumn("parts", chunks).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # a class meets every chunk of its bucket once: tile (i, j) holds chunks i and j, i <= j
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.withColumns({"i": F.least("part", "with"), "j": F.greatest("part", "with")})
    full = placed.join(known, "id").select("t", "key", "i", "j", "part", "id", "n", "raw", "keys")
    rows = spots.count() // 20_000 + 1
    full = full.withColumn("box", F.pmod(F.xxhash64("t", "key", "i", "j"), F.lit(rows)))

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        name, weight, part = pdf["id"].to_numpy(), pdf["n"].to_numpy(), pdf["part"].to_numpy()
        unit, all_keys = unit_rows(list(pdf["raw"]), kind), np.stack(pdf["keys"].to_numpy())
        by_size: dict[int, list] = {}
        ids, count, other = [], [], []
        for (t, _, i, j), at in pdf.groupby(["t", "key", "i", "j"], sort=False).indices.items():
            if 2 <= len(at) <= SMALL:
                by_size.setdefault(len(at), []).append((int(t), i != j, at))
            elif len(at) > SMALL:
                number, pairs = compare(name[at], weight[at], unit[at], all_keys[at], part[at], int(t), cosine, i != j)
                hit = number > 0
                ids += name[at][hit].tolist() + [a for a, _ in pairs]
                count += number[hit].tolist() + [0] * len(pairs)
                other += [None] * int(hit.sum()) + [b for _, b in pairs]
        for size, groups in by_size.items():  # small buckets: all their pairs at once
            members, across = np.array([at for *_, at in groups]), np.array([x for _, x, _ in groups])
            table = np.array([t for t, *_ in groups])
            for x, y in zip(*np.triu_indices(size, 1)):
                a, b = members[:, x], members[:, y]
                near = (np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine) & (~across | (part[a] != part[b]))
                a, b, t = a[near], b[near], table[near]
                first = (all_keys[a] == all_keys[b]).argmax(axis=1) == t
                a, b = a[first], b[first]
                ids += name[a].tolist() + name[b].tolist() + name[a].tolist()
                count += weight[b].tolist() + weight[a].tolist() + [0] * len(a)
                other += [None] * (2 * len(a)) + name[b].tolist()
        return pd.DataFrame({"id": pd.array(ids, dtype="Int64"), "links": pd.array(count, dtype="Int64"), "other": pd.array(other, dtype="Int64")})

    return cut_lineage(full.groupBy("box").applyInPandas(links, "id long, links long, other long"))
