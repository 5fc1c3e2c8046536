"""N-gram Jaccard join: size-banded tiles of hashed bitmaps before exact intersections."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import components, text_mark
from ledgerlight.session import cut_lineage, remove_tables

WORDS = 5
PERCENT = 80
BANDS, ROWS = 8, 4
BITS = 1024
#: Shingles sorted in one go to find those that are frequent; hints only, the result doesn't depend on them.
CHUNK = 1_000_000
#: At most so many frequent shingles (8 bytes each) are sent to the tasks; the others are ordered by hash.
HEAVY = 1 << 18
TILE = 1024
#: Rows that a task compares in one go, on average.
BOX = 50_000
#: Shingles of the sets in a slice of a tile, and in a task, on average.
SLICE = 4_000_000


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's 5-word shingles; of all words as one where there are fewer.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` parts at exactly blank, tab, line feed, vertical tab,
    form feed and carriage return, as the definition of a word asks.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashed = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
    if len(hashed) < WORDS:
        hashed = np.concatenate([hashed, np.full(WORDS - len(hashed), len(hashed), dtype=np.uint64)])
    n = len(hashed) - WORDS + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(WORDS):
        mixed = (mixed + hashed[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def band_keys(found: np.ndarray) -> list[int]:
    """Keys of MinHash bands: the least hash in each of 32 equal ranges, empty ranges take the next one's, four a band."""
    cuts = np.searchsorted(found, np.arange(BANDS * ROWS, dtype=np.uint64) << np.uint64(59))
    least = found[cuts % len(found)].reshape(BANDS, ROWS)
    keys = np.zeros(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = (keys ^ least[:, r]) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64).tolist()


def node_of(found: np.ndarray) -> int | None:
    """A 64-bit digest names a set; an empty one has none."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "big", signed=True) if len(found) else None


def bitmap(found: np.ndarray) -> bytes:
    """A bitmap of a power of two of bits, four times the shingles or more; its halves laid over each other are that of half the size."""
    size = max(BITS, 1 << (4 * len(found) - 1).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[(found >> np.uint64(20)) % np.uint64(size)] = 1
    return np.packbits(bits).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (along the last axis) as those of ``size`` words."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def slices_of(rows: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches, each with its column ``text`` as Python strings."""
    for batch in rows:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column("text").to_pylist()


def digests(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, mark, n, node, bits, bands), and per frequent shingle of a chunk (token, count) with the others null.

    A chunk of the task's documents gives the shingles that it
    holds twice or more: those of passages that many documents share come out of nearly every chunk.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("bits", pa.binary()), ("bands", pa.list_(pa.int64())), ("token", pa.int64()), ("count", pa.int64())])

    def frequent(parts: list[np.ndarray]) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(parts), return_counts=True)
        token, count = token[count > 1].view(np.int64), count[count > 1]
        none = [pa.nulls(len(token), f.type) for f in list(schema)[:6]]
        return pa.RecordBatch.from_arrays([*none, pa.array(token, pa.int64()), pa.array(count, pa.int64())], schema=schema)

    def run(rows):
        parts, held = [], 0
        for part, texts in slices_of(rows):
            sets = [shingles(t) for t in texts]
            nothing = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("mark"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([node_of(s) for s in sets], pa.int64()), pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([band_keys(s) if len(s) else None for s in sets], pa.list_(pa.int64())), nothing, nothing,
            ], schema=schema)
            for s in sets:
                parts.append(s)
                held += len(s)
                if held >= CHUNK:
                    yield frequent(parts)
                    parts, held = [], 0
        if held:
            yield frequent(parts)

    rows = docs.select("doc_id", text_mark(F.col("text")).alias("mark"), "text")
    return rows.mapInArrow(run, "doc_id long, mark long, n long, node long, bits binary, bands array<long>, token long, count long")


def shared_tokens(docs: DataFrame, heavy: np.ndarray, buckets: int) -> DataFrame:
    """(token, node), some repeated: the shingles of prefixes that several nodes have, as keys of 32 bits and a bucket.

    Two linked sets share one of the first n - ceil(0.8 n) + 1 of their n shingles in an order common to all sets. The order is by
    hash, and the frequent ones (``heavy``, rarest first) come last, so a shared passage isn't looked up where a set
    has anything else. Tasks hand on blocks of keys and nodes by bucket; a bucket is sorted where it arrives and keys of one
    node only go. Frequent shingles are shared anyway, and as many nodes may have one, they pass in blocks of their own. Keys of different
    shingles may meet; that only adds candidates.
    """
    ranks = np.argsort(heavy, kind="stable")
    sent = docs.sparkSession.sparkContext.broadcast((heavy[ranks], ranks))  # bounded by HEAVY

    def prefix(found, known, place):
        n = len(found)
        want = n - -(-PERCENT * n // 100) + 1
        late = np.zeros(want, dtype=bool)
        if len(known):
            spot = np.minimum(np.searchsorted(known, found), len(known) - 1)
            hit = known[spot] == found
            if hit[:want].any():
                order = np.concatenate([np.flatnonzero(~hit), np.flatnonzero(hit)[np.argsort(place[spot[hit]], kind="stable")]])[:want]
                return found[order], hit[order]
        return found[:want], late

    def blocks(tokens, nodes, late):
        tokens, nodes, late = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(late)
        box = ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        box[late] = -1 - nodes[late] % buckets
        order = np.argsort(box, kind="stable")
        tokens, nodes, box = tokens[order], nodes[order], box[order]
        cuts = np.flatnonzero(np.diff(box)) + 1
        starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(box)]])
        keys = tokens.astype(np.uint32)
        return pa.RecordBatch.from_arrays([
            pa.array(box[starts], pa.int64()),
            # frequent shingles keep all their bits
            pa.array([(keys if box[a] >= 0 else tokens)[a:b].tobytes() for a, b in zip(starts, stops)], pa.binary()),
            pa.array([nodes[a:b].tobytes() for a, b in zip(starts, stops)], pa.binary()),
        ], names=["box", "keys", "nodes"])

    def run(rows):
        known, place = sent.value
        tokens, nodes, late, held = [], [], [], 0
        for _, texts in slices_of(rows):
            for text in texts:
                found = shingles(text)
                if len(found):
                    first, frequent = prefix(found, known, place)
                    tokens.append(first)
                    late.append(frequent)
                    nodes.append(np.full(len(first), node_of(found), dtype=np.int64))
                    held += len(first)
            if held >= CHUNK:
                yield blocks(tokens, nodes, late)
                tokens, nodes, late, held = [], [], [], 0
        if held:
            yield blocks(tokens, nodes, late)

    def several(key, table):
        box = key[0].as_py()
        kind = np.uint32 if box >= 0 else np.uint64
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), dtype=kind)
        nodes = np.frombuffer(b"".join(table.column("nodes").to_pylist()), dtype=np.int64)
        if box >= 0:
            order = np.lexsort((nodes, keys))
            keys, nodes = keys[order], nodes[order]
            fresh = np.ones(len(keys), dtype=bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
            keys, nodes = keys[fresh], nodes[fresh]
            same = keys[1:] == keys[:-1]
            shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            keys, nodes = (np.uint64(box) << np.uint64(32)) | keys[shared].astype(np.uint64), nodes[shared]
        return pa.table({"token": pa.array(keys.view(np.int64), pa.int64()), "node": pa.array(nodes, pa.int64())})

    made = docs.mapInArrow(run, "box long, keys binary, nodes binary")
    return made.groupBy("box").applyInArrow(several, "token long, node long")


def whole_sets(docs: DataFrame) -> DataFrame:
    """(node, raw): the sorted hashes as bytes."""

    def run(rows):
        for _, texts in slices_of(rows):
            sets = [shingles(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
            ], names=["node", "raw"])

    return docs.mapInArrow(run, "node long, raw binary")


def overlap_needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least intersection with 100 * intersection >= 80 * union."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def may_link(n: np.ndarray, m: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether sizes and bitmaps allow a link: a bit that only one set has stands for a shingle that only this one has."""
    mine = np.bitwise_count(one & ~two).sum(axis=-1)
    theirs = np.bitwise_count(two & ~one).sum(axis=-1)
    return (PERCENT * np.maximum(n, m) <= 100 * np.minimum(n, m)) & (np.minimum(n - mine, m - theirs) >= overlap_needed(n, m))


def likely_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and bitmaps, folded to the smaller one's size, allow a link."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("bits1"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))

    def allowed(n, m, left, right):
        left, right = np.frombuffer(left, dtype=np.uint64), np.frombuffer(right, dtype=np.uint64)
        size = min(len(left), len(right))
        return bool(may_link(n, m, folded(left, size), folded(right, size)))

    def run(batches):
        for batch in batches:
            n, m = batch.column("n1").to_pylist(), batch.column("n2").to_pylist()
            left, right = batch.column("bits1"), batch.column("bits2")
            keep = [allowed(n[i], m[i], left[i].as_buffer(), right[i].as_buffer()) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = pairs.join(one, "a").join(two.select("b", "n2"), "b").where(F.expr(f"{PERCENT} * greatest(n1, n2) <= 100 * least(n1, n2)"))
    return near.join(two.select("b", "bits2"), "b").mapInArrow(run, "a long, b long")


def linked_pairs(pairs: DataFrame, slim: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets link, by exact intersection of the sorted hashes.

    The rows of one a are brought together in slices by b, each slice led by a's own set, and read as a stream in that order.
    """
    per_hub = pairs.groupBy("a").agg(F.count("*").alias("m"))
    per_hub = per_hub.withColumn("slices", (F.col("m") / 64 + 1).cast("int"))
    tails = pairs.join(per_hub, "a").withColumn("slice", F.pmod(F.xxhash64("b"), "slices").cast("int")).join(slim.withColumnRenamed("node", "b"), "b")
    heads = per_hub.join(slim.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "raw")
    rows = tails.select("a", "slice", "b", "raw").unionByName(heads.select("a", "slice", F.lit(None).cast("long").alias("b"), "raw"))
    rows = rows.repartition("a", "slice").sortWithinPartitions("a", "slice", F.col("b").asc_nulls_first())

    def run(batches):
        own = np.empty(0, dtype=np.uint64)
        for batch in batches:
            a, b = [], []
            for at in range(batch.num_rows):
                hub, other = batch.column(0)[at].as_py(), batch.column(2)[at].as_py()
                these = np.frombuffer(batch.column(3)[at].as_buffer(), dtype=np.uint64)
                if other is None:
                    own = these.copy()
                    continue
                small, large = (own, these) if len(own) < len(these) else (these, own)
                spot = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[spot] == small).sum())
                if 100 * both >= PERCENT * (len(own) + len(these) - both):
                    a.append(hub)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def shared(one: np.ndarray, two: np.ndarray) -> int:
    """Elements that two sorted arrays without repeats have in common."""
    small, large = (one, two) if len(one) < len(two) else (two, one)
    spot = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[spot] == small).sum())


def tiles(postings: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, tile, i, j, node, label, n, band, part): nodes of different labels that share a token, by tiles of neighbouring sizes.

    Bands are powers of 1.25, so linked sets are in one band or in neighbours; a node goes to its own band's tile and the
    next one's, and a pair is taken in the tile of the larger set's band. A tile of many nodes, or of large sets, is cut into pairs of slices.
    """
    rows = postings.join(labels, "node").join(nodes.select("node", "n"), "node")
    rows = rows.withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / PERCENT)) + 1e-9).cast("int"))
    rows = rows.withColumn("tile", F.explode(F.array("band", F.col("band") + 1)))
    sizes = rows.groupBy("token", "tile").agg(
        F.count("*").alias("m"), F.sum("n").alias("all"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.col("band") == F.col("tile")).alias("own")
    ).where("m > 1 AND lo < hi AND own")
    sizes = sizes.select("token", "tile", F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("all") / SLICE)).cast("int").alias("parts"))
    cut = rows.join(sizes, ["token", "tile"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return cut.select("token", "tile", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "node", "label", "n", "band", "part")


TILED = ["token", "tile", "i", "j"]


def near_by_tile(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Iterator[np.ndarray]]]:
    """For each tile of a table with bitmaps: its rows' places, labels, and for each of its rows the later ones that may link to it.

    What comes out for a row depends on the labels at that time: the caller may join labels as it goes.
    """
    label, size = pdf["label"].to_numpy(), pdf["n"].to_numpy()
    band, tile, part = (pdf[c].to_numpy() for c in ("band", "tile", "part"))
    for (_, t, i, j), at in pdf.groupby(TILED, sort=False).indices.items():
        raw = [np.frombuffer(b, dtype=np.uint64) for b in pdf["bits"].iloc[at]]
        width = min(map(len, raw))
        bits = np.stack([folded(b, width) for b in raw])
        short, names = folded(bits, BITS // 64), label[at].copy()

        def later(x, at=at, bits=bits, short=short, names=names, t=t, i=i, j=j):
            rest = np.arange(x + 1, len(at))
            ok = (names[rest] != names[x]) & ((band[at[rest]] == t) | (band[at[x]] == t))
            if i != j:
                ok &= part[at[rest]] != part[at[x]]
            rest = rest[ok]
            for tried in (short, bits):
                rest = rest[may_link(size[at[x]], size[at[rest]], tried[x], tried[rest])]
            return rest

        yield at, names, later


def tile_members(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those rows of the tiles that have a partner there, by sizes and bitmaps."""
    boxes = placed.count() // BOX + 16
    names = placed.columns
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        partnered = np.zeros(len(pdf), dtype=bool)
        for at, _, later in near_by_tile(pdf):
            for x in range(len(at) - 1):
                rest = later(x)
                if len(rest):
                    partnered[at[x]] = True
                    partnered[at[rest]] = True
        return pdf.loc[partnered, names]

    rows = placed.join(nodes.select("node", "bits"), "node").withColumn("box", F.pmod(F.xxhash64(*TILED), F.lit(boxes)))
    return rows.groupBy("box").applyInPandas(find, kept)


def different_tiles(members: DataFrame) -> DataFrame:
    """The rows of one tile of those that compare the same members: the shingles of a shared passage make very many such.

    Lists of members are told apart by their length and two 64-bit sums of hashes. Tiles of two slices stay all.
    """
    lists = members.where("i = j").groupBy("tile", "token", "i").agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    )
    one = lists.groupBy("tile", "m", "x", "y").agg(F.min(F.struct("token", "i")).alias("one")).select("tile", "one.token", "one.i")
    return members.where("i < j").unionByName(members.where("i = j").join(one, ["tile", "token", "i"], "left_semi").select(members.columns))


def tile_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): for each tile, links that tie together all its members that are tied by links, one fewer than there are members at most.

    Pairs that the bitmaps allow are checked on the sorted hashes, unless both are tied already.
    """
    boxes = (members.agg(F.sum("n").alias("n")).first()["n"] or 0) // SLICE + 16

    def tie(pdf: pd.DataFrame) -> pd.DataFrame:
        node, size, lefts, rights = pdf["node"].to_numpy(), pdf["n"].to_numpy(), [], []
        raw = [np.frombuffer(x, dtype=np.uint64) for x in pdf["raw"]]
        pdf = pdf.assign(bits=[bitmap(x) for x in raw])
        for at, names, later in near_by_tile(pdf):
            for x in range(len(at) - 1):
                for y in later(x):
                    if names[x] == names[y]:
                        continue
                    both = shared(raw[at[x]], raw[at[y]])
                    if 100 * both >= PERCENT * (size[at[x]] + size[at[y]] - both):
                        names[names == names[y]] = names[x]
                        lefts.append(min(node[at[x]], node[at[y]]))
                        rights.append(max(node[at[x]], node[at[y]]))
        return pd.DataFrame({"a": np.array(lefts, dtype=np.int64), "b": np.array(rights, dtype=np.int64)})

    rows = members.join(sets, "node").withColumn("box", F.pmod(F.xxhash64(*TILED), F.lit(boxes)))
    return rows.groupBy("box").applyInPandas(tie, "a long, b long")


def open_postings(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Those whose token is under two labels or more; of tokens with the same nodes (a shared passage has many) one stays.

    Lists of nodes are told apart by their length and two 64-bit sums of hashes.
    """
    ends = postings.join(labels, "node").groupBy("token").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    )
    one = ends.where("lo < hi").groupBy("m", "x", "y").agg(F.min("token").alias("token")).select("token")
    return postings.join(one, "token", "left_semi")


def near_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, node, group, mark.

    Two documents link when their sets of 5-word shingles have a Jaccard likeness of 0.8 or more; component_id is the least doc_id
    reachable by links. The join is exact up to equal 64-bit hashes of different shingles:

    1. equal sets are one node, named by a 64-bit digest;
    2. nodes that share a MinHash band, and whose bitmaps allow it, are checked against the least of the band, which ties most
       of a large group of near copies together by as many checks as it has members;
    3. any other linked pair must share one of the first 20 % of its shingles in a common order: nodes that share one
       and are not tied yet are compared by tiles of neighbouring size bands, by bitmap;
    4. in tiles where bitmaps allow links the sets are intersected, and each tile hands on as many links as tie its members together.

    A document without words or text has n_shingles 0, links with nothing and is its own component. A null doc_id
    takes part, and its component_id is null only if no document with an id is reachable. Rows under one doc_id are documents of
    their own. Repeated rows come out as often as they went in. Other columns are not read. ``node`` names the set,
    ``group`` the component (null without words), ``mark`` is the hash of the text.
    """
    slim = docs.select("doc_id", "text")
    made = cut_lineage(digests(slim))
    every = made.where("token IS NULL")
    nodes = every.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "bits", "bands")])
    nodes = cut_lineage(nodes)  # rows of one node are equal but for the id
    frequent = made.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("n")).where("n >= 16")
    heavy = frequent.orderBy(F.desc("n"), "token").limit(HEAVY).select("token").toPandas()["token"].to_numpy(dtype=np.int64)[::-1].view(np.uint64)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The sets of nodes, from the texts of the least documents that have them."""
        holders = nodes.join(wanted, "node").select("least").distinct()
        full = whole_sets(slim.join(holders, slim["doc_id"].eqNullSafe(holders["least"]), "left_semi"))
        return full.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("raw").alias("raw"))

    # nodes that share a band are checked against the least of them
    bands = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    hubs = bands.groupBy("band", "key").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most").select("band", "key", "a")
    stars = bands.join(hubs, ["band", "key"]).where("node > a").select("a", F.col("node").alias("b")).distinct()
    stars = cut_lineage(likely_pairs(stars, nodes))
    ends = cut_lineage(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    full = cut_lineage(sets_of(ends))
    links = cut_lineage(linked_pairs(stars, full))
    groups = components(links)

    # nodes that share a shingle of their prefixes and aren't tied yet are compared
    size = every.agg(F.sum("n").alias("n")).first()["n"] or 0
    postings = cut_lineage(shared_tokens(slim, heavy, size // 2_500_000 + 1).distinct())
    labels = cut_lineage(nodes.select("node").join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("label")))
    placed = cut_lineage(tiles(open_postings(postings, labels), nodes, labels))
    found = cut_lineage(tile_members(placed, nodes))
    members = cut_lineage(different_tiles(found))
    remove_tables(postings, labels, placed, found, full)
    more = tile_links(members, sets_of(cut_lineage(members.select("node").distinct())))
    groups = components(links.union(more))
    named = nodes.join(groups, "node", "left").select("node", "least", F.coalesce("component", "node").alias("group"))
    least = named.groupBy("group").agg(F.min("least").alias("found"))
    named = named.join(least, "group").select("node", "group", "found")
    return every.join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("found", "doc_id").alias("component_id"), "node", "group", "mark"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for one of each group of linked documents: the least by doc_id (null last) and text hash stays.

    Documents without words stay all. Of rows equal in doc_id and text one stays, if they have words.
    """
    found = near_documents(docs).where("n_shingles > 0").withColumn("late", F.col("doc_id").isNull())
    first = found.groupBy("group").agg(F.min(F.struct("late", "doc_id", "mark")).alias("stays")).select("stays.*")
    key = lambda doc, mark: (F.coalesce(doc, F.lit(0)).alias("k1"), F.xxhash64(mark, doc.isNull()).alias("k2"))
    first = first.select(*key(F.col("doc_id"), F.col("mark")), F.lit(True).alias("first"))
    rows = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), *key(F.col("doc_id"), text_mark(F.col("text"))),
        F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"),
    )
    joined = rows.join(first, ["k1", "k2"], "left").where("first OR NOT worded")
    joined = joined.withColumn("turn", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("worded")))
    return joined.where("NOT worded OR turn = 1").select("row.*")
