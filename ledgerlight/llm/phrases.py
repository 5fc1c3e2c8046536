"""Phrase mining on sorted occurrence relations: join neighbours, count groups, keep the frequent ones, extend."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.session import cut_lineage, remove_tables

LONGEST = 5
LEAST = 100
TOP = 2000
#: Words of a chunk, about: whole documents are put together until there are so many. A longer document is a chunk of its own.
CHUNK = 500_000
#: Bytes of text, or occurrences, for each box of groups.
BOX = 1 << 24

#: A-Z become a-z, tabs blanks, and the ends of pieces line feeds.
LETTERS = bytes(10 if b in b".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
CODEC = "zstd"


def pack(values: np.ndarray) -> bytes:
    """An array as bytes: the first bytes of all values, then the second ones and so on, compressed."""
    plain = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(plain).to_bytes(8, "little") + pa.Codec(CODEC).compress(plain, asbytes=True)


def unpack(raw: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    plain = np.frombuffer(pa.Codec(CODEC).decompress(raw[8:], size, asbytes=True), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(plain.reshape(width, size // width).T).view(kind).ravel()


def tokens(text: str) -> list[bytes]:
    """The words of a text; a line feed ends a piece, empty ones are none."""
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).replace(b"\n", b" \n ").split(b" ")


#: What a pass over the chunks writes: the occurrences of a chunk (pos, code), or its groups of one box: the keys, and the counts of
#: codes ``start``, ``start`` + 1 and so on. Keys are words, or the ids of the first and the last words of a phrase.
SCHEMA = "chunk long, pos binary, code binary, box int, start int, words array<binary>, heads binary, tails binary, counts binary, lang string, total long"
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def record(**columns: list) -> pa.RecordBatch:
    kinds = {"chunk": pa.int64(), "box": pa.int32(), "start": pa.int32(), "words": pa.list_(pa.binary()), "lang": pa.string(), "total": pa.int64()}
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), kinds.get(c, pa.binary())) for c in NAMES], names=NAMES)


def group_rows(chunk: int, box: np.ndarray, counts: np.ndarray, **keys) -> pa.RecordBatch:
    """The groups of a chunk, in order of their boxes, as one row a box."""
    starts = np.flatnonzero(np.diff(box, prepend=-1))
    stops = [*starts[1:], len(box)]
    cut = {k: [v[a:b] if isinstance(v, list) else pack(v[a:b]) for a, b in zip(starts, stops)] for k, v in keys.items()}
    return record(
        chunk=[chunk] * len(starts), box=box[starts].tolist(), start=starts.tolist(), counts=[pack(counts[a:b]) for a, b in zip(starts, stops)], **cut
    )


def occurrences(docs: DataFrame, boxes: int) -> DataFrame:
    """First pass: the words of every chunk in order, groups of words, and the number of words per lang.

    A position counts words and ends of pieces from the chunk's start, so two words are neighbours in a
    piece if and only if their positions are. Documents are parted by an end as well.
    """

    def close(chunk: int, codes: list[np.ndarray], known: dict[str, dict[bytes, int]], n: int) -> Iterator[pa.RecordBatch]:
        key = [b""] * n
        for lang, words in known.items():
            for word, code in words.items():
                if code >= 0:
                    key[code] = lang.encode("utf-8", "surrogatepass") + b"\n" + word
        import zlib

        box = np.fromiter((zlib.crc32(k) % boxes for k in key), dtype=np.int64, count=n)
        order = np.argsort(box, kind="stable")
        renamed = np.empty(n, dtype=np.int32)
        renamed[order] = np.arange(n, dtype=np.int32)
        line = np.concatenate(codes)
        pos = np.flatnonzero(line >= 0).astype(np.int32)
        code = renamed[line[pos]]
        yield record(chunk=[chunk], pos=[pack(np.diff(pos, prepend=np.int32(0)))], code=[pack(code)])
        yield group_rows(chunk, box[order], np.bincount(code, minlength=n).astype(np.int32), words=[key[i] for i in order])

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        codes, known, n, held, totals = [], {}, 0, 0, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist()):
                    words = known.setdefault(lang, {b"": -2, b"\n": -1})
                    found = tokens(text)
                    for word in set(found).difference(words):
                        words[word] = n
                        n += 1
                    line = np.fromiter(map(words.__getitem__, found), dtype=np.int32, count=len(found))
                    codes += [line[line > -2], np.array([-1], dtype=np.int32)]
                    totals[lang] = totals.get(lang, 0) + int((line >= 0).sum())
                    held += len(found)
                    if held >= CHUNK and n:
                        yield from close(part << 32 | made, codes, known, n)
                        codes, known, n, held, made = [], {}, 0, 0, made + 1
        if n:
            yield from close(part << 32 | made, codes, known, n)
        yield record(lang=list(totals), total=list(totals.values()))

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return docs.select(lang, F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def frequent_groups(made: DataFrame, boxes: int, least: int) -> DataFrame:
    """Groups counted over all chunks: one row (id, word, head, tail, n) per frequent one, and for each chunk the codes and ids of its frequent ones.

    A chunk gives one row per group, so the most frequent group brings as many rows to its box as there are chunks.
    An id is the box and the place in its order, the same in every run.
    """
    schema = "chunk long, codes binary, ids binary, id long, word binary, head long, tail long, n long"

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        box = key[0].as_py()
        lists = {n: rows.column(n).to_pylist() for n in ("chunk", "start", "words", "heads", "tails", "counts")}
        counts = [unpack(c, np.int32) for c in lists["counts"]]
        sizes = [len(c) for c in counts]
        chunk = np.repeat(np.array(lists["chunk"], dtype=np.int64), sizes)
        code = np.concatenate([s + np.arange(m, dtype=np.int32) for s, m in zip(lists["start"], sizes)])
        counts = np.concatenate(counts).astype(np.int64)
        words = lists["words"][0] is not None
        if words:
            flat = pa.chunked_array([pa.array(w, pa.binary()) for w in lists["words"]]).combine_chunks()
            names = flat.dictionary_encode()
            inverse, n = names.indices.to_numpy(zero_copy_only=False), len(names.dictionary)
        else:
            heads, tails = (np.concatenate([unpack(x, np.int64) for x in lists[k]]) for k in ("heads", "tails"))
            order = np.lexsort((tails, heads))
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (heads[order][1:] != heads[order][:-1]) | (tails[order][1:] != tails[order][:-1])
            inverse = np.empty(len(order), dtype=np.int64)
            inverse[order] = np.cumsum(fresh) - 1
            n = int(fresh.sum())
        total = np.bincount(inverse, weights=counts, minlength=n).astype(np.int64)  # exact below 2**53
        often = np.flatnonzero(total >= least)
        group = {}
        if words:
            name = names.dictionary.take(pa.array(often))
            rank = pc.sort_indices(name).to_numpy()
            often, group["word"] = often[rank], name.take(pa.array(rank))
        else:
            first = order[fresh]
            group |= {"head": pa.array(heads[first][often]), "tail": pa.array(tails[first][often])}
        ids = np.full(n, -1, dtype=np.int64)
        ids[often] = box + boxes * np.arange(len(often), dtype=np.int64)
        group |= {"id": pa.array(ids[often]), "n": pa.array(total[often])}
        kept = ids[inverse] >= 0
        chunk, code, ids = chunk[kept], code[kept], ids[inverse][kept]
        order = np.argsort(chunk, kind="stable")
        chunk, code, ids = chunk[order], code[order], ids[order]
        starts = np.flatnonzero(np.diff(chunk, prepend=-1))
        stops = [*starts[1:], len(chunk)]
        reply = {
            "chunk": pa.array(chunk[starts]), "codes": pa.array([pack(code[a:b]) for a, b in zip(starts, stops)], pa.binary()),
            "ids": pa.array([pack(ids[a:b]) for a, b in zip(starts, stops)], pa.binary()),
        }
        kinds = {"codes": pa.binary(), "ids": pa.binary(), "word": pa.binary()}
        sides = []
        for columns in (group, reply):
            m = len(next(iter(columns.values())))
            sides.append(pa.table({f.split()[0]: columns.get(f.split()[0], pa.nulls(m, kinds.get(f.split()[0], pa.int64()))) for f in schema.split(", ")}))
        return pa.concat_tables(sides)

    wanted = made.where("box IS NOT NULL").select("box", "chunk", "start", "words", "heads", "tails", "counts")
    return wanted.groupBy("box").applyInArrow(count, schema)


def extend(made: DataFrame, replies: DataFrame, boxes: int) -> DataFrame:
    """Next pass: occurrences of frequent groups at neighbouring positions are joined; the pair of ids is the group of a phrase of one more word."""

    def join(key: tuple, held: pa.Table, found: pa.Table) -> pa.Table:
        if not held.num_rows or not found.num_rows:
            return record(chunk=[]).schema.empty_table()
        pos, code = np.cumsum(unpack(held.column("pos")[0].as_py(), np.int32), dtype=np.int32), unpack(held.column("code")[0].as_py(), np.int32)
        codes = np.concatenate([unpack(x, np.int32) for x in found.column("codes").to_pylist()])
        named = np.concatenate([unpack(x, np.int64) for x in found.column("ids").to_pylist()])
        order = np.argsort(codes)
        codes, named = codes[order], named[order]
        place = np.full(int(max(code.max(), codes[-1])) + 1, -1, dtype=np.int64)
        place[codes] = np.arange(len(codes))
        spot = place[code]
        pos, spot = pos[spot >= 0], spot[spot >= 0]
        next_to = np.flatnonzero(pos[1:] == pos[:-1] + 1)  # both sides are sorted, so neighbours stand next to each other
        if not len(next_to):
            return record(chunk=[]).schema.empty_table()
        pairs, inverse, counts = np.unique(spot[next_to] * len(codes) + spot[next_to + 1], return_inverse=True, return_counts=True)
        heads, tails = named[pairs // len(codes)], named[pairs % len(codes)]
        mixed = heads.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tails.astype(np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        box = ((mixed >> np.uint64(32)) % np.uint64(boxes)).astype(np.int64)
        order = np.argsort(box, kind="stable")
        renamed = np.empty(len(pairs), dtype=np.int32)
        renamed[order] = np.arange(len(pairs), dtype=np.int32)
        chunk = key[0].as_py()
        kept = record(chunk=[chunk], pos=[pack(np.diff(pos[next_to], prepend=np.int32(0)))], code=[pack(renamed[inverse])])
        groups = group_rows(chunk, box[order], counts[order].astype(np.int32), heads=heads[order], tails=tails[order])
        return pa.Table.from_batches([kept, groups])

    held = made.where("code IS NOT NULL").select("chunk", "pos", "code")
    return held.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(join, SCHEMA)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of 1 to ``longest`` words with ``least`` occurrences or more, and (lang, n) words."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    boxes = size // BOX + 8
    made = cut_lineage(occurrences(docs, boxes))
    totals = cut_lineage(made.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("total").alias("n")))
    levels: list[DataFrame] = []
    for words in range(1, longest + 1):
        counted = cut_lineage(frequent_groups(made, boxes, least))
        groups = counted.where("id IS NOT NULL")
        if words == 1:
            parts = F.split(F.col("word").cast("string"), "\n")  # no word holds a line feed, a lang may
            phrase = F.element_at(parts, -1)
            level = groups.select("id", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "\n").alias("lang"), phrase.alias("phrase"), phrase.alias("last"), "n")
        else:
            heads = levels[-1].select(F.col("id").alias("head"), "lang", F.col("phrase").alias("before"))
            tails = levels[-1].select(F.col("id").alias("tail"), "last")
            level = groups.select("id", "head", "tail", "n").join(heads, "head").join(tails, "tail")
            level = level.select("id", "lang", F.concat_ws(" ", "before", "last").alias("phrase"), "last", "n")
        levels.append(cut_lineage(level.withColumn("words", F.lit(words))))
        seen = levels[-1].agg(F.sum("n").alias("n")).first()["n"]
        if words == longest or not seen:
            remove_tables(made, counted)
            break
        boxes = seen // (BOX // 8) + 8
        longer = cut_lineage(extend(made, counted.where("codes IS NOT NULL").select("chunk", "codes", "ids"), boxes))
        remove_tables(made, counted)
        made = longer
    every = reduce(DataFrame.unionByName, levels)
    return every.select("lang", "phrase", "words", "n"), totals


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of the phrases of two words or more, by their lowest-scoring cut, the first of equals.

    Products are decimals of 38 digits, so they are exact as long as 1000 * a * n stays below 10**38.
    """
    long = lambda name: F.col(name).cast("decimal(19,0)")
    part = F.split("phrase", " ")
    cuts = phrases.where("words > 1").withColumnRenamed("n", "a").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"first": F.array_join(F.slice(part, F.lit(1), F.col("cut")), " "), "rest": F.array_join(F.slice(part, F.col("cut") + 1, F.size(part)), " ")})
    known = phrases.select("lang", "phrase", "n")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.join(totals, "lang").withColumns({"an": F.lit(1000).cast("decimal(4,0)") * long("a") * long("n"), "lr": long("l") * long("r")})
    low = cuts.groupBy("lang", "phrase").agg(
        F.first("words").alias("words"), F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct(F.expr("an div lr").alias("score"), "cut", "l", "r")).alias("low")
    )
    return low.select("lang", "phrase", "words", "a", "low.l", "low.r", "n", "low.score")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each lang by score, then a, then phrase.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and pieces at blanks and tabs
    into words. A phrase of k + 1 words comes from two frequent ones of k words at neighbouring positions, so
    nothing rare is ever extended. A phrase goes if a longer one that holds it is as frequent; one more word is enough to look at, as the phrases
    between have the same count. Null texts have no words, a null lang is ``und``; rows that are given twice count twice, and so
    do equal texts. A table without words gives no rows. Only lang and text are read.
    """
    phrases, totals = frequent_phrases(docs, longest, least)
    part = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(part, F.lit(1), F.size(part) - 1), " "), F.array_join(F.slice(part, F.lit(2), F.size(part)), " "))
    inside = phrases.where("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("n").alias("a")).distinct()
    left = cut_lineage(scored(phrases, totals).join(inside, ["lang", "phrase", "a"], "left_anti"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
