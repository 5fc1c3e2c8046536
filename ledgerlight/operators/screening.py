"""Watch-list loading helpers and fuzzy name screening."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.session import cut_lineage

# Pairs of a numpy step, and the table cells its edit distances may take.
PAIRS_AT_ONCE = 262_144
CELLS_AT_ONCE = 1_000_000
# Names up to this length are compared by bits of one machine word, so many pairs at once that their words stay in the cache.
WORD_BITS = 64
WORDS_AT_ONCE = 16_384
# Slices of queries that meet a chunk in one task, and copies of chunks, at least and at most.
GROUP_SLICES, CHUNK_COPIES = 2, 10_000
# Pairs of query and name in the tiles of one task, at least, where queries suffice: small chunks meet more slices.
GROUP_PAIRS = 5_000_000
# Queries and entries of one name that meet in one cell of the join, and rows that a task of it makes.
CELL_QUERIES, CELL_ENTRIES, TASK_ROWS = 1_000, 500, 500_000
# Weights of word likeness, and of parts and word sets of names 1.5 and 8 times as long.
WORDS_WEIGHT = 0.95
PART_WEIGHT = 0.9
FAR_PART_WEIGHT = 0.6
# Null marker, default threshold, and where a listed entry can be looked up.
NULL_MARK = "-0-"
MATCH_THRESHOLD = 70.0
REFERENCE_URL = "https://sanctionssearch.ofac.treas.gov/Details.aspx?id="


def clean_sentinel(value: Column) -> Column:
    trimmed = F.trim(value)
    return F.nullif(F.nullif(trimmed, F.lit("")), F.lit(NULL_MARK))


def split_programs(value: Column) -> Column:
    parts = F.transform(F.split(clean_sentinel(value), r"\] \["), lambda p: F.trim(p, F.lit("[] ")))
    return F.coalesce(parts, F.array().cast("array<string>"))


def normalise_name(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", " "))


def sorted_tokens(normal: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(normal, " "), lambda t: t != "")), " ")


def reference_url(ent_num: Column) -> Column:
    return F.concat(F.lit(REFERENCE_URL), ent_num)


def _columns(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as columns of code points (zero-padded) and their lengths."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    table = np.zeros((len(texts), int(lengths.max(initial=0))), dtype=np.int32)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    table[np.arange(table.shape[1]) < lengths[:, None]] = codes
    return np.ascontiguousarray(table.T), lengths


def _block_edits(left: list[str], right: list[str]) -> np.ndarray:
    (a, a_sizes), (b, b_sizes) = _columns(left), _columns(right)
    every = np.arange(len(left))
    before = np.repeat(np.arange(len(b) + 1, dtype=np.int32)[:, None], len(left), axis=1)
    after, step = np.empty_like(before), np.empty_like(before[0])
    result = b_sizes.astype(np.int32)
    for i in range(1, len(a) + 1):
        after[0] = i
        for j in range(1, len(b) + 1):
            np.add(before[j - 1], a[i - 1] != b[j - 1], out=step)
            np.minimum(before[j], after[j - 1], out=after[j])
            after[j] += 1
            np.minimum(after[j], step, out=after[j])
        done = every[a_sizes == i]
        result[done] = after[b_sizes[done], done]
        before, after = after, before
    return result


def _longest(left: list[str], right: list[str]) -> np.ndarray:
    a, b = (np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) for texts in (left, right))
    return np.maximum(a, b)


def edits(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distance of each pair of texts; pairs of like length go together, in blocks of at most ``CELLS_AT_ONCE`` cells."""
    result = np.zeros(len(left), dtype=np.int64)
    sizes = _longest(left, right) + 1
    order = np.argsort(sizes, kind="stable")
    end = len(order)
    while end:
        start = max(0, end - max(1, CELLS_AT_ONCE // int(sizes[order[end - 1]])))
        at = order[start:end]
        result[at] = _block_edits([left[i] for i in at], [right[i] for i in at])
        end = start
    return result


def _table(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts of up to ``WORD_BITS``, a row each (longer ones are left empty), and the lengths of all."""
    columns, held = _columns([t if len(t) <= WORD_BITS else "" for t in texts])
    return np.where(np.arange(len(columns))[None, :] < held[:, None], columns.T, -1), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


class _Listed:
    """Names as rows of letter numbers."""

    def __init__(self, texts: list[str]):
        codes, self.sizes = _table(texts)
        self.alphabet = np.unique(codes[codes >= 0])
        self.letters = np.searchsorted(self.alphabet, codes)


class _Asked:
    """Queries as words: per query and letter of the listed names, a bit for each place where the query has it."""

    def __init__(self, texts: list[str], listed: _Listed):
        codes, self.sizes = _table(texts)
        self.masks = np.zeros((len(texts), len(listed.alphabet) + 1), dtype=np.uint64)
        row, place = np.nonzero(np.isin(codes, listed.alphabet))
        letter = np.searchsorted(listed.alphabet, codes[row, place])
        np.bitwise_or.at(self.masks, (row, letter), np.uint64(1) << place.astype(np.uint64))


def _word_edits(asked: _Asked, q: np.ndarray, listed: _Listed, n: np.ndarray) -> np.ndarray:
    """Edit distances of queries ``q`` and names ``n``, none longer than ``WORD_BITS``.

    Differences between neighbouring cells of a table column are kept as two words of bits, so a column takes a few
    operations whatever the length of the query (Myers; Hyyrö).
    """
    result = np.empty(len(q), dtype=np.int64)
    width, flat, one = asked.masks.shape[1], asked.masks.ravel(), np.uint64(1)
    for at in range(0, len(q), WORDS_AT_ONCE):
        rows, names = q[at : at + WORDS_AT_ONCE], n[at : at + WORDS_AT_ONCE]
        order = np.argsort(-listed.sizes[names], kind="stable")  # so that those with letters left come first
        rows, names = rows[order], names[order]
        sizes, lengths = listed.sizes[names], asked.sizes[rows]
        letters, first = np.ascontiguousarray(listed.letters[names].T), rows * width
        last = np.maximum(lengths - 1, 0).astype(np.uint64)
        score = lengths.astype(np.int64)
        more, less = np.full(len(rows), ~np.uint64(0)), np.zeros(len(rows), dtype=np.uint64)
        live = np.searchsorted(-sizes, -np.arange(len(letters)), side="left")  # names longer than each column's place
        for j, k in enumerate(live.tolist()):
            if k == 0:
                break
            same, up, down = flat[first[:k] + letters[j, :k]], more[:k], less[:k]
            either = same | down
            level = (((either & up) + up) ^ up) | either
            fell = up & level
            rose = down | ~(up | level)
            score[:k] += ((rose >> last[:k]) & one).astype(np.int64) - ((fell >> last[:k]) & one).astype(np.int64)
            rose = (rose << one) | one
            more[:k] = (fell << one) | ~(rose | level)
            less[:k] = rose & level
        result[at + order] = np.where(lengths == 0, sizes, score)
    return result


def _numbered(parts: list[str]) -> list[tuple[str, int]]:
    """Parts with the number of their occurrence, so that sets of them meet as the bags do."""
    seen: dict[str, int] = {}
    out = []
    for part in parts:
        seen[part] = seen.get(part, 0) + 1
        out.append((part, seen[part]))
    return out


class _Text:
    """What the scores and their bounds need of one normalised name."""

    def __init__(self, normal: str):
        self.normal = normal
        words = sorted(w for w in normal.split(" ") if w)
        self.ordered = " ".join(words)
        self.words = sorted(set(words))
        self.letters = _numbered(list(normal))
        padded = f" {normal} "
        self.grams = _numbered([padded[i : i + 2] for i in range(len(padded) - 1)])
        self.words_size = max(0, sum(len(w) + 1 for w in self.words) - 1)


class NameIndex:
    """Inverted index over some names: postings of letters, pairs of letters and words.

    ``top`` returns the best ``k`` names of every query. Shared postings bound each score from above: an edit
    distance is at least the difference in length, at least the letters not shared, and at least half the padded
    letter pairs not shared. Names are then scored exactly, those with the highest bounds first, until no name left
    could reach the ``k`` best; a name whose bound equals the worst of these is scored too, as ties go to the smaller
    name. So the answer is that of scoring all names.
    """

    def __init__(self, names: list[str], normals: list[str]):
        order = sorted(range(len(names)), key=names.__getitem__)
        self.names = [names[i] for i in order]
        self.texts = [_Text(normals[i]) for i in order]
        self.size = np.array([len(t.normal) for t in self.texts], dtype=np.int64)
        self.ordered_size = np.array([len(t.ordered) for t in self.texts], dtype=np.int64)
        self.words_size = np.array([t.words_size for t in self.texts], dtype=np.int64)
        self.postings = {kind: self._post(kind) for kind in ("letters", "grams", "words")}
        self.listed = {kind: _Listed([getattr(t, kind) for t in self.texts]) for kind in ("normal", "ordered")}

    def _post(self, kind: str) -> dict:
        lists: dict = {}
        for i, text in enumerate(self.texts):
            for part in getattr(text, kind):
                lists.setdefault(part, []).append(i)
        return {part: np.array(at, dtype=np.int64) for part, at in lists.items()}

    def shared(self, kind: str, parts: list, sizes: list[int] | None = None) -> np.ndarray:
        """Parts shared with every name, or the sum of their sizes."""
        lists = [(self.postings[kind][p], 1 if sizes is None else sizes[i]) for i, p in enumerate(parts) if p in self.postings[kind]]
        if not lists:
            return np.zeros(len(self.names), dtype=np.int64)
        at = np.concatenate([x for x, _ in lists])
        weights = None if sizes is None else np.repeat([s for _, s in lists], [len(x) for x, _ in lists])
        return np.bincount(at, weights=weights, minlength=len(self.names)).astype(np.int64)

    def bounds(self, query: _Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per name: upper bounds of the whole, ordered and part likeness, and the exact one of the word sets."""
        letters, grams = self.shared("letters", query.letters), self.shared("grams", query.grams)
        common = np.maximum(0, self.shared("words", query.words, [len(w) + 1 for w in query.words]) - 1)

        def like(size: int, sizes: np.ndarray) -> np.ndarray:
            longest = np.maximum(size, sizes)
            least = np.maximum(np.abs(size - sizes), np.maximum(longest - letters, (longest + 2 - grams) // 2))
            return np.where(longest == 0, 0.0, 1.0 - least / np.maximum(longest, 1))

        size = len(query.normal)
        scale = self.scale(size)
        shorter = np.minimum(size, self.size)
        least = np.maximum(0, np.maximum(shorter - letters, (shorter - grams) // 2))
        long_enough = (shorter > 0) & (2 * np.maximum(size, self.size) >= 3 * shorter)
        part = np.where(long_enough, (1.0 - least / np.maximum(shorter, 1)) * scale, 0.0)
        fewest = np.minimum(query.words_size, self.words_size)
        sets = np.where(common > 0, common / np.maximum(fewest, 1) * WORDS_WEIGHT * scale, 0.0)
        return like(size, self.size), like(len(query.ordered), self.ordered_size) * WORDS_WEIGHT, part, sets

    def scale(self, size: int) -> np.ndarray:
        longer, shorter = np.maximum(size, self.size), np.minimum(size, self.size)
        return np.where(2 * longer < 3 * shorter, 1.0, np.where(longer <= 8 * shorter, PART_WEIGHT, FAR_PART_WEIGHT))

    def distances(self, kind: str, queries: list[_Text], asked: _Asked, q: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edit distances of the pairs, and the lengths of the longer texts."""
        listed = self.listed[kind]
        longest = np.maximum(asked.sizes[q], listed.sizes[n])
        result = np.empty(len(q), dtype=np.int64)
        fits = longest <= WORD_BITS
        result[fits] = _word_edits(asked, q[fits], listed, n[fits])
        if not fits.all():
            left, right = [getattr(x, kind) for x in queries], [getattr(x, kind) for x in self.texts]
            result[~fits] = edits([left[i] for i in q[~fits].tolist()], [right[i] for i in n[~fits].tolist()])
        return result, longest

    def exact(self, queries: list[_Text], asked: dict[str, _Asked], q: np.ndarray, n: np.ndarray, bounds: tuple) -> np.ndarray:
        """Scores of the pairs (query ``q[i]``, name ``n[i]``); a likeness whose bound is already beaten is left out."""
        whole, ordered, part, best = bounds
        best = best.copy()

        def raise_to(bound: np.ndarray, likeness) -> None:
            at = np.flatnonzero(bound > best)
            if len(at):
                best[at] = np.maximum(best[at], likeness(at))

        def plain(kind: str, weight: float):
            def run(at: np.ndarray) -> np.ndarray:
                least, longest = self.distances(kind, queries, asked[kind], q[at], n[at])
                return (1.0 - least / longest) * weight

            return run

        def windows(at: np.ndarray) -> np.ndarray:
            least = np.empty(len(at), dtype=np.int64)
            weight, shorter = np.empty(len(at)), np.empty(len(at), dtype=np.int64)
            left, right, owner = [], [], []

            def flush() -> None:
                if owner:
                    np.minimum.at(least, owner, edits(left, right))
                    left.clear(), right.clear(), owner.clear()

            for place, i in enumerate(at):
                short, long = sorted((queries[q[i]].normal, self.texts[n[i]].normal), key=len)
                least[place] = shorter[place] = len(short)
                weight[place] = PART_WEIGHT if len(long) <= 8 * len(short) else FAR_PART_WEIGHT
                if short in long:
                    least[place] = 0
                    continue
                for start in range(len(long) - len(short) + 1):
                    left.append(short), right.append(long[start : start + len(short)]), owner.append(place)
                    if len(owner) >= PAIRS_AT_ONCE:
                        flush()
            flush()
            return (1.0 - least / shorter) * weight

        raise_to(whole, plain("normal", 1.0))
        raise_to(ordered, plain("ordered", WORDS_WEIGHT))
        raise_to(part, windows)
        return _rounded(best)

    def top(self, normals: list[str], k: int) -> list[list[tuple[str, float]]]:
        """Per query the best ``k`` names with their scores, in the order of the names."""
        found: list[list[tuple[str, float]]] = []
        block = max(1, PAIRS_AT_ONCE // max(1, len(self.names)))
        for at in range(0, len(normals) if self.names else 0, block):
            found += self._top([_Text(x) for x in normals[at : at + block]], k)
        return found or [[] for _ in normals]

    def _top(self, queries: list[_Text], k: int) -> list[list[tuple[str, float]]]:
        bounds = tuple(np.stack(x) for x in zip(*(self.bounds(query) for query in queries), strict=True))
        most = _rounded(np.max(bounds, axis=0))
        scores = np.full(most.shape, -1.0)
        kept = min(k, most.shape[1])
        worst = np.full(len(queries), -1.0)
        asked = {kind: _Asked([getattr(x, kind) for x in queries], listed) for kind, listed in self.listed.items()}
        for first in (4 * k, 64 * k, most.shape[1]):  # the likeliest names, more of them, then all that could still be among the best
            likeliest = np.where((scores < 0) & (most >= worst[:, None]), most, -1.0)
            if first < most.shape[1]:  # ties at the cut wait for the next round
                np.put_along_axis(likeliest, np.argpartition(-likeliest, first, axis=1)[:, first:], -1.0, axis=1)
            q, n = np.nonzero(likeliest >= 0)
            scores[q, n] = self.exact(queries, asked, q, n, tuple(x[q, n] for x in bounds))
            worst = np.partition(scores, -kept, axis=1)[:, -kept]
        found = []
        for row in scores:
            best = np.argsort(-row, kind="stable")[:kept]
            found.append([(self.names[i], float(row[i])) for i in best])
        return found


def _rounded(likeness: np.ndarray) -> np.ndarray:
    return np.floor(likeness * 10_000 + 0.5) / 100


def name_scores(query: str, names: list[str]) -> dict[str, float]:
    """0-100 per distinct normalised name: the best of four likenesses.

    Whole string: 1 - edits / longer length. Sorted words, at 95 %: the same of the words in order. Word sets, at
    95 %: length of the distinct words both have, over that of the shorter set, each joined by spaces. Part of a
    name, only if one is 1.5 times as long as the other: the shorter string against every window of its length in the
    longer. From 1.5 times on, word sets and parts count 90 %, beyond 8 times 60 %.
    """
    listed = sorted(set(names))
    return dict(NameIndex(listed, listed).top([query], len(listed))[0]) if listed else {}


def name_index(entries: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Every searchable name with the entry behind it: primary names and, if given, aliases.

    The index stays in long form, one row per (name, entry), so a name shared by
    very many entries is many rows and not one huge array.
    """
    primary = entries.select("sdn_type", "name", "ent_num").withColumn("is_alias", F.lit(False))
    if aliases is None:
        return primary
    known = aliases.join(entries.select("ent_num", "sdn_type"), "ent_num").filter(F.col("alias") != "")
    return primary.unionByName(
        known.select("sdn_type", F.col("alias").alias("name"), "ent_num", F.lit(True).alias("is_alias"))
    )


def attach_aliases(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entries with their aliases, one row per alias (null alias when none); unknown ids drop out."""
    return entries.join(aliases.filter(F.col("alias") != ""), "ent_num", "left")


def _best_of_tiles(by: list[str], k: int):
    """Best ``k`` names of a chunk for each query of a slice; an index serves the slices that follow it in a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, index = None, None
        for tiles in batches:
            for tile in tiles.to_dict("records"):
                where = (*(tile[c] for c in by), tile["chunk"])
                if where != held:
                    held, index = where, NameIndex(list(tile["names"]), list(tile["normals"]))
                rows = [
                    (*where[:-1], query, name, score)
                    for query, best in zip(tile["queries"], index.top(list(tile["asked"]), k), strict=True)
                    for name, score in best
                ]
                if rows:
                    yield pd.DataFrame(rows, columns=[*by, "query", "matched_name", "score"])

    return run


def _scored(
    queries: DataFrame, names: DataFrame, by: list[str], k: int, chunk_names: int, slice_queries: int = 500
) -> DataFrame:
    """Best ``k`` distinct names per query, over tiles of (slice of queries) x (chunk of names).

    Both sides are de-duplicated and counted; the counts set how many slices and chunks there are. A chunk is one row
    and is repeated once per group of slices, a slice once per chunk; a chunk and a group meet in one of as many tasks as
    they make, so that neither a broadcast of the queries nor adaptive coalescing puts the tiles in one. Queries that make
    less than ``GROUP_PAIRS`` pairs with a chunk are one group, and chunks are not repeated then. Groups grow
    with the number of tiles, so chunks are repeated ``CHUNK_COPIES`` times at most in all. Inside a tile an
    inverted index finds the names that can be among the best (see ``NameIndex``). A tile hands on ``k`` rows per
    query; no pair of query and name is ever a row.
    """
    listed = names.select(*by, "name").filter("name IS NOT NULL").distinct()
    asked = queries.select(*by, "query").filter("query IS NOT NULL").distinct()
    chunks = max(1, -(-listed.count() // chunk_names))
    slices = max(1, -(-asked.count() // slice_queries))
    size = max(GROUP_SLICES, -(-chunks * slices // CHUNK_COPIES), GROUP_PAIRS // (chunk_names * slice_queries))
    groups = -(-slices // size)

    def numbers(n: int):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    chunk = F.pmod(F.xxhash64("name"), F.lit(chunks)).alias("chunk")
    right = listed.groupBy(*by, chunk).agg(F.collect_list(F.struct("name", normalise_name(F.col("name")).alias("n"))).alias("l"))
    slice_of = F.pmod(F.xxhash64("query"), F.lit(slices)).alias("slice")
    left = asked.groupBy(*by, slice_of).agg(F.collect_list(F.struct("query", normalise_name(F.col("query")).alias("q"))).alias("a"))
    left = left.withColumn("chunk", numbers(chunks))
    meet, tasks = [*by, "chunk"], int(min(100_000, chunks * groups * (len(by) + 1)))
    if groups > 1:
        meet = [*meet, "group"]
        left, right = left.withColumn("group", F.floor(F.col("slice") / size)), right.withColumn("group", numbers(groups))
    left, right = left.repartition(tasks, *meet), right.repartition(tasks, *meet)
    tiles = left.join(right.hint("merge"), meet).select(
        *by, "chunk", F.col("l.name").alias("names"), F.col("l.n").alias("normals"), F.col("a.query").alias("queries"), F.col("a.q").alias("asked")
    )
    key_ddl = "".join(f"`{c}` string, " for c in by)
    found = tiles.mapInPandas(_best_of_tiles(by, k), f"{key_ddl}query string, matched_name string, score double")
    order = Window.partitionBy(*by, "query").orderBy(F.desc("score"), "matched_name")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _null_queries(queries: DataFrame, by: list[str]) -> DataFrame:
    return queries.filter("query IS NULL").select(*by, "query").distinct().withColumn("is_match", F.lit(False))


def screen_best(
    queries: DataFrame, entries: DataFrame, threshold: float = MATCH_THRESHOLD, chunk_names: int = 5_000
) -> DataFrame:
    """Single best listed name of the query's own ``sdn_type``, even when below the threshold.

    ``queries(query, sdn_type)``. Nothing comes back only when the type has no
    entries; a null query comes back unmatched, with a null name and score. The
    entry reported is the lowest id behind the name.
    """
    names = name_index(entries)
    best = _scored(queries, names, ["sdn_type"], 1, chunk_names).drop("place")
    first = names.groupBy("sdn_type", F.col("name").alias("matched_name")).agg(
        F.min(F.col("ent_num").cast("bigint")).cast("string").alias("entry_id")
    )
    found = best.join(first, ["sdn_type", "matched_name"]).withColumn("is_match", F.col("score") >= threshold)
    return found.unionByName(_null_queries(queries, ["sdn_type"]), allowMissingColumns=True).withColumn(
        "reference_url", reference_url(F.col("entry_id"))
    )


def _with_entries(best: DataFrame, names: DataFrame) -> DataFrame:
    """``best`` with every distinct entry behind each matched name.

    A name that is the best of very many queries, or has very many entries, makes their product in rows. Both sides are
    counted, and such a name is cut into cells of queries x entries, so that its rows are made in many tasks;
    each side is repeated only once per cell of the other. As many tasks as the rows need are asked for, because
    adaptive execution sees only the small input.
    """
    best = cut_lineage(best)
    asked = best.groupBy("matched_name").agg(F.count("*").alias("_asked"))
    behind = names.select(F.col("name").alias("matched_name"), F.col("ent_num").alias("entry_id")).distinct()
    behind = cut_lineage(behind.join(asked.select("matched_name"), "matched_name", "left_semi"))
    listed = behind.groupBy("matched_name").agg(F.count("*").alias("_listed"))
    counts = cut_lineage(asked.join(listed, "matched_name"))
    made = counts.agg(F.sum(F.col("_asked").cast("double") * F.col("_listed"))).first()[0] or 0
    tasks = int(min(100_000, made // TASK_ROWS + 1))
    cells = counts.select(
        "matched_name", F.ceil(F.col("_asked") / CELL_QUERIES).alias("_rows"), F.ceil(F.col("_listed") / CELL_ENTRIES).alias("_columns")
    )

    def every(size: str):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(size) - 1))

    def one(part: str, size: str):
        return F.pmod(F.xxhash64(part), F.col(size))

    by = ["matched_name", "_row", "_column"]
    left = best.join(cells, "matched_name").withColumn("_row", one("query", "_rows")).withColumn("_column", every("_columns"))
    right = behind.join(cells, "matched_name").withColumn("_column", one("entry_id", "_columns")).withColumn("_row", every("_rows"))
    left, right = left.repartition(tasks, *by), right.select(*by, "entry_id").repartition(tasks, *by)
    return left.join(right.hint("merge"), by).select("matched_name", *[c for c in best.columns if c != "matched_name"], "entry_id")


def screen_top(
    queries: DataFrame,
    entries: DataFrame,
    aliases: DataFrame,
    k: int = 5,
    threshold: float = MATCH_THRESHOLD,
    chunk_names: int = 5_000,
) -> DataFrame:
    """Top ``k`` distinct names over primary names and aliases of any type, with every entry behind each.

    A null query comes back as one unmatched row.
    """
    names = name_index(entries, aliases)
    best = _scored(queries, names, [], k, chunk_names)
    found = _with_entries(best, names).withColumn("is_match", F.col("score") >= threshold)
    return found.unionByName(_null_queries(queries, []), allowMissingColumns=True)


def entry_detail(ids: DataFrame, entries: DataFrame) -> DataFrame:
    """Listed entry per requested id; ``found`` is false for ids that are not listed."""
    known = entries.withColumn("found", F.lit(True))
    return ids.join(known, "ent_num", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def watchlist_stats(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    by_type = entries.groupBy(F.concat(F.lit("type:"), "sdn_type").alias("metric")).agg(F.count("*").alias("value"))
    total = entries.agg(F.count("*").alias("value")).select(F.lit("entries").alias("metric"), "value")
    known = aliases.join(entries.select("ent_num"), "ent_num", "left_semi").filter(F.col("alias") != "")
    alias_total = known.agg(F.count("*").alias("value")).select(F.lit("aliases").alias("metric"), "value")
    return by_type.unionByName(total).unionByName(alias_total)
