"""Small tables with awkward rows, and brute-force versions."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
CLASHES = ["shard", "size", "key", "mark", "row", "score", "token", "node", "rank", "part", "k0", "at", "start", "n", "label", "stratum"]


def rows_of(texts, first=0, sources=("a", "b", None)):
    return [(first + i, t, "en", sources[i % len(sources)], None if t is None else len(t)) for i, t in enumerate(texts)]


def documents(spark, rows, clashes=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clashes:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    return df


def prose(seed, words=200, line=12):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(["ka", "lo", "mi", "ten", "ur", "sa"]) for _ in range(rnd.randint(1, 4))) for _ in range(words)]
    return "\n".join(" ".join(made[i : i + line]) for i in range(0, words, line))


def awkward():
    """Nulls, nothing, white space, one word, repeated rows, a very long text."""
    return [None, "", " \n\t ", "word", "word", "same row", "same row", "é " * 40_000]


def brute_line_runs(docs, least=50):
    """{index: (text, lines, dropped)} for rows (doc_id, text) of different ids."""
    order = sorted((i for i, d in enumerate(docs) if d[1] is not None), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    lines = {i: docs[i][1].split("\n") for i in order}
    windows, first = {}, {}
    for i in order:
        w, found = [len(WORD.findall(x)) for x in lines[i]], set()
        for s in range(len(w)):
            for step, stop in ((1, len(w)), (-1, -1)):
                total = 0
                for j in range(s, stop, step):
                    total += w[j]
                    if total >= least:
                        found.add((min(s, j), max(s, j) + 1))
                        break
        windows[i] = sorted(found)
        for a, b in windows[i]:
            first.setdefault(tuple(lines[i][a:b]), (i, a))
    made = {}
    for i in order:
        gone = {p for a, b in windows[i] if first[tuple(lines[i][a:b])] != (i, a) for p in range(a, b)}
        made[i] = ("\n".join(x for p, x in enumerate(lines[i]) if p not in gone), len(lines[i]), len(gone))
    return made


def shingle_set(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(sets):
    """{index: least index reachable} for a list of shingle sets."""
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders, pairs = defaultdict(list), set()
    for i, s in enumerate(sets):
        for x in s:
            pairs.update((j, i) for j in holders[x])
            holders[x].append(i)
    for i, j in pairs:
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(len(sets))}
