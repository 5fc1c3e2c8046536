"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network with a calibrated temperature."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.arrow import drop_kept, map_rows
from ledgerlight.llm.common import seeded_key

FOLDS = 5
#: Labelled rows that the classifier is fitted on, at most; a seeded draw from all that may be used.
FIT_ROWS = 12_000
#: Units with a vector: the most frequent of the fitted rows.
UNITS = 6_000
DIMENSIONS = 64
NONZERO = 6
HIDDEN = 24

LETTERS = bytes(
    120 if 97 <= b <= 122 or b >= 128 else 88 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else 32 if b in b" \t\n\v\f\r" else b for b in range(256)
)


def shapes(raw: bytes) -> list[bytes]:
    """The words with letters as x or X and digits as 9, runs of one kind shortened to one."""
    made = raw.translate(LETTERS)
    for kind in (b"x", b"X", b"9"):
        while kind * 2 in made:
            made = made.replace(kind * 4, kind).replace(kind * 2, kind)
    return made.split()


def units(text: str | None) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Three units for each word: the lower-cased word, its shape, and whether it repeats the word before or any earlier one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    seen: set[bytes] = set()
    marks, before = [], b""
    for word in words:
        marks.append(b"==" if word == before else b"=" if word in seen else b"!=")
        seen.add(word)
        before = word
    return words, shapes(raw), marks


def index_vector(unit: bytes) -> np.ndarray:
    """A sparse vector of +1 and -1 that the unit's own hash draws."""
    rng = np.random.default_rng([zlib.crc32(unit), len(unit), zlib.adler32(unit)])
    vector = np.zeros(DIMENSIONS, dtype=np.int64)
    vector[rng.choice(DIMENSIONS, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return vector


@dataclass
class Model:
    vectors: dict[bytes, np.ndarray]
    mean: np.ndarray
    spread: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def score(self, pooled: np.ndarray) -> np.ndarray:
        inner = np.tanh((pooled - self.mean) / self.spread @ self.first + self.first_bias)
        return 1 / (1 + np.exp(-np.clip((inner @ self.second + self.second_bias) / self.temperature, -30, 30)))


def pool(text: str | None, vectors: dict[bytes, np.ndarray]) -> np.ndarray:
    """The mean of the vectors of a text's units, and a last component for its length; units without a vector count as none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    total, n = np.zeros(DIMENSIONS), max(1, len(words))
    tally = Counter(words)
    again = sum([a == b for a, b in zip(words, words[1:])])
    parts = [(tally, b"w"), (Counter(shapes(raw)), b"s"), ({b"==": again, b"=": len(words) - len(tally) - again, b"!=": len(tally)}, b"m")]
    for counts, kind in parts:
        for unit in counts.keys() & vectors[kind].keys():
            total += counts[unit] * vectors[kind][unit]
    return np.append(total / n, math.log1p(len(words)))


def fold(doc_id) -> F.Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % FOLDS


def fit_rows(docs: DataFrame, labels: DataFrame, rows: int, seed: int) -> DataFrame:
    """(doc_id, text, good): at most ``rows`` labelled documents outside the held-out fold.

    The drawn ids are at most ``rows`` longs, so they are broadcast to the documents.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    drawn = usable.groupBy("doc_id").agg(F.min("quality").alias("good")).orderBy(seeded_key(seed, F.col("doc_id")), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", F.col("good").cast("int").alias("good"))


def vocabulary(sample: DataFrame, size: int) -> list[tuple[bytes, bytes]]:
    """(kind, unit) of the units that most documents of the sample have, ``size`` at most and in three documents at least."""

    def make():
        def work(columns):
            found = []
            for text in columns["text"]:
                for kind, these in zip((b"w", b"s", b"m"), units(text)):
                    found += [kind + u for u in set(these)]
            return {"unit": found}

        return work

    counted = map_rows(sample.select("text"), make, "unit binary").groupBy("unit").agg(F.count("*").alias("n")).where("n >= 3")
    top = counted.orderBy(F.desc("n"), "unit").limit(size).collect()  # bounded by size
    return [(bytes(r["unit"][:1]), bytes(r["unit"][1:])) for r in top]


def context_vectors(sample: DataFrame, known: list[tuple[bytes, bytes]]) -> dict[bytes, dict[bytes, np.ndarray]]:
    """Random indexing: a unit's vector is its own index vector plus those of the units of the words before and after.

    Tasks add whole numbers, so the sums don't depend on the order; they come back as one row per unit and task.
    """
    index = np.array([index_vector(kind + unit) for kind, unit in known]).reshape(len(known), DIMENSIONS)
    spot = {key: i for i, key in enumerate(known)}

    def run(batches):
        drop_kept()
        sums = np.zeros((len(known) + 1, DIMENSIONS), dtype=np.int64)
        padded = np.vstack([index, np.zeros((1, DIMENSIONS), dtype=np.int64)])
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                ids = np.array([[spot.get((kind, u), len(known)) for u in these] for kind, these in zip((b"w", b"s", b"m"), units(text))], dtype=np.int64)
                if ids.shape[1] == 0:
                    continue
                here = padded[ids].sum(axis=0)
                around = np.zeros_like(here)
                around[1:] += here[:-1]
                around[:-1] += here[1:]
                for row in ids:
                    np.add.at(sums, row, around)
        used = np.flatnonzero(sums[:-1].any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["at", "sums"])

    rows = sample.select("text").mapInArrow(run, "at long, sums array<long>")
    added = rows.groupBy("at").agg(*[F.sum(F.col("sums")[d]).alias(f"d{d}") for d in range(DIMENSIONS)]).toArrow()  # a row per unit
    total = np.zeros((len(known), DIMENSIONS))
    total[added.column("at").to_numpy()] = np.stack([added.column(f"d{d}").to_numpy() for d in range(DIMENSIONS)], axis=1)
    size = np.linalg.norm(total, axis=1, keepdims=True)
    total = total / np.where(size == 0, 1, size) + index / math.sqrt(NONZERO)
    found: dict[bytes, dict[bytes, np.ndarray]] = {b"w": {}, b"s": {}, b"m": {}}
    for (kind, unit), vector in zip(known, total):
        found[kind][unit] = vector
    return found


def train(pooled: np.ndarray, good: np.ndarray, calibrate: np.ndarray, epochs: int = 60, seed: int = 5) -> tuple:
    """Adam on the log loss with weight decay; then the temperature with the least log loss on the rows marked ``calibrate``."""
    rng = np.random.default_rng(seed)
    mean, spread = pooled.mean(axis=0), pooled.std(axis=0) + 1e-6
    x, y = (pooled - mean) / spread, good.astype(float)
    own = np.flatnonzero(~calibrate)
    weights = [rng.standard_normal((x.shape[1], HIDDEN)) / math.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / math.sqrt(HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(own)
        for at in range(0, len(order), 128):
            rows = order[at : at + 128]
            inner = np.tanh(x[rows] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-(inner @ weights[2] + weights[3]))) - y[rows]) / len(rows)
            back = error[:, None] * weights[2] * (1 - inner**2)
            slopes = [x[rows].T @ back + 1e-4 * weights[0], back.sum(axis=0), inner.T @ error + 1e-4 * weights[2], np.array([error.sum()])]
            step += 1
            for i, slope in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope**2
                weights[i] = weights[i] - 0.004 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    held = np.flatnonzero(calibrate) if calibrate.any() else own
    raw = np.tanh(x[held] @ weights[0] + weights[1]) @ weights[2] + weights[3]
    tried = np.exp(np.linspace(math.log(0.2), math.log(8), 60))
    losses = [np.logaddexp(0, np.where(y[held] == 1, -raw, raw) / t).mean() for t in tried]
    return mean, spread, weights[0], weights[1], weights[2], float(weights[3][0]), float(tried[int(np.argmin(losses))])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, size: int = UNITS, seed: int = 11) -> Model:
    """A model from a bounded draw of labelled rows; what comes back to the driver is ``rows`` pooled vectors and ``size`` word vectors."""
    sample = fit_rows(docs, labels, rows, seed).persist()
    try:
        vectors = context_vectors(sample, vocabulary(sample, size))
        sent = docs.sparkSession.sparkContext.broadcast(vectors)

        def make():
            known = sent.value
            return lambda columns: {"doc_id": columns["doc_id"], "good": columns["good"], "pooled": [pool(t, known).tolist() for t in columns["text"]]}

        got = map_rows(sample, make, "doc_id long, good int, pooled array<double>").toArrow().sort_by("doc_id")
        sent.destroy()
    finally:
        sample.unpersist()
    width = DIMENSIONS + 1
    good = got.column("good").to_numpy().astype(int)
    if len(set(good)) < 2:  # nothing to tell apart: the share of good rows, or a half
        share = float(good.mean()) if len(good) else 0.5
        share = min(max(share, 0.001), 0.999)
        return Model(vectors, np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), math.log(share / (1 - share)), 1.0)
    pooled = got.column("pooled").combine_chunks().flatten().to_numpy().reshape(-1, width)
    calibrate = np.array([zlib.crc32(b"calibrate%d" % d) % 5 == 0 for d in got.column("doc_id").to_pylist()])
    return Model(vectors, *train(pooled, good, calibrate))


def score_documents(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep`` and ``name``: the chance that a document is good, of its whole text alone.

    A null or empty text has the score of a text without words. Equal texts have equal scores. Other columns are not read.
    """
    types = dict(docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # UNITS vectors at most
    kept = [f"k{i}" for i in range(len(keep))]  # names of their own, whatever the columns are called

    def make():
        known = Model(**sent.value)

        def work(columns):
            scores = known.score(np.array([pool(t, known.vectors) for t in columns["text"]]))
            return {k: columns[k] for k in kept} | {"score": scores.tolist()}

        return work

    rows = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(kept, keep)], F.col("text").alias("text"))
    made = map_rows(rows, make, ", ".join([*(f"{k} {types[c]}" for k, c in zip(kept, keep)), "score double"]))
    return made.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], F.col("score").alias(name))
