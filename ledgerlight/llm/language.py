"""Language of texts by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import seeded_key
from ledgerlight.llm.quality import fold

#: Documents that the network is fitted on, at most: so many of a language, and of so many languages, the most frequent.
FIT_ROWS = 600
LANGUAGES = 64
#: Bytes of a fitted document, at most, from its middle; scoring reads whole texts.
FIT_BYTES = 1024
HIDDEN = 12
WIDTH = 8
#: Bytes that are labelled in one go, and those read before and after them to get the states going.
STRETCH = 256
LEAD = 8
#: Stretches in one matrix.
LANES = 1024
STEPS = 500
BATCH = 64

#: A byte that stands for nothing: before the start and after the end.
NOTHING = 0

Weights = dict[str, np.ndarray]


def inputs(text: str) -> np.ndarray:
    """The bytes of a text with A-Z lower-cased; zero bytes, which mean nothing here, become blanks."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    return np.where(raw == NOTHING, np.uint8(32), raw)


def start(languages: int, seed: int) -> Weights:
    """Random weights: bytes as vectors, and for each direction those of the two gates and of the candidate, over (state, byte's vector, 1)."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / math.sqrt(shape[1])).astype(np.float32)
    seen = HIDDEN + WIDTH + 1
    weights = {"bytes": draw(WIDTH, 256) * np.float32(8), "out": draw(languages, 2 * HIDDEN), "out_bias": np.zeros(languages, np.float32)}
    for side in ("ahead", "back"):
        weights |= {f"{side}_gates": draw(2 * HIDDEN, seen), f"{side}_new": draw(HIDDEN, seen)}
    return weights


def squash(x: np.ndarray) -> None:
    """The logistic function of 2 * x, in place, by the faster tanh."""
    np.tanh(x, out=x)
    x += 1
    x *= np.float32(0.5)


def unroll(codes: np.ndarray, vectors: np.ndarray, gates: np.ndarray, new: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States after every byte: codes is (steps, lanes), the result (steps, HIDDEN, lanes). With ``keep`` also all that the way back needs."""
    steps, lanes = codes.shape
    states = np.empty((steps, HIDDEN, lanes), dtype=np.float32)
    state, held = np.zeros((HIDDEN, lanes), dtype=np.float32), []
    seen = np.ones((HIDDEN + WIDTH + 1, lanes), dtype=np.float32)
    both, fresh = np.empty((2 * HIDDEN, lanes), dtype=np.float32), np.empty((HIDDEN, lanes), dtype=np.float32)
    for t in range(steps):
        seen[:HIDDEN] = state
        np.take(vectors, codes[t], axis=1, mode="clip", out=seen[HIDDEN:-1])
        first = seen.copy() if keep else seen
        np.matmul(gates, seen, out=both)
        squash(both)
        seen[:HIDDEN] *= both[HIDDEN:]  # the reset gate
        np.matmul(new, seen, out=fresh)
        np.tanh(fresh, out=fresh)
        if keep:
            held.append((first, both.copy(), seen.copy(), fresh.copy()))
        step = np.subtract(fresh, state, out=states[t])
        step *= both[:HIDDEN]  # the update gate
        step += state
        state = step
    return states, held


def through_time(slopes: np.ndarray, codes: np.ndarray, held: list, gates: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Backpropagation through time: slopes of the bytes' vectors, of the gates' and of the candidate's weights."""
    steps, lanes = codes.shape
    given = np.empty((WIDTH, steps, lanes), dtype=np.float32)
    d_gates, d_new = np.zeros_like(gates), np.zeros_like(new)
    carried = np.zeros_like(slopes[0])
    for t in range(steps - 1, -1, -1):
        first, both, second, fresh = held[t]
        state, update, reset = first[:HIDDEN], both[:HIDDEN], both[HIDDEN:]
        slope = slopes[t] + carried
        d_fresh = slope * update * (1 - fresh**2)
        d_new += d_fresh @ second.T
        d_second = new.T @ d_fresh
        d_mixed = d_second[:HIDDEN]
        d_both = np.concatenate([slope * (fresh - state), d_mixed * state]) * 2 * both * (1 - both)
        d_gates += d_both @ first.T
        d_first = gates.T @ d_both
        carried = slope * (1 - update) + d_mixed * reset + d_first[:HIDDEN]
        given[:, t] = d_second[HIDDEN:-1] + d_first[HIDDEN:-1]
    return given.reshape(WIDTH, -1) @ np.eye(256, dtype=np.float32)[codes.ravel()], d_gates, d_new


def chances(scores: np.ndarray) -> np.ndarray:
    """Of (steps, languages, lanes), in place."""
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def slopes_of(weights: Weights, codes: np.ndarray, truth: np.ndarray) -> tuple[float, Weights]:
    """Mean log loss over all bytes, each to be labelled with its text's language, and its slopes. codes is (steps, lanes)."""
    real = codes != NOTHING
    lines = {"ahead": codes, "back": codes[::-1]}
    ran = {s: unroll(c, weights["bytes"], weights[f"{s}_gates"], weights[f"{s}_new"], True) for s, c in lines.items()}
    both = np.concatenate([ran["ahead"][0], ran["back"][0][::-1]], axis=1)
    found = chances(weights["out"] @ both + weights["out_bias"][:, None])
    n = max(1, int(real.sum()))
    lanes = np.arange(len(truth))
    loss = float(-np.log(found[:, truth, lanes][real] + 1e-9).sum() / n)
    error = found
    error[:, truth, lanes] -= 1
    error *= (real / n)[:, None].astype(np.float32)
    slopes = {"out": np.tensordot(error, both, axes=([0, 2], [0, 2])), "out_bias": error.sum(axis=(0, 2)), "bytes": np.zeros_like(weights["bytes"])}
    down = weights["out"].T @ error
    for side, part in (("ahead", down[:, :HIDDEN]), ("back", down[::-1, HIDDEN:])):
        vectors, slopes[f"{side}_gates"], slopes[f"{side}_new"] = through_time(part, lines[side], ran[side][1], weights[f"{side}_gates"], weights[f"{side}_new"])
        slopes["bytes"] += vectors
    return loss, slopes


def train(texts: list[np.ndarray], truth: np.ndarray, languages: int, steps: int = STEPS, seed: int = 3) -> Weights:
    """Adam on batches of stretches, each drawn at random from a text of each language in turn."""
    rng = np.random.default_rng(seed)
    weights = start(languages, seed)
    first, second = ({k: np.zeros_like(w) for k, w in weights.items()} for _ in range(2))
    members = [np.flatnonzero(truth == i) for i in range(languages)]
    size = STRETCH // 4
    for step in range(1, steps + 1):
        drawn = np.array([rng.choice(members[i % languages]) for i in rng.permutation(max(BATCH, languages))])
        codes = np.full((size, len(drawn)), NOTHING, dtype=np.uint8)
        for lane, i in enumerate(drawn):
            least = rng.integers(4, size + 1)  # short texts are learnt as well
            at = rng.integers(0, max(1, len(texts[i]) - least + 1))
            cut = texts[i][at : at + least]
            codes[: len(cut), lane] = cut
        _, slopes = slopes_of(weights, codes, truth[drawn])
        norm = math.sqrt(sum(float((s**2).sum()) for s in slopes.values()))
        rate = 0.01 * (0.1 ** (step / steps))
        for k, slope in slopes.items():
            slope = slope * min(1.0, 1 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            weights[k] = weights[k] - np.float32(rate) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            weights[k] = weights[k].astype(np.float32)
    return weights


@dataclass
class Model:
    names: list[str]
    weights: Weights

    def label(self, codes: np.ndarray) -> np.ndarray:
        """(steps, languages, lanes): the chances of each language at each byte."""
        w = self.weights
        ahead, _ = unroll(codes, w["bytes"], w["ahead_gates"], w["ahead_new"], False)
        back, _ = unroll(codes[::-1], w["bytes"], w["back_gates"], w["back_new"], False)
        scores = w["out"][:, :HIDDEN] @ ahead
        scores += (w["out"][:, HIDDEN:] @ back)[::-1]
        scores += w["out_bias"][:, None]
        return chances(scores)

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """(texts, languages): the mean of the chances over the letters' bytes of each whole text; equal texts get equal ones.

        A text is cut into stretches, which are labelled side by side, each with a few bytes of its neighbours.
        """
        total = np.zeros((len(texts), len(self.names)))
        owners, rows, filled = [], np.full((LANES, STRETCH + 2 * LEAD), NOTHING, dtype=np.uint8), 0

        def add() -> None:
            codes = np.ascontiguousarray(rows[:filled].T).astype(np.intp)
            found = self.label(codes)[LEAD : LEAD + STRETCH]
            found *= LETTERS[codes[LEAD : LEAD + STRETCH]][:, None]
            np.add.at(total, np.array(owners), found.sum(axis=0, dtype=np.float64).T)

        for i, text in enumerate(texts):
            raw = inputs(text or "")
            for at in range(0, len(raw), STRETCH):
                rows[filled] = NOTHING
                begin = max(0, at - LEAD)
                cut = raw[begin : at + STRETCH + LEAD]
                rows[filled, LEAD - (at - begin) : LEAD - (at - begin) + len(cut)] = cut
                owners.append(i)
                filled += 1
                if filled == LANES:
                    add()
                    owners, filled = [], 0
        if filled:
            add()
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)


#: Bytes that letters are made of: a-z, and all of those beyond ASCII.
LETTERS = np.array([1.0 if 97 <= b <= 122 or b >= 128 else 0.0 for b in range(256)], dtype=np.float32)


def has_letter(text: F.Column) -> F.Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit_rows(docs: DataFrame, rows: int, languages: int, seed: int) -> DataFrame:
    """(lang, text): at most ``rows`` documents with letters of each of the ``languages`` most frequent languages, outside the held-out fold."""
    usable = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0) & has_letter(F.col("text")))
    keyed = usable.select("lang", "doc_id", seeded_key(seed, F.col("doc_id"), F.xxhash64("text")).alias("key"), F.expr(f"substring(text, greatest(1, cast((length(text) - {FIT_BYTES}) / 2 as int)), {FIT_BYTES})").alias("text"))
    names = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    drawn = keyed.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))).where(F.col("turn") <= rows)
    return drawn.join(F.broadcast(names), "lang").select("lang", "text", "key")


def fit(docs: DataFrame, rows: int = FIT_ROWS, languages: int = LANGUAGES, steps: int = STEPS, seed: int = 7) -> Model:
    """A network fitted on a bounded draw of documents, ``rows`` of a language; without any it knows no language.

    Only text and lang are learnt from; rows without lang or letters and those of the held-out fold are not used.
    """
    sample = sorted((r["lang"], r["key"], r["text"]) for r in fit_rows(docs, rows, languages, seed).toLocalIterator())
    names = sorted({lang for lang, _, _ in sample})
    if not names:
        return Model([], {})
    truth = np.array([names.index(lang) for lang, _, _ in sample])
    return Model(names, train([inputs(text) for _, _, text in sample], truth, len(names), steps))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, lang_pred, score and chances (by language, in order of name) of every document, of its whole text alone.

    lang_pred is the language of the highest mean chance over the text's letters, the first by name of equal ones, and score
    that chance. A null text, one without letters, and every text where no language was learnt is ``und`` with score 0 and no
    chances. Equal texts are labelled alike up to rounding. Other columns are not read.
    """
    types = dict(docs.dtypes)
    kept = [f"k{i}" for i in range(len(keep))]  # names of their own, whatever the columns are called
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # some ten thousand numbers
    names = [*kept, "lang_pred", "score", "chances"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(**sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                texts, lettered = rows.column("text").to_pylist(), rows.column("lettered").to_pylist()
                asked = [i for i, ok in enumerate(lettered) if ok and known.names]
                found = known.pooled([texts[i] for i in asked])
                best = {i: (known.names[int(row.argmax())], float(row.max()), row.tolist()) for i, row in zip(asked, found)}
                told = [best.get(i, ("und", 0.0, None)) for i in range(rows.num_rows)]
                columns = [rows.column(k) for k in kept]
                yield pa.RecordBatch.from_arrays([
                    *columns, pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64()), pa.array([t[2] for t in told], pa.list_(pa.float64())),
                ], names=names)

    rows = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(kept, keep)], F.col("text").alias("text"), has_letter(F.col("text")).alias("lettered"))
    made = rows.mapInArrow(run, ", ".join([*(f"{k} {types[c]}" for k, c in zip(kept, keep)), "lang_pred string, score double, chances array<double>"]))
    return made.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], "lang_pred", "score", "chances")
