"""Personal data: overlapping candidates from broad generators, boosted trees, calibrated thresholds."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.arrow import drop_kept, map_rows
from ledgerlight.llm.common import order_bounds, order_bucket, running
from ledgerlight.session import cut_lineage, remove_tables

# The base patterns of the four kinds, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),  # a start inside a run of digits never matches where its first digit didn't
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = "0123456789"
#: Broad generators. They overlap each other and the base patterns; the trees decide.
BROAD = {
    "ip": [re.compile(r"[0-9]{1,3}(?:[ ]?(?:\.|\[\.\]|\(\.\))[ ]?[0-9]{1,3}){3}")],
    "card": [re.compile(r"[0-9]{4}(?:[\x20._-]{0,2}[0-9]{2,6}){2,5}")],
    "phone": [re.compile(r"(?:(?:\+|00)\x20?)?\(?[0-9]{1,4}\)?(?:[\x20./-]{0,2}\(?[0-9]{2,4}\)?){2,5}")],
}
AT = re.compile(r"@|\(at\)|\[at\]|\{at\}| at ", re.I)
ADDRESS = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63}){1,8}"
    r"|[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63}){1,8}", re.I
)
PRECISION = 0.98
TREES, DEPTH, RATE = 40, 3, 0.2
#: Cuts of a feature, at most, and a side that none of them reaches.
CUTS, NEVER = 32, 255
#: Slopes and bends are added as whole numbers of this share of one, so that sums don't depend on the order of rows.
UNIT = 2**24
#: Different examples of a task, about; trees after which the examples' sums are written anew.
TASK_ROWS, CARRY = 500_000, 8
#: Different examples that a task holds before it hands them on; numbers that :func:`features` gives.
HELD, FEATURES = 20_000, 26


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(found: str) -> str:
    return "".join([c for c in found if "0" <= c <= "9"])


def sound(kind: str, found: str) -> bool:
    """What a base match must meet beyond its pattern."""
    if kind == "ip":
        return all([len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split(".")])
    if kind == "card":
        digits = digits_of(found)
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits_of(found)) <= 15
    return True


def addresses(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses, sought from each @ outwards so that long runs are read once."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches per kind that pass; a match that fails is dropped and not tried again."""
    numbers = any([d in text for d in DIGITS])
    spans = {k: [m.span() for m in p.finditer(text) if sound(k, m.group())] if numbers else [] for k, p in BASE.items()}
    return {"email": addresses(text), **spans}


class Taken:
    """Marks of the places that spans cover."""

    def __init__(self, size: int, spans):
        self.marks = bytearray(size)
        for a, b in spans:
            self.add(a, b)

    def add(self, a: int, b: int) -> None:
        self.marks[a:b] = b"\x01" * (b - a)

    def meets(self, a: int, b: int) -> bool:
        return self.marks.find(1, a, b) >= 0


def plain(kind: str, found: str) -> str:
    """The candidate with spelt-out or spaced separators put back, so that features see one form."""
    if kind == "email":
        found = re.sub(r" ?(?:@|\(at\)|\[at\]|\{at\}| at ) ?", "@", found, count=1, flags=re.I)
        return re.sub(r" ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?", ".", found, flags=re.I)
    if kind == "ip":
        return re.sub(r" ?(?:\[\.\]|\(\.\)|\.) ?", ".", found)
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of all broad matches; they may overlap."""
    found = []
    if " dot " in text or any([c in text for c in "@)]}"]):
        for sign in AT.finditer(text):
            if sign.group() != " at " or " dot " in text[sign.end() : sign.end() + 70]:
                left = max(0, sign.start() - 66)
                for m in ADDRESS.finditer(text[left : sign.end() + 300]):
                    if left + m.start() < sign.start() and left + m.end() > sign.end():
                        found.append(("email", left + m.start(), left + m.end()))
    if any([d in text for d in DIGITS]):
        found += [(kind, *m.span()) for kind in ("ip", "card", "phone") for p in BROAD[kind] for m in p.finditer(text)]
    return list(dict.fromkeys(found))


def features(kind: str, text: str, start: int, stop: int) -> list[float]:
    """Format of the candidate and of what stands around it; no feature is a kind's base rule itself."""
    raw = text[start:stop]
    found = plain(kind, raw)
    digits = digits_of(found)
    before, after = text[max(0, start - 24) : start], text[stop : stop + 12]
    parts = [p for p in re.split(r"[^0-9A-Za-z]+", found) if p]
    numbers = [int(p) for p in parts if p.isascii() and p.isdigit() and len(p) < 6]
    tail = found.rsplit(".", 1)[-1]
    return [
        float(KINDS.index(kind)), float(len(found)), float(len(digits)), float(len(parts)),
        float(max(map(len, parts), default=0)), float(min(map(len, parts), default=0)), float(max(numbers, default=0)),
        float(luhn(digits)) if 12 <= len(digits) <= 19 else -1.0, float(sum(c.isalpha() for c in found)),
        float(found.count("@")), float(found.count(".")), float(found.count("-")), float(found.count(" ")), float("(" in found),
        float(len(tail)) if kind == "email" else -1.0, float(raw != found), float(raw[:1] == "+" or before[-1:] == "+"),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in ".-_=\"'#"), float(after[:1] in ".-_=\"'#"),
        float(bool(re.search(r"(?i)phone|tel|call|fax|mobile", before))), float(bool(re.search(r"(?i)mail|contact|write", before))),
        float(bool(re.search(r"(?i)card|visa|master|credit|pay", before))), float(bool(re.search(r"(?i)ip|host|addr|server", before))),
        float(bool(re.search(r"(?i)version|v\.?$|token|id|hash|order|isbn|serial", before))),
    ]


def spelt(kind: str, found: str, turn: int) -> str:
    """One of the other ways to write a base match; the trees learn from these as well."""
    if kind == "email":
        name, host = found.split("@")
        dots = host.split(".")
        return [found, f"{name} at {' dot '.join(dots)}", f"{name} (at) {'[dot]'.join(dots)}", f"{name}[at]{host}"][turn % 4]
    if kind == "ip":
        return [found, found.replace(".", "[.]"), found.replace(".", " . ")][turn % 3]
    if kind == "card":
        return [found, "-".join(re.findall("....?", digits_of(found))), " ".join(re.findall("....?", digits_of(found)))][turn % 3]
    return [found, found.replace("+", "00", 1), re.sub(r"[().]", "", found), re.sub(r"[ ()-]+", ".", found)][turn % 4]


def spoilt(kind: str, found: str) -> str:
    """A look-alike that is no personal data: a number that breaks its kind's inner rule, or a host alone."""
    if kind == "card":
        return found[:-1] + str((int(found[-1]) + 1) % 10)
    if kind == "ip":
        return re.sub(r"^[0-9]+", "731", found)
    return found.split("@", 1)[-1] if kind == "email" else digits_of(found)[:7]


def examples(text: str, turn: int) -> list[tuple[list[float], int]]:
    """Labelled candidates of one text: those that a base span covers and reads alike are 1, the others 0.

    Each base span is also written another way, and spoilt, in its own surroundings, and the candidates on that spot labelled likewise.
    """
    spans = base_spans(text)
    exact = {(kind, *s) for kind, those in spans.items() for s in those}
    touched = Taken(len(text), [s for those in spans.values() for s in those])
    rows = []
    for kind, start, stop in candidates(text):
        if (kind, start, stop) in exact:
            rows.append((features(kind, text, start, stop), 1))
        elif not touched.meets(start, stop):
            rows.append((features(kind, text, start, stop), 0))
    for kind, start, stop in exact:
        for form, label in ((spelt(kind, text[start:stop], turn), 1), (spoilt(kind, text[start:stop]), 0)):
            near = text[max(0, start - 40) : start]
            changed = near + form + text[stop : stop + 40]
            for k, a, b in candidates(changed):
                if a < len(near) + len(form) and b > len(near):
                    whole = k == kind and a == len(near) and b == len(near) + len(form)
                    rows.append((features(k, changed, a, b), int(label and whole)))
    return rows


@dataclass
class Trees:
    """Boosted regression trees as arrays: feature, cut and leaf values by heap position."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float
    thresholds: dict[str, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for t in range(len(self.leaf)):
            at = np.zeros(len(x), dtype=int)
            for _ in range(DEPTH):
                f = self.feature[t, at]
                at = 2 * at + 1 + (x[np.arange(len(x)), f] > self.cut[t, at])
            total += self.leaf[t, at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def cuts_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The cuts of a feature from its ascending values and their counts: what numpy's quantiles of the repeated values are."""
    ends = np.cumsum(counts)
    at = (ends[-1] - 1) * np.linspace(0, 1, CUTS + 1)
    low = np.floor(at).astype(np.int64)
    a, b = (values[np.searchsorted(ends, np.minimum(i, ends[-1] - 1), side="right")].astype(float) for i in (low, low + 1))
    return np.unique(np.where(at - low < 0.5, a + (b - a) * (at - low), b - (b - a) * (1 - (at - low))))[:-1]


def sides(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """How many cuts of its feature are below each value; a value above cut c has a side > its index."""
    return np.stack([np.searchsorted(those, x[:, f], side="left") for f, those in enumerate(cuts)], axis=1).astype(np.uint8)


def down(side: np.ndarray, feature: np.ndarray, split: np.ndarray, depth: int) -> np.ndarray:
    """The heap position that each row reaches after ``depth`` splits of one tree."""
    at = np.zeros(len(side), dtype=int)
    for _ in range(depth):
        at = 2 * at + 1 + (side[np.arange(len(side)), feature[at]] > split[at])
    return at


def added(raw: np.ndarray, side: np.ndarray, feature: np.ndarray, split: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    for f, s, values in zip(feature, split, leaf):
        raw = raw + values[down(side, f, s, DEPTH) - (2**DEPTH - 1)]
    return raw


def level_sums(side: np.ndarray, n: np.ndarray, good: np.ndarray, raw: np.ndarray, feature: np.ndarray, split: np.ndarray, depth: int) -> np.ndarray:
    """Whole sums of slope and bend by node of the level, feature and side; a row stands for ``n`` examples, ``good`` of them 1."""
    p = 1 / (1 + np.exp(-raw))
    width = side.shape[1] * (CUTS + 1)
    slots = (down(side, feature, split, depth) - (2**depth - 1))[:, None] * width + np.arange(0, width, CUTS + 1) + side
    both = np.rint(p * UNIT) * n - good * float(UNIT), np.rint(p * (1 - p) * UNIT) * n
    sums = [np.bincount(slots.ravel(), np.repeat(v, side.shape[1]), 2**depth * width) for v in both]
    return np.array(sums).astype(np.int64).reshape(2, 2**depth, side.shape[1], CUTS + 1)


def grow(cuts: list[np.ndarray], sums: Callable[..., np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient boosting on the log loss from the sums of each level: second-order gains over the cuts, all nodes of a level at once.

    ``sums(feature, split, leaf, t, depth)`` are the :func:`level_sums` of tree ``t`` over all examples.
    """
    inner = 2**DEPTH - 1
    feature, cut, leaf = np.zeros((TREES, inner), dtype=int), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    split = np.full((TREES, inner), NEVER)
    known = np.array([np.arange(CUTS) < len(those) for those in cuts])
    for t in range(TREES):
        for depth in range(DEPTH):
            for k, (g, h) in enumerate(zip(*sums(feature, split, leaf, t, depth) / UNIT)):
                node, (g_all, h_all) = 2**depth - 1 + k, (g[0].sum(), h[0].sum())
                gs, hs = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
                gain = gs**2 / (hs + 1) + (g_all - gs) ** 2 / (h_all - hs + 1) - g_all**2 / (h_all + 1)
                f, c = divmod(int(np.where(known, gain, -np.inf).argmax()), CUTS)
                left = g_all, h_all
                if known[f, c] and gain[f, c] > 1e-6:
                    feature[t, node], split[t, node], cut[t, node], left = f, c, cuts[f][c], (gs[f, c], hs[f, c])
                if depth == DEPTH - 1:
                    leaf[t, 2 * k] = -RATE * left[0] / (left[1] + 1)
                    leaf[t, 2 * k + 1] = -RATE * (g_all - left[0]) / (h_all - left[1] + 1)
    return feature, cut, leaf


def first_guess(share: float) -> float:
    share = min(max(share, 0.01), 0.99)
    return float(np.log(share / (1 - share)))


def boost(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The trees of examples in memory: feature, cut and leaf values by heap position, and the start."""
    start = first_guess(y.mean())
    cuts = [cuts_of(*np.unique(x[:, f], return_counts=True)) for f in range(x.shape[1])]
    side, n = sides(x, cuts), np.ones(len(x))

    def sums(feature, split, leaf, t, depth):
        raw = added(np.full(len(x), start), side, feature[:t], split[:t], leaf[:t])
        return level_sums(side, n, y, raw, feature[t], split[t], depth)

    return *grow(cuts, sums), start


def matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """The rows of a binary column as rows of ``width`` numbers."""
    size = width * np.dtype(kind).itemsize
    fixed = column.cast(pa.binary(size))
    return np.frombuffer(fixed.buffers()[1], kind)[fixed.offset * width : (fixed.offset + len(fixed)) * width].reshape(-1, width)


def all_examples(docs: DataFrame) -> DataFrame:
    """(x, held, n, good): every different example of all documents, how often it comes, and how often as 1.

    ``x`` holds the features, which are whole numbers, as four bytes each. ``held`` is the id of a document that is kept for the
    thresholds, a fifth of all, and null for the others, whose examples are not told apart. A null id is replaced by the text's checksum.
    """

    def run(batches):
        drop_kept()
        tally: Counter = Counter()

        def handed():
            keys = [*{key[:2] for key in tally}]
            good, bad = ([tally[*key, y] for key in keys] for y in (1, 0))
            tally.clear()
            columns = [k[0] for k in keys], [k[1] for k in keys], [g + b for g, b in zip(good, bad)], good
            kinds = pa.binary(), pa.int64(), pa.int64(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["x", "held", "n", "good"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                doc, text = doc.as_py(), text.as_py() or ""
                if doc is None:
                    doc = zlib.crc32(text.encode("utf-8", "surrogatepass"))
                held = doc if zlib.crc32(b"threshold%d" % doc) % 5 == 0 else None
                for x, y in examples(text, doc):
                    tally[np.array(x, np.int32).tobytes(), held, y] += 1
                if len(tally) >= HELD:
                    yield handed()
        yield handed()

    made = docs.select("doc_id", "text").mapInArrow(run, "x binary, held long, n long, good long")
    return made.groupBy("x", "held").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))


def all_cuts(seen: DataFrame) -> list[np.ndarray]:
    """The cuts of every feature over all examples; what comes back is a row for each different value.

    The generators bound every feature by the length of a candidate, below a thousand, and the largest number in it, below 100 000.
    """

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, n = matrix(batch.column(0), np.int32, FEATURES), batch.column(1).to_numpy()
                for f in range(FEATURES):
                    values, at = np.unique(x[:, f], return_inverse=True)
                    counts = np.zeros(len(values), dtype=np.int64)
                    np.add.at(counts, at, n)
                    yield pa.RecordBatch.from_arrays([pa.array([f] * len(values), pa.int32()), pa.array(values), pa.array(counts)], names=["f", "v", "n"])

    got = seen.select("x", "n").mapInArrow(run, "f int, v int, n long").groupBy("f", "v").agg(F.sum("n").alias("n")).toArrow()
    got = got.sort_by([("f", "ascending"), ("v", "ascending")])
    f, v, n = (got.column(c).to_numpy() for c in ("f", "v", "n"))
    return [cuts_of(v[f == i], n[f == i]) for i in range(FEATURES)]


def boost_all(seen: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The trees of :func:`boost` over the examples of a table. Each level is one pass of it, and a task gives one row of sums.

    The passes read sides instead of values, equal ones in one row, and sums of trees that are written anew every ``CARRY`` trees.
    """
    n, good, rows = seen.agg(F.sum("n"), F.sum("good"), F.count("*")).first()
    start, cuts, parts = first_guess(good / n), all_cuts(seen), rows // TASK_ROWS + 1

    def cut_up(batches):
        for batch in batches:
            if batch.num_rows:
                side = sides(matrix(batch.column(0), np.int32, FEATURES), cuts)
                yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in side], pa.binary()), *batch.columns[1:]], names=["side", "n", "good"])

    made = seen.select("x", "n", "good").mapInArrow(cut_up, "side binary, n long, good long").groupBy("side").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    table, since = cut_lineage(made.withColumn("raw", F.lit(start)).coalesce(parts)), 0

    def sums(feature, split, leaf, t, depth):
        nonlocal table, since
        known = feature[since:t], split[since:t], leaf[since:t]
        if depth == 0 and t - since == CARRY:

            def carried(batches):
                for batch in batches:
                    if batch.num_rows:
                        raw = added(batch.column(3).to_numpy(), matrix(batch.column(0), np.uint8, FEATURES), *known)
                        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw)], names=["side", "n", "good", "raw"])

            older, table, since = table, cut_lineage(table.coalesce(parts).mapInArrow(carried, "side binary, n long, good long, raw double")), t
            remove_tables(older)
            known = feature[t:t], split[t:t], leaf[t:t]
        tree = feature[t], split[t]

        def run(batches):
            total = np.zeros((2, 2**depth, FEATURES, CUTS + 1), dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    side, (n, good, raw) = matrix(batch.column(0), np.uint8, FEATURES), (c.to_numpy() for c in batch.columns[1:])
                    total += level_sums(side, n, good, added(raw, side, *known), *tree, depth)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        got = table.coalesce(parts).mapInArrow(run, "sums binary").toArrow().column(0)  # a row for each task
        return sum(np.frombuffer(s.as_py(), np.int64) for s in got).reshape(2, 2**depth, FEATURES, CUTS + 1)

    grown = grow(cuts, sums)
    remove_tables(table)
    return *grown, start


def calibrated(seen: DataFrame, trees: Trees) -> dict[str, float]:
    """For each kind the least score from which on its held examples are right in ``PRECISION`` of cases, 2 (never) where there is none.

    Equal scores are read in the order of the documents: those before the equal ones are counted per score, the others inside it.
    """
    known = vars(trees)

    def run(batches):
        scorer = Trees(**known)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), np.int32, FEATURES)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(-scorer.score(x)), *batch.columns], names=["kind", "place", "x", "held", "n", "good"])

    made = seen.where("held IS NOT NULL").select("x", "held", "n", "good")
    scored = cut_lineage(made.mapInArrow(run, "kind int, place double, x binary, held long, n long, good long"))
    ties = scored.groupBy("kind", "place").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    ties = ties.withColumn("part", order_bucket(F.col("place"), order_bounds(ties, "place", TASK_ROWS, 1_000)))
    ahead = running(ties, ["kind"], "part", ["place"], {"n_ahead": "n", "good_ahead": "good"}).drop("part", "n", "good")
    placed = scored.withColumn("part", order_bucket(F.col("held"), order_bounds(scored, "held", TASK_ROWS, 1_000)))
    inside = running(placed, ["kind", "place"], "part", ["held", "x"], {"n_in": "n", "good_in": "good"})
    right = (F.col("good_ahead") + F.col("good_in") + F.col("good")) / (F.col("n_ahead") + F.col("n_in") + F.greatest("good", F.lit(1)))
    good = inside.join(ahead, ["kind", "place"]).where(right >= PRECISION).groupBy("kind").agg(F.max("place").alias("place"))
    least = {r["kind"]: -r["place"] for r in good.collect()}
    remove_tables(scored)
    return {kind: max(0.5, least[k]) if k in least else 2.0 for k, kind in enumerate(KINDS)}


def fit(docs: DataFrame) -> Trees:
    """Trees and a threshold for each kind, from all candidates of all documents.

    Base spans and what is made of them are the labels. A fifth of the documents is kept for the thresholds: the least
    score from which on the candidates of the kind are right in ``PRECISION`` of cases, 2 (never) where there is none.
    """
    seen = cut_lineage(all_examples(docs))
    n, good, taught = seen.agg(F.sum("n"), F.sum("good"), F.count_if(F.col("held").isNull())).first()
    if not good or good == n:
        inner = 2**DEPTH - 1
        trees = Trees(np.zeros((0, inner), dtype=int), np.zeros((0, inner)), np.zeros((0, inner + 1)), -20.0, dict.fromkeys(KINDS, 2.0))
    else:
        trees = Trees(*boost_all(seen.where("held IS NULL") if taught else seen), {})
        trees.thresholds = calibrated(seen, trees)
    remove_tables(seen)
    return trees


def all_spans(text: str, trees: Trees) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """The base spans by kind, and all spans: base ones and the best candidates that overlap none taken before."""
    base = base_spans(text)
    taken = Taken(len(text), [s for those in base.values() for s in those])
    found = [(kind, a, b) for kind in KINDS for a, b in base[kind]]
    fresh = [c for c in candidates(text) if not taken.meets(c[1], c[2])]
    if fresh:
        score = trees.score(np.array([features(k, text, a, b) for k, a, b in fresh]))
        for i in sorted(range(len(fresh)), key=lambda i: (-score[i], fresh[i])):
            kind, a, b = fresh[i]
            if score[i] >= trees.thresholds[kind] and not taken.meets(a, b):
                taken.add(a, b)
                found.append(fresh[i])
    return base, sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def find(docs: DataFrame, trees: Trees) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and digest are of the base spans; ``spans`` lists these and what the trees add, as kind:start:end by kind and
    start, in code points, end exclusive. Every row is by itself and read whole: a null or empty text has no spans,
    repeated rows have equal results, other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vars(trees))

    def make():
        known = Trees(**sent.value)

        def work(columns):
            out: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
            for text in columns["text"]:
                base, spans = all_spans(text or "", known)
                own = [(kind, a, b) for kind in KINDS for a, b in base[kind]]
                for kind in KINDS:
                    out[f"n_{kind}"].append(len(base[kind]))
                out["base_sha256"].append(hashlib.sha256(joined(own).encode()).hexdigest())
                out["spans"].append(joined(spans))
                out["n_added"].append(len(spans) - len(own))
            return out | {"doc_id": columns["doc_id"]}

        return work

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; null texts stay null, other columns as they are."""
    sent, names, types = docs.sparkSession.sparkContext.broadcast(vars(trees)), docs.columns, dict(docs.dtypes)

    def make():
        known = Trees(**sent.value)

        def clean(text):
            if text is None:
                return None
            out, at = [], 0
            for kind, a, b in sorted(all_spans(text, known)[1], key=lambda s: s[1:]):
                if b > at:
                    out += [text[at : max(a, at)], f"[{kind}]"]
                    at = b
            return "".join([*out, text[at:]])

        return lambda columns: columns | {"text": [clean(t) for t in columns["text"]]}

    return map_rows(docs, make, ", ".join(f"`{n}` {types[n]}" for n in names))
