"""Sharding, fingerprints, line runs, mixing and dialogue perspectives against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import SCHEMA, WORD, awkward, brute_line_runs, documents, prose, rows_of
from pyspark.sql import functions as F

from ledgerlight.llm import chat, line_runs, mixing, sharding, simhash
from ledgerlight.llm.common import components, order_bounds, order_bucket


def test_shards_are_even_and_hold_the_mixture(spark):
    rows = [(i, f"text {i}", "en", "hot" if i % 3 == 0 else f"s{i % 7}", 0) for i in range(700)]
    made = sharding.interleave(documents(spark, rows, clashes=True), 8, rows_per_bucket=40).collect()
    assert len(made) == 700
    by = defaultdict(list)
    for r in made:
        by[r.shard].append(r)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    source = {i: s for i, _, _, s, _ in rows}
    for shard in by.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
        assert abs(sum(source[r.doc_id] == "hot" for r in shard) - len(shard) * 234 / 700) < 3
    one = next(r for r in made if r.doc_id == 5)
    assert (one.size, one.text_crc32, one.law, one.grown_shard) == (6 + 16, zlib.crc32(b"text 5"), "rows", None)


def test_shards_of_awkward_rows(spark):
    rows = [*rows_of(awkward()), (3, "word", None, "a", None), (None, "no id", None, None, None), (None, None, None, None, None)]
    made = sharding.interleave(documents(spark, rows), 4).collect()
    assert len(made) == len(rows) and {r.shard for r in made} == {0, 1, 2, 3}
    assert [(r.size, r.text_crc32) for r in made if r.doc_id == 0] == [(16, 0)]
    assert sharding.interleave(documents(spark, []), 4).collect() == []


def test_edited_texts_and_prints(spark):
    texts = [prose(i, 60) for i in range(9)] + awkward() + [prose(3, 60)]
    rows = rows_of(texts)
    made = {r.doc_id: r for r in simhash.edited_prints(documents(spark, rows, clashes=True), rows_per_bucket=4).collect()}
    assert len(made) == len(rows)
    plain = [t or "" for t in texts]
    for i, text in enumerate(plain):
        after, cut = plain[(i + 1) % len(plain)], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert made[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and made[i].n_chars == len(text)
        assert made[i].next_print == made[(i + 1) % len(plain)].print
    assert made[3].print == made[len(texts) - 1].print and made[0].print != made[1].print
    assert made[9].print == made[10].print == 0
    near = lambda a, b: 1 - bin((a ^ b) & (2**64 - 1)).count("1") / 64
    assert all(near(made[i].print, made[i].edited_print) > near(made[i].print, made[i].next_print) for i in range(8))
    assert simhash.edited_prints(documents(spark, [])).collect() == []
    single = simhash.edited_prints(documents(spark, [(7, "abcdefgh", None, None, None)])).collect()
    assert single[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_near_prints_finds_all(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(30)]
    prints = {simhash.signed(b) for b in base}
    for b in base:
        for _ in range(4):
            for bit in rnd.sample(range(64), rnd.randint(1, 5)):
                b ^= 1 << bit
            prints.add(simhash.signed(b))
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "print long")
    found = simhash.near_prints(df.where("print % 2 = 0"), df).collect()
    brute = {(a, b) for a in prints if a % 2 == 0 for b in prints if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert len(found) == len(brute) and {(r.print, r.near) for r in found} == brute


@pytest.mark.parametrize("seed", range(3))
def test_line_runs_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    pool = [prose(100 + i, rnd.choice([1, 3, 8, 20]), 50).replace("\n", " ") for i in range(12)] + [""]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 14))), "en", "s", 0) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", None, None, None), (102, "\n".join([pool[0]] * 200), None, None, None), (103, "\n" * 300 + pool[1], None, None, None)]
    made = {r.row.doc_id: r for r in line_runs.drop_repeated_runs(documents(spark, rows, clashes=True), 20).collect()}
    for i, (text, lines, dropped) in brute_line_runs(rows, 20).items():
        r = made[rows[i][0]]
        assert (r.text, r.n_lines, r.n_dropped) == (text, lines, dropped)
    assert made[100].text is None and made[101].text == ""


def test_line_runs_of_repeated_rows_and_null_ids(spark):
    text = prose(1, 120)
    rows = [(1, text, "en", "s", 0), (1, text, "en", "s", 0), (2, text, "en", "s", 0), (None, text, "en", "s", 0), (None, None, None, None, None)]
    made = sorted(((r.row.doc_id or 99, r.n_dropped, r.text) for r in line_runs.drop_repeated_runs(documents(spark, rows)).collect()), key=str)
    assert made == [(1, 0, text), (1, 0, text), (2, 10, ""), (99, 0, None), (99, 10, "")]
    assert line_runs.drop_repeated_runs(documents(spark, [])).collect() == []


def water_level(sizes, weights, share=1.5):
    targets, left, open_ = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set(sizes)
    while open_ and left > 1e-9:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if targets[s] + left * weights[s] / total >= 2 * sizes[s] - 1e-12}
        if not over:
            for s in open_:
                targets[s] += left * weights[s] / total
            break
        level = {s: targets[s] + left * weights[s] / total for s in open_}
        left = sum(level[s] - 2 * sizes[s] for s in over)
        for s in open_:
            targets[s] = 2.0 * sizes[s] if s in over else level[s]
        open_ -= over
    return targets


def test_mix_targets_and_takes(spark):
    rnd = random.Random(5)
    rows = [(i, prose(i, rnd.randint(0, 60)), "en", rnd.choice(["hot"] * 6 + ["a", "b", "c", "ü", "Z", None]), 0) for i in range(300)]
    rows += [(1000 + i, t, None, "odd", None) for i, t in enumerate(awkward())]
    made = mixing.mix(documents(spark, rows, clashes=True), rows_per_bucket=30).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    sizes = Counter()
    for i in size:
        sizes[source[i]] += size[i]
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    targets = water_level(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    taken = Counter()
    for r in made:
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 2 * r.size
        assert math.isclose(r.target, targets[source[r.doc_id]], rel_tol=1e-9)
        assert r.copies == 0 or 0 <= r.first_at <= 1
        taken[source[r.doc_id]] += r.taken
    assert all(taken[s] == math.floor(targets[s] + 1e-9) for s in sizes)
    assert mixing.mix(documents(spark, [])).collect() == []
    again = mixing.mix(documents(spark, rows[::-1]), rows_per_bucket=7).collect()
    assert {(r.doc_id, r.taken, r.first_at) for r in made} == {(r.doc_id, r.taken, r.first_at) for r in again}


def test_training_time_inverts_the_schedule(spark):
    df = spark.range(101).select((F.col("id") / 100).alias("u"))
    for k, knots in enumerate(mixing.SCHEDULES):
        got = [r.t for r in df.select(mixing.training_time(F.col("u"), F.lit(k)).alias("t")).collect()]
        weight = lambda t: next(w0 + (w1 - w0) * (t - t0) / (t1 - t0) for (t0, w0), (t1, w1) in zip(knots, knots[1:]) if t <= t1)  # noqa: B023, E731
        grid = [weight((i + 0.5) / 5000) for i in range(5000)]
        for u, t in zip(range(101), got):
            assert abs(sum(grid[: round(t * 5000)]) / sum(grid) - u / 100) < 1e-3


def test_training_stream_repeats_and_cuts(spark):
    rows = [(i, f"\n a{i}  b\tc d\ne ", "en", "s" if i < 6 else "t", 14) for i in range(10)] + [(1, "\n a1  b\tc d\ne ", "en", "s", 14)]
    docs = documents(spark, rows, clashes=True)
    out = mixing.training_stream(docs).collect()
    words = Counter()
    for r in out:
        words[r.source] += len(WORD.findall(r.text))
        full = f"\n a{r.doc_id}  b\tc d\ne "
        assert full.startswith(r.text) and (r.text == full or r.n_chars == len(r.text)) and r.shard == "own shard"
    expected = {r.source: r.target for r in mixing.mix(docs, carry=True).select("row.source", "target").collect()}
    assert all(words[s] == math.floor(expected[s]) for s in expected)
    assert mixing.training_stream(documents(spark, [])).collect() == []


def test_perspectives(spark):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "ann", "hi"), (1, 2, "bob", "yo é"), (1, 3, "cy", ""), (1, 4, "ann", None), (2, None, None, "late"), (2, 0, "ann", "x"), (3, 0, "system", "alone"), (None, 0, "ann", "y"), (None, 0, "ann", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("start", F.lit("own"))
    made = chat.perspective_segments(df, block_turns=2).collect()
    texts = defaultdict(str)
    for r in sorted(made, key=lambda r: (str(r.conv_id), r.perspective, r.place)):
        key = (r.conv_id, r.perspective)
        assert r.start == len(texts[key])
        texts[key] += r.segment
        assert r.stop == len(texts[key])
        if r.train_start is not None:
            assert r.speaker == r.perspective and texts[key][r.train_start : r.train_stop].endswith("<|im_end|>")
    assert set(texts) == {(1, "ann"), (1, "bob"), (1, "cy"), (2, "ann"), (2, "unknown"), (None, "ann")}
    assert texts[1, "bob"] == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\nyo é<|im_end|>\n"
        "<|im_start|>user name=cy\n<|im_end|>\n<|im_start|>user name=ann\n<|im_end|>\n"
    )
    assert texts[2, "unknown"].endswith("<|im_start|>assistant\nlate<|im_end|>\n")
    segments = chat.perspective_segments(df)
    whole = {(r.conv_id, r.perspective): r for r in chat.render(segments).collect()}
    assert whole[1, "bob"].text == texts[1, "bob"]
    assert [whole[1, "bob"].text[s.start : s.stop] for s in whole[1, "bob"].spans] == ["yo é<|im_end|>"]
    parts = sorted((r for r in chat.render(segments, 40).collect() if (r.conv_id, r.perspective) == (1, "bob")), key=lambda r: r.window)
    assert len(parts) > 1 and "".join(p.text for p in parts) == texts[1, "bob"]
    assert chat.perspective_segments(df.limit(0)).collect() == []


def test_components_of_paths_and_stars(spark):
    rnd = random.Random(2)
    names = rnd.sample(range(-500, 500), 300)
    edges = list(zip(names[:100], names[1:101])) + [(names[150], n) for n in names[151:200]] + [(names[200], names[200])]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[n] for n in names[:101]} == {min(names[:101])} and {got[n] for n in names[150:200]} == {min(names[150:200])}
    assert len(got) == 151
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_order_buckets_follow_the_order(spark):
    df = spark.createDataFrame([(v,) for v in [*range(50), 10**15, None, *range(-20, 0)]], "v long")
    bounds = order_bounds(df, "v", 6, 100)
    rows = df.select("v", order_bucket(F.col("v"), bounds).alias("b")).collect()
    for r in rows:
        assert r.b == (len(bounds) + 1 if r.v is None else sum(b <= r.v for b in bounds))
    assert SCHEMA is not None
