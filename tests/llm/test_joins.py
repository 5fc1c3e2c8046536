"""Near vectors and the shingle join against brute force."""

import random

import numpy as np
import pytest
from helpers import awkward, brute_components, documents, prose, rows_of, shingle_set
from pyspark.sql import functions as F

from ledgerlight.llm import pstable, shingle_join


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("own") for c in ("n", "id", "v", "class", "keys")})


def brute_vectors(rows):
    sound = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v, dtype=np.float32).astype(float)
            sound[i] = u / np.linalg.norm(u)
    links = {i: {j for j in sound if j != i and len(sound[j]) == len(sound[i]) and sound[i] @ sound[j] >= 0.95} for i in sound}
    least = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least[i] = min(seen)
    return {i: (len(links.get(i, ())), least[i], least[i] == i) for i, _ in rows}


@pytest.mark.parametrize("tile", [6, 2048])
def test_near_vectors_against_brute_force(spark, tile):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(60)]
    for i in range(20):  # chains and groups around some of them
        for k in range(rng.integers(1, 5)):
            rows.append((1000 + 10 * i + int(k), (np.array(rows[-1 if k else i][1]) + 0.18 * rng.standard_normal(16)).tolist()))
    rows += [(3000 + i, (np.array(rows[0][1]) + 0.1 * rng.standard_normal(16)).tolist()) for i in range(40)]
    rows += [(5000, rows[3][1]), (5001, rows[3][1]), (5002, [2 * x for x in rows[3][1]])]
    rows += [(6000, None), (6001, []), (6002, [0.0] * 16), (6003, [None] + [1.0] * 15), (6004, [float("nan")] + [1.0] * 15), (6005, [float("inf")] * 16), (6006, [0.0] * 16), (6007, [1.0, 2.0]), (6008, [1.0, 2.01])]
    made = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pstable.near_vectors(vectors(spark, rows), recall=0.9999, tile=tile).collect()}
    assert made == brute_vectors(rows)


def test_near_vectors_of_odd_tables(spark):
    assert pstable.near_vectors(vectors(spark, [])).collect() == []
    made = pstable.near_vectors(vectors(spark, [(1, None), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0])])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in made) == [(0, 2, 7), (1, 0, 1), (7, 2, 7), (7, 2, 7)]


def test_near_vectors_of_doubles(spark):
    rows = [(1, [1e300, 2e300]), (2, [2e-300, 4e-300]), (3, [1.0, -2.0]), (4, [1.0, 2.0]), (5, [2.0, 4.0]), (6, [float("inf"), 1.0]), (7, None), (8, [1.0, 2.0])]
    made = pstable.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.9999).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in made) == [
        (1, 4, 1, True), (2, 4, 1, False), (3, 0, 3, True), (4, 4, 1, False), (5, 4, 1, False), (6, 0, 6, True), (7, 0, 7, True), (8, 4, 1, False)]


def test_near_vectors_without_ids_link(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (None, [1.0, 0.01, 0.0]), (None, [0.0, 1.0, 0.0]), (None, [0.0, 1.0, 0.01]), (None, [0.0, 0.0, 1.0]), (None, None)]
    made = pstable.near_vectors(vectors(spark, rows), recall=0.9999).collect()
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in made), key=repr)
    assert found == sorted([(5, 1, 5, True), (None, 1, 5, False), (None, 1, None, False), (None, 1, None, False), (None, 0, None, False), (None, 0, None, False)], key=repr)


def edited(text, rnd, share):
    words = text.split(" ")
    for i in range(len(words)):
        if rnd.random() < share:
            words[i] = f"w{rnd.randint(0, 10**6)}"
    return " ".join(words)


def corpus(seed):
    rnd = random.Random(seed)
    shared = prose(999, 40)
    texts = []
    for i in range(25):
        text = prose(seed * 100 + i, rnd.choice([3, 5, 8, 30, 120, 300])).replace("\n", " ")
        texts.append(text)
        for _ in range(rnd.randint(0, 4)):
            texts.append(edited(texts[-1] if rnd.random() < 0.5 else text, rnd, rnd.choice([0, 0.01, 0.03, 0.06])))
        if i % 3 == 0:
            texts.append(text.upper() + ("" if i % 2 else "\n" + shared))
            texts.append(shared + " " + prose(seed * 777 + i, 60))
    return texts + awkward()


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    texts = corpus(seed)
    sets = [shingle_set(t) for t in texts]
    made = {r.doc_id: r for r in shingle_join.near_documents(documents(spark, rows_of(texts), clashes=True)).collect()}
    assert {i: made[i].n_shingles for i in made} == {i: len(s) for i, s in enumerate(sets)}
    assert {i: made[i].component_id for i in made} == brute_components(sets)


def test_a_likely_group_that_falls_apart(spark, monkeypatch):
    """With bounds that let every pair of equal band pass, failed checks must lead to the pairs inside the group."""
    monkeypatch.setattr(shingle_join, "may_link", lambda n, m, one, two: np.ones(np.broadcast(n, m).shape, dtype=bool))
    texts = corpus(4)
    made = {r.doc_id: r.component_id for r in shingle_join.near_documents(documents(spark, rows_of(texts))).collect()}
    assert made == brute_components([shingle_set(t) for t in texts])


def test_frequent_shingles_change_nothing(spark):
    shared = prose(1, 60).replace("\n", " ")
    texts = [f"{shared} {prose(i + 10, 9)}" for i in range(60)] + [prose(i, 50) for i in range(200, 240)] + [shared + " end", shared + " fin"]
    made = {r.doc_id: r.component_id for r in shingle_join.near_documents(documents(spark, rows_of(texts))).collect()}
    assert made == brute_components([shingle_set(t) for t in texts])


def test_one_of_each_group_stays(spark):
    text = prose(5, 100)
    rows = [(4, text, "en", "s", 1), (2, text + " more", "en", "s", 1), (2, text + " more", "en", "s", 1), (None, text.upper(), "en", "s", 1), (9, None, "en", "s", None), (9, None, "en", "s", None), (8, "", "en", "s", 0), (7, prose(6, 100), "en", "s", 1), (7, prose(7, 100), "en", "s", 1)]
    out = shingle_join.one_of_each(documents(spark, rows, clashes=True))
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and out.first()["node"] == "own node"
    assert sorted((r.doc_id or -1) for r in out.collect()) == [2, 7, 7, 8, 9, 9]
    assert shingle_join.one_of_each(documents(spark, [])).collect() == []
    nulls = {r.doc_id: r.component_id for r in shingle_join.near_documents(documents(spark, [(None, text, None, None, None), (None, "a b", None, None, None), (3, text, None, None, None)])).collect()}
    assert nulls == {None: None, 3: 3} or nulls[3] == 3


def test_may_link_never_refuses_a_link():
    rnd = random.Random(9)
    for _ in range(300):
        a = {rnd.getrandbits(64) for _ in range(rnd.randint(1, 400))}
        b = set(rnd.sample(sorted(a), max(1, int(len(a) * rnd.uniform(0.75, 1))))) | {rnd.getrandbits(64) for _ in range(rnd.randint(0, len(a) // 5))}
        one, two = (np.frombuffer(shingle_join.bitmap(np.array(sorted(s), dtype=np.uint64)), dtype=np.uint64) for s in (a, b))
        width = min(len(one), len(two))
        one, two = shingle_join.folded(one, width), shingle_join.folded(two, width)
        if 100 * len(a & b) >= 80 * len(a | b):
            assert shingle_join.may_link(np.array(len(a)), np.array(len(b)), one, two)
