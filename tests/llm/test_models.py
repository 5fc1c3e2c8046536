"""Quality classifier, BPE and personal data: held-out accuracy, the tokenizer library and brute force."""

import hashlib
import random
import re
import sys
import zlib

import numpy as np
import pytest
from helpers import awkward, documents, prose, rows_of
from pyspark.sql import functions as F

from ledgerlight.llm import bpe, pii, quality, queries
from ledgerlight.llm.arrow import map_rows

TEXTS = [
    "", "ΑΣ ΟΔΟΣ Σ", "<|endoftext|> hi<|startoftext|>x <|foo|> ", "é İstanbul ǅ ﬁ ß ẞ", "a b c\x1cd\x85e", "don't I'LL we've 12345 ½ ² Ⅷ",
    "日本語 テスト 🎉🎉👨‍👩‍👧", "a" * 3000, "\x00\x01 ﻿", "'s'S 'RE", "क्षि ẛ̣", "x_y__z --- ... a.b", " lead and trail \n", "<|endoftext|>" * 3,
]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    made = tokenizers.Tokenizer.from_file(queries.vocabulary())
    made.no_padding()
    made.no_truncation()
    return made


def test_codec_equals_the_library(library):
    coder = bpe.codec(queries.vocabulary())
    rnd = random.Random(8)
    letters = "abcdefgh éßΣσ'.,!0123²\n\t　<|>endoftx"
    texts = TEXTS + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids, text
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_memo_without_room_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    coder = bpe.codec(queries.vocabulary())
    text = prose(1, 100)
    assert coder.encode(text) == coder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_encoded_documents(spark, library):
    texts = [*TEXTS, *awkward()]
    docs = documents(spark, rows_of(texts), clashes=True)
    made = {r.doc_id: r for r in bpe.encode_documents(docs, queries.vocabulary(), texts=True).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert made[i].ids == ids and made[i].decoded == decoded and made[i].n_tokens == len(ids)
        assert made[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert made[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), queries.vocabulary()).collect() == []


def test_memos_hold_ids_alone_and_other_operators_free_them(spark):
    """Spark uses its Python workers again, so a later operator's tasks would run beside the vocabulary and memos."""
    coder = bpe.codec(queries.vocabulary())
    coder.ids(prose(2, 50))
    kept = [*coder.by_word.young.values(), *coder.by_piece.young.values()]
    assert kept and all(isinstance(found, str) and set(found) <= set("0123456789 ") for found in kept)

    docs = documents(spark, rows_of([prose(i, 30) for i in range(64)])).repartition(8)
    assert bpe.encode_documents(docs, queries.vocabulary()).count() == 64

    def make():
        return lambda columns: {"kept": ["_ledgerlight_kept" in sys.__dict__] * len(columns["text"])}

    seen = map_rows(docs.select("text"), make, "kept boolean").collect()
    assert len(seen) == 64 and not any(r.kept for r in seen)


def test_quality_on_held_out_rows(spark):
    """Invented texts: good prose, and two kinds of junk."""
    rows, marks = [], []
    for i in range(240):
        text = prose(i, 80)
        if i % 3 == 0:
            text = " ".join(f"{w}!!".upper() for w in text.split()) if i % 2 else " ".join([text.split()[0]] * 50)
        rows.append((i, text, "en", "s", len(text)))
        marks.append((i, int(i % 3 != 0), 0))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs = documents(spark, rows, clashes=True)
    model = quality.fit(docs, labels)
    made = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    held = [i for i in made if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 20 and np.mean([(made[i] >= 0.3) == (i % 3 != 0) for i in held]) > 0.9
    again = {r.doc_id: r.score for r in quality.score_documents(docs, quality.fit(docs.repartition(7), labels)).collect()}
    assert all(abs(made[i] - again[i]) < 1e-9 for i in made)
    flipped = spark.createDataFrame([(i, 1 - q if i in set(held) else q, t) for i, q, t in marks], "doc_id long, quality int, toxic int")
    other = {r.doc_id: r.score for r in quality.score_documents(docs, quality.fit(docs, flipped)).collect()}
    assert all(abs(made[i] - other[i]) < 1e-9 for i in made)  # held-out labels are never seen


def test_quality_of_awkward_rows(spark):
    docs = documents(spark, rows_of(awkward()), clashes=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 1, None), (4, 0, 0), (777, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        made = quality.score_documents(docs, quality.fit(docs, labels)).collect()
        assert len(made) == docs.count() and all(0 <= r.score <= 1 for r in made)
        scores = {r.doc_id: r.score for r in made}
        assert scores[0] == scores[1] and scores[5] == scores[6]
    assert quality.score_documents(docs.limit(0), quality.fit(docs, none)).collect() == []


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    spans = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            check = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            good = {"email": True, "ip": kind == "ip" and max(map(int, m.group().split("."))) <= 255, "card": 16 <= len(digits) <= 19 and check, "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                spans.append((kind, *m.span()))
    return spans


def flat(text):
    spans = pii.base_spans(text)
    return [(k, a, b) for k in pii.KINDS for a, b in spans[k]]


def test_base_spans_against_the_patterns():
    rnd = random.Random(1)
    bits = ["a", "b", "@", ".", "-", "_", "1", "2", "25", "+", " ", "(", ")", "300", "4111", "1111", "é", "@b.c", "4111 1111 1111 1111", "+1 (803) 555-5351"]
    for _ in range(20_000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))
        assert flat(text) == brute_base(text), text


def pii_corpus():
    rnd = random.Random(6)
    rows = []
    for i in range(480):
        words = prose(i, 40).split()
        if i % 2:
            words.insert(9, [f"jo{i}@mail{i}.example.com", f"10.{i % 256}.7.{rnd.randint(1, 250)}", "4111 1111 1111 1111", f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"][i // 2 % 4])
        else:
            words.insert(4, ["version 2.0", "999.3.2.1", "4111 1111 1111 1112", "page 1234567"][i // 2 % 4])
        rows.append((i, " ".join(words), "en", "s", 0))
    return rows


def test_found_spans(spark):
    rows = pii_corpus() + [(1000 + i, t, None, None, None) for i, t in enumerate([*awkward(), "kalo jo999 at mail5 dot example dot com ten", "1" * 50_000, "@" * 5000, "a" * 50_000])]
    docs = documents(spark, rows, clashes=True)
    trees = pii.fit(docs)
    made = {r.doc_id: r for r in pii.find(docs, trees).collect()}
    for i, text, *_ in rows:
        base = brute_base(text or "") if len(text or "") < 40_000 else []
        r = made[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(filter(None, pii.joined(base).split(","))) <= set(r.spans.split(","))
        if i < 1000:
            assert r.n_added == 0, (text, r.spans)
    assert made[1008].spans == "email:5:39"
    clean = {r.doc_id: r for r in pii.redact(docs, trees).collect()}
    assert "[email]" in clean[1].text and "@" not in clean[1].text and clean[1000].text is None and clean[0].text == rows[0][1]
    assert pii.find(docs.limit(0), pii.fit(docs.limit(0))).collect() == []
    bare = pii.fit(docs.where("doc_id >= 1000 AND doc_id < 1008"))
    assert all(r.n_added == 0 for r in pii.find(docs.where(F.col("doc_id") >= 1000), bare).collect())


def brute_trees(rows):
    """Trees and thresholds from the examples of all rows (doc_id, text) in memory."""
    made = []
    for doc, text, *_ in rows:
        doc = zlib.crc32((text or "").encode()) if doc is None else doc
        made += [(zlib.crc32(b"threshold%d" % doc) % 5 == 0, doc, x, y) for x, y in pii.examples(text or "", doc)]
    own = [(x, y) for aside, _, x, y in made if not aside]
    trees = pii.Trees(*pii.boost(np.array([x for x, _ in own]), np.array([y for _, y in own], dtype=float)), dict.fromkeys(pii.KINDS, 2.0))
    for k, kind in enumerate(pii.KINDS):
        held = [(doc, x, y) for aside, doc, x, y in made if aside and x[0] == k]
        score = trees.score(np.array([x for _, x, _ in held]))
        right = 0
        for n, (place, _, y) in enumerate(sorted((-s, doc, y) for s, (doc, _, y) in zip(score, held)), 1):
            right += y
            if right / n >= pii.PRECISION:
                trees.thresholds[kind] = max(0.5, float(-place))
    return trees


def test_trees_are_fitted_on_all_documents(spark, monkeypatch):
    monkeypatch.setattr(pii, "TREES", 10)
    rnd = random.Random(8)
    rows = []
    for i in range(6600):
        found = [
            f"jo{i}@mail{i % 9}.example.com", f"10.{i % 256}.7.{rnd.randint(1, 250)}", f"4111 1111 1111 {rnd.choice([1111, 1112])}", f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}",
            f"999.3.2.{i}", f"page {rnd.randint(10**6, 10**8)}", f"version {i % 30}.{i % 7}.0.1",
        ][rnd.randrange(7)]
        rows.append((None if i % 97 == 0 else i // 2 if i % 89 == 0 else i - 3000, f"kalo {rnd.choice(['mi', 'id', 'call'])} {found} ten", "en", "s", 0))
    rows += [rows[5], rows[97], (7000, None, "en", "s", 0), (None, "", "en", "s", 0)]
    made, whole = pii.fit(documents(spark, rows, clashes=True)), brute_trees(rows)
    assert made.start == whole.start and made.thresholds == pytest.approx(whole.thresholds, abs=1e-12)
    for name in ("feature", "cut", "leaf"):
        assert np.array_equal(getattr(made, name), getattr(whole, name)), name


def test_trees_are_fitted_on_all_candidates(spark, monkeypatch):
    monkeypatch.setattr(pii, "TREES", 1)
    text = " ".join(f"kalo jo{i}@mail{i}.example.com 10.{i % 256}.7.{i % 250} ten 4111 1111 1111 {1100 + i} {i} +1 ({200 + i}) 555-{1000 + i} mi" for i in range(60))
    docs = [d for d in range(300) if zlib.crc32(b"threshold%d" % d) % 5]
    labels = [[y for _, y in pii.examples(text, turn)] for turn in range(12)]
    good, n = (sum(f(labels[d % 12]) for d in docs) for f in (sum, len))
    assert n > 120_000
    trees = pii.fit(documents(spark, [(d, text, "en", "s", 0) for d in range(300)]).repartition(8))
    assert trees.start == pytest.approx(float(np.log(good / (n - good))), abs=1e-12)


def test_cuts_are_quantiles_of_all_values():
    rng = np.random.default_rng(4)
    for size in (1, 2, 7, 40, 5000):
        x = rng.integers(-1, 60, size) ** 2
        assert np.array_equal(pii.cuts_of(*np.unique(x, return_counts=True)), np.unique(np.quantile(x, np.linspace(0, 1, 33)))[:-1])


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (3000, 26))
    y = ((x[:, 3] > 0.4) & (x[:, 7] < 0.7)).astype(float)
    trees = pii.Trees(*pii.boost(x[:2000], y[:2000]), {})
    assert ((trees.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97
