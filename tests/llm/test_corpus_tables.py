"""Phrase mining, language and manifest against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, documents, prose, rows_of
from pyspark.sql import functions as F

from ledgerlight.llm import language, merkle, phrases

# phrases


def brute_phrases(rows, least, top, longest=5):
    """(lang, rank, phrase, a, l, r, n, score) of rows (doc_id, text, lang, ...)."""
    words, counts = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            these = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(these)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(these[i : i + k])) for i in range(len(these) - k + 1))
    often = {key: n for key, n in counts.items() if n >= least}
    found = []
    for (lang, phrase), a in often.items():
        if len(phrase) < 2:
            continue
        longer = [p for (other, p), n in often.items() if other == lang and len(p) > len(phrase) and 100 * n >= 100 * a]
        if any(p[i : i + len(phrase)] == phrase for p in longer for i in range(len(p))):
            continue
        cuts = []
        for k in range(1, len(phrase)):
            left, right = often[lang, phrase[:k]], often[lang, phrase[k:]]
            cuts.append((1000 * a * words[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.append((lang, " ".join(phrase), a, left, right, words[lang], score))
    made = []
    for lang in {f[0] for f in found}:
        mine = sorted((f for f in found if f[0] == lang), key=lambda f: (-f[6], -f[2], f[1].encode()))
        made += [(lang, i + 1, *f[1:]) for i, f in enumerate(mine[:top])]
    return sorted(made)


def mined(docs, **options):
    return sorted(tuple(r) for r in phrases.collocations(docs, **options).collect())


def phrase_rows():
    rnd = random.Random(4)
    lines = ["Red Lorry, yellow\tlorry", "one two three four five six", "a a a a a", "été à la plage!", "one two. three four", "x\x85y \x1cz"]
    texts = [" ".join(rnd.choice(lines) + rnd.choice(["", ".", "\n", "\r", ";"]) for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    langs = ["en", None, "und", "fr\nx", ""]
    return [(i, t, langs[i % 5], "s", 0) for i, t in enumerate([*texts, *awkward()])]


@pytest.mark.parametrize("least,top", [(1, 40), (9, 2000), (10_000, 5)])
def test_phrases_against_brute_force(spark, least, top):
    rows = [r for r in phrase_rows() if len(r[1] or "") < 10_000]
    assert mined(documents(spark, rows, clashes=True).repartition(3), least=least, top=top) == brute_phrases(rows, least, top)


def test_phrases_over_many_chunks(spark, monkeypatch):
    rows = phrase_rows()
    whole = mined(documents(spark, rows), least=7)
    monkeypatch.setattr(phrases, "CHUNK", 50)
    assert mined(documents(spark, rows).repartition(5), least=7) == whole != []


def test_phrases_of_nothing(spark):
    assert mined(documents(spark, [])) == []
    assert mined(documents(spark, rows_of([None, "", " \t.", "?"]))) == []
    assert mined(documents(spark, rows_of(["one", "two"])), least=1) == []


def test_long_text_with_one_repeated_phrase(spark):
    rows = [(1, "hot dog " * 40_000, "en", "s", 0)]
    assert mined(documents(spark, rows)) == brute_phrases(rows, 100, 2000)


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000_007
    known = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 5), ("en", "b", 1, big + 9)], "lang string, phrase string, words int, n long")
    totals = spark.createDataFrame([("en", 9_000_000_000_000_000_011)], "lang string, n long")
    row = phrases.scored(known, totals).first()
    assert row.score == 1000 * big * 9_000_000_000_000_000_011 // ((big + 5) * (big + 9))


# language


def test_slopes_against_differences():
    rng = np.random.default_rng(0)
    weights = language.start(3, 1)
    codes, truth = rng.integers(0, 6, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, slopes = language.slopes_of(weights, codes, truth)
    for name, weight in weights.items():
        flat, slope = weight.reshape(-1), slopes[name].reshape(-1)
        for i in np.argsort(-np.abs(slope))[:3]:
            own, step, losses = flat[i], np.float32(1e-2), []
            for moved in (own + step, own - step):
                flat[i] = moved
                losses.append(language.slopes_of(weights, codes, truth)[0])
            flat[i] = own
            assert abs((losses[0] - losses[1]) / 0.02 - slope[i]) < 2e-3, name


def language_rows(n=240):
    """Two invented languages that share their letters but not their order."""
    rnd = random.Random(2)
    parts = {"aa": ["tra", "lin", "po", "shu"], "bb": ["art", "nil", "op", "uhs"]}
    rows = []
    for i in range(n):
        lang = "ab"[i % 2] * 2
        words = ["".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(3, 80))]
        rows.append((i, " ".join(words).capitalize(), lang, "s", 0))
    return rows


def test_language_of_held_out_rows(spark):
    rows = language_rows()
    docs = documents(spark, rows, clashes=True)
    model = language.fit(docs, steps=150)
    made = {r.doc_id: r for r in language.predict(docs, model).collect()}
    truth = {r[0]: r[2] for r in rows}
    held = [r.doc_id for r in docs.where(language.fold(F.col("doc_id")) == 0).collect()]
    assert len(held) > 20 and np.mean([made[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and abs(sum(r.chances) - 1) < 1e-4 and r.score == max(r.chances) for r in made.values())
    # the same again; neither source, doc_id nor the held-out rows' lang matter
    other = documents(spark, [(i, t, "aa" if i in held else lang, None, None) for i, t, lang, _, _ in rows])
    again = {r.doc_id: r for r in language.predict(other.repartition(5), language.fit(other.repartition(3), steps=150)).collect()}
    assert all(abs(made[i].score - again[i].score) < 1e-4 and made[i].lang_pred == again[i].lang_pred for i in made)


def test_language_of_awkward_rows(spark):
    rows = language_rows(40) + [(1000 + i, t, None, None, None) for i, t in enumerate([*awkward(), "123 !?", "—", "tralinpo " * 30_000])]
    docs = documents(spark, rows, clashes=True)
    model = language.fit(docs, steps=60)
    made = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert [made[1000 + i].lang_pred for i in (0, 1, 2, 8, 9)] == ["und"] * 5 and made[1000].score == 0
    assert made[1003].score == pytest.approx(made[1004].score, abs=1e-5) and made[1005].lang_pred == made[1006].lang_pred != "und"
    assert made[1010].lang_pred == "aa"
    assert language.predict(docs.limit(0), model).collect() == []
    nothing = language.fit(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def test_whole_texts_are_labelled(spark):
    """What stands far behind counts as much as the start."""
    model = language.fit(documents(spark, language_rows()), steps=150)
    found = model.pooled(["Tralinpo shupo " * 500, "Tralinpo shupo " * 100 + "artnilop uhsop " * 400])
    assert found[0].argmax() == 0 and found[1].argmax() == 1 and 0.6 < found[1].max() < 0.9


# manifest


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def brute_leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    fields = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def brute_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute_manifest(rows, changed):
    """A sorted list of (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    trees = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r))):
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {x: brute_levels([brute_leaf(r) for r in trees[x]]) for x in names}
    top = brute_levels([levels[x][-1][0] for x in names])
    made = []
    for place, name in enumerate(names):
        for i, row in enumerate(trees[name]):
            siblings, folded = [], brute_leaf(row, int(row[0] in changed))
            for tree, at in ((levels[name], i), (top, place)):
                for level in tree[:-1]:
                    near = level[at - at % 2 : at - at % 2 + 2]
                    others = near[: at % 2] + near[at % 2 + 1 :]
                    siblings += others
                    folded = sha("".join([*others, folded] if at % 2 else [folded, *others]))
                    at //= 2
            made.append((row[0], brute_leaf(row), levels[name][-1][0], top[-1][0], sha("".join(siblings)), folded, folded == top[-1][0]))
    return sorted(made, key=repr)


def signed(docs, **options):
    made = merkle.manifest(docs, F.col("doc_id") % 3 == 0, **options)
    return sorted((tuple(r) for r in made.drop("proof").collect()), key=repr)


def manifest_rows(n):
    langs = ["en", "en", "en", None, "é", "z", ""]
    rows = [(i, f"text {i}", langs[i * i % 7], "s", i) for i in range(n)]
    return rows + [(None, t, None, None, None) for t in awkward()[:5]] + [(3, "text 3", "en", "s", 3)] * 2 + [(5, None, "en", None, 2**62)]


@pytest.mark.parametrize("n,height", [(1, 10), (40, 1), (53, 2), (130, 3), (130, 10)])
def test_manifest_against_brute_force(spark, n, height):
    rows = manifest_rows(n)
    docs = documents(spark, rows, clashes=True).repartition(3)
    assert signed(docs, height=height) == brute_manifest(rows, {r[0] for r in rows if r[0] is not None and r[0] % 3 == 0})


def test_manifest_of_a_hot_id_in_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE", 20)
    rows = [(7, f"text {i % 5}", "en", "s", 1) for i in range(150)] + manifest_rows(30)
    assert signed(documents(spark, rows).repartition(4), height=2) == brute_manifest(rows, {r[0] for r in rows if r[0] is not None and r[0] % 3 == 0})


def test_proofs_lead_to_the_root(spark):
    made = merkle.manifest(documents(spark, rows_of([prose(i, 20) for i in range(9)] + awkward()))).collect()
    assert len({r.root for r in made}) == 1 and all(merkle.fold(r.leaf, r.proof) == r.root == r.folded_root and r.verified for r in made)
    assert any(merkle.fold("0" * 64, r.proof) != r.root for r in made)


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle.manifest(documents(spark, [])).collect() == []
    one = merkle.manifest(documents(spark, [(1, "a", None, None, None)])).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof == "" and one.proof_sha256 == sha("")
