import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import quality, screening
from ledgerlight.sources import files

SDN = (
    '36,"AEROCARIBBEAN AIRLINES",-0- ,"CUBA",-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- \n'
    '306,"BANCO NACIONAL DE CUBA",-0- ,"CUBA",-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,"a.k.a. ""BNC""."\n'
    '99999,"DOE, John",individual,"SDGT] [IRAN",-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,"DOB 1970."\n'
    '100,"OLD NAME",vessel,"IRAN",-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- \n'
    '100,"SS EXAMPLE",vessel,"IRAN",-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- \n'
    "\n\x1a\n"
)
ALT = '306,220,"aka","NATIONAL BANK OF CUBA",-0- \n99999,1,"aka","Johnny Doe",-0- \n77777,2,"aka","NOBODY",-0- \n'


@pytest.fixture(scope="module")
def listed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lists")
    (root / "sdn.csv").write_text(SDN)
    (root / "alt.csv").write_text(ALT)
    entries = files.read_watchlist(spark, str(root / "sdn.csv"))
    return entries, files.read_aliases(spark, str(root / "alt.csv"))


def test_parsing(listed):
    entries, aliases = listed
    got = {r.ent_num: r for r in entries.collect()}
    assert set(got) == {"36", "306", "99999", "100"}
    assert got["36"].sdn_type == "entity" and got["36"].programs == ["CUBA"] and got["36"].remarks == ""
    assert got["99999"].programs == ["SDGT", "IRAN"] and got["99999"].name == "DOE, John" and got["100"].name == "SS EXAMPLE"
    assert got["306"].remarks == 'a.k.a. "BNC".'
    attached = {(r.ent_num, r.alias) for r in screening.attach_aliases(entries, aliases).collect()}
    assert attached == {("36", None), ("306", "NATIONAL BANK OF CUBA"), ("99999", "Johnny Doe"), ("100", None)}


def test_stats_and_index(listed):
    stats = {r.metric: r.value for r in screening.watchlist_stats(*listed).collect()}
    assert stats == {"type:entity": 2, "type:individual": 1, "type:vessel": 1, "entries": 4, "aliases": 2}
    index = {(r.name, r.ent_num) for r in screening.name_index(*listed).collect()}
    assert {("NATIONAL BANK OF CUBA", "306"), ("BANCO NACIONAL DE CUBA", "306"), ("SS EXAMPLE", "100")} <= index


def best(spark, listed, name, kind, **kw):
    asked = spark.createDataFrame([(name, kind)], "query STRING, sdn_type STRING")
    return screening.screen_best(asked, listed[0], **kw).collect()


def test_best_match(spark, listed):
    row = best(spark, listed, "Aerocaribbean Airlines", "entity")[0]
    assert row.entry_id == "36" and row.is_match and row.score > 90 and row.reference_url.endswith("id=36")
    turned = best(spark, listed, "John Doe", "individual")[0]
    assert turned.entry_id == "99999" and turned.is_match
    weak = best(spark, listed, "a completely unrelated query string", "entity")
    assert len(weak) == 1 and not weak[0].is_match
    assert best(spark, listed, "anything", "aircraft") == []


def test_top_matches_reach_aliases_and_chunks_agree(spark, listed):
    asked = spark.createDataFrame([("National Bank of Cuba",), ("ss exampel",)], "query STRING")
    whole = screening.screen_top(asked, *listed, k=3).collect()
    assert ("NATIONAL BANK OF CUBA", "306", 1) in {(r.matched_name, r.entry_id, r.place) for r in whole}
    tiled = screening.screen_top(asked, *listed, k=3, chunk_names=2).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, tiled))


def test_edit_distance_against_spark(spark):
    words = ["kitten", "sitting", "", "abc", "Saturday", "sunday", "né 日本", "n日"]
    mine = screening.edits([a for a in words for _ in words], words * len(words)).reshape(len(words), len(words))
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i INT, w STRING")
    pairs = df.alias("a").join(df.alias("b"), F.lit(True)).select("a.i", F.col("b.i").alias("j"), F.levenshtein("a.w", "b.w").alias("d"))
    assert all(mine[r.i, r.j] == r.d for r in pairs.collect())


@pytest.mark.parametrize("query, name, least", [
    ("ivan petrov", "PETROV, Ivan Sergeyevich", 80), ("Banco Nacional", "BANCO NACIONAL DE CUBA", 90), ("aerocaribean", "AEROCARIBBEAN AIRLINES", 75),
])
def test_parts_and_word_sets_of_a_name_match(spark, listed, query, name, least):
    entries = listed[0].limit(0).unionByName(spark.createDataFrame([("1", "entity", name), ("2", "entity", "ZZ TOP")], "ent_num STRING, sdn_type STRING, name STRING"), allowMissingColumns=True)
    asked = spark.createDataFrame([(query, "entity")], "query STRING, sdn_type STRING")
    row = screening.screen_best(asked, entries).first()
    assert row.matched_name == name and row.is_match and row.score >= least


def plain_score(q, n):
    """The four likenesses by their definition, one pair at a time."""

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    def like(a, b):
        return 1 - distance(a, b) / max(len(a), len(b)) if a or b else 0.0

    short, long = sorted((q, n), key=len)
    scale = 1.0 if 2 * len(long) < 3 * len(short) else 0.9 if len(long) <= 8 * len(short) else 0.6
    a, b = set(q.split()), set(n.split())
    sets = len(" ".join(a & b)) / max(1, min(len(" ".join(a)), len(" ".join(b)))) * 0.95 * scale
    part = 0.0
    if short and 2 * len(long) >= 3 * len(short):
        part = max((1 - distance(short, long[i : i + len(short)]) / len(short)) * scale for i in range(len(long) - len(short) + 1))
    best = max(like(q, n), like(" ".join(sorted(q.split())), " ".join(sorted(n.split()))) * 0.95, sets, part)
    return math.floor(best * 10_000 + 0.5) / 100


def test_index_gives_the_answer_of_all_pairs():
    draw = random.Random(5)
    words = ["ivan", "petrov", "banco", "nacional", "de", "cuba", "a", "né", "trading", "tradng", "co", "co"]
    names = sorted({" ".join(draw.choices(words, k=draw.randint(0, 5))) for _ in range(150)} | {"", "x  y", "aaaaaaaaaa", "a" * 60})
    queries = names[::7] + ["", "zq", "aaa", "  ".join(words), "petrov ivn", "bnc"]
    index = screening.NameIndex(names[::-1], names[::-1])
    for k in (1, 4, 1000):
        for query, found in zip(queries, index.top(queries, k), strict=True):
            wanted = sorted(((n, plain_score(query, n)) for n in names), key=lambda x: (-x[1], x[0]))[:k]
            assert found == wanted, query


def test_index_leaves_most_names_unscored(monkeypatch):
    draw = random.Random(1)
    names = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(2000)]
    scored = []
    plain = screening.edits
    monkeypatch.setattr(screening, "edits", lambda a, b: scored.append(len(a)) or plain(a, b))
    found = screening.NameIndex(names, names).top([n[1:] for n in names[:20]], 1)
    assert [f[0][0] for f in found] == names[:20] and sum(scored) < 20 * 2000 * 0.02


def test_null_queries_come_back_unmatched(spark, listed):
    asked = spark.createDataFrame([(None, "entity"), ("", "entity"), ("Aerocaribbean Airlines", "entity"), (None, "entity")], "query STRING, sdn_type STRING")
    rows = {r["query"]: r for r in screening.screen_best(asked, listed[0]).collect()}
    assert len(rows) == 3 and not rows[None].is_match and rows[None].matched_name is None and rows["Aerocaribbean Airlines"].is_match
    assert rows[""].score == 0 and not rows[""].is_match
    top = screening.screen_top(asked.select("query"), *listed, k=2).collect()
    assert [(r.matched_name, r.is_match) for r in top if r["query"] is None] == [(None, False)]
    empty = asked.limit(0)
    assert screening.screen_best(empty, listed[0]).count() == 0 and screening.screen_best(asked, listed[0].limit(0)).count() == 1


def test_names_are_shuffled_once_however_many_queries(spark, listed):
    asked = spark.range(3000).select(F.concat(F.lit("name "), "id").alias("query"), F.lit("entity").alias("sdn_type"))
    names = screening.name_index(listed[0])
    tiles = screening._scored(asked, names, ["sdn_type"], 1, 1)
    plan = tiles._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(") == 1 and tiles.count() == 3000


def test_entry_detail_and_rejects(spark, listed):
    ids = spark.createDataFrame([("36",), ("nope",)], "ent_num STRING")
    assert {r.ent_num: r.found for r in screening.entry_detail(ids, listed[0]).collect()} == {"36": True, "nope": False}
    with pytest.raises(ValueError):
        quality.require_rows(listed[0])
    assert quality.require_rows(listed[0], 4) is listed[0]
    bad = quality.invalid_values(spark.createDataFrame([("entity",), ("ship",), (None,)], "t STRING"), "t", quality.ENTITY_TYPES)
    assert bad.count() == 2
    good, rejected = quality.reject_bad_rows(ids, {"numeric id": F.col("ent_num").rlike("^[0-9]+$")})
    assert good.first().ent_num == "36" and rejected.first().reject_reason == "numeric id"


def test_word_edits_equal_the_table(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab cé漢😀") for _ in range(n)) for n in (0, 1, 2, 5, 17, 40, 63, 64, 64, 65, 90) for _ in range(4)]
    pairs = [(a, b) for a in texts for b in texts]
    index = screening.NameIndex(texts, texts)
    for kind in ("normal", "ordered"):
        listed = [getattr(t, kind) for t in index.texts]
        asked = screening._Asked(listed, index.listed[kind])
        q, n = (np.array(x) for x in zip(*[(i, j) for i in range(len(listed)) for j in range(len(listed))], strict=True))
        got, longest = index.distances(kind, index.texts, asked, q, n)
        assert got.tolist() == screening.edits([listed[i] for i in q], [listed[j] for j in n]).tolist() and len(got) == len(pairs)
        assert longest.tolist() == [max(len(listed[i]), len(listed[j])) for i, j in zip(q, n, strict=True)]


def test_entries_of_a_hot_name_are_made_in_cells(spark, monkeypatch):
    monkeypatch.setattr(screening, "CELL_QUERIES", 3)
    monkeypatch.setattr(screening, "CELL_ENTRIES", 4)
    monkeypatch.setattr(screening, "TASK_ROWS", 5)
    asked = [f"acme {i}" for i in range(11)]
    best = spark.createDataFrame([("acme", q, 90.0, 1) for q in asked] + [("rare", "rare", 100.0, 1)], "matched_name STRING, query STRING, score DOUBLE, place INT")
    rows = [("entity", "acme", str(i), False) for i in range(10)] + [("vessel", "acme", "3", True), ("entity", "rare", "77", False), ("entity", "other", "5", False)]
    names = spark.createDataFrame(rows, "sdn_type STRING, name STRING, ent_num STRING, is_alias BOOLEAN")
    found = screening._with_entries(best, names)
    got = sorted((r.matched_name, r.query, r.entry_id) for r in found.collect())
    assert got == sorted([("acme", q, str(i)) for q in asked for i in range(10)] + [("rare", "rare", "77")])
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [matched_name" in plan and found.rdd.getNumPartitions() > 4  # more tasks than the small input alone would get


def test_tiles_are_dealt_to_tasks_without_broadcast(spark):
    names = spark.createDataFrame([(f"name {i}",) for i in range(30)], "name STRING")
    asked = spark.createDataFrame([(f"nume {i}",) for i in range(40)], "query STRING")
    found = screening._scored(asked, names, [], 1, chunk_names=15, slice_queries=4)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin [chunk" in plan  # broadcast queries left all tiles to the one task of the names
    assert {(r.query, r.matched_name) for r in found.collect()} >= {(f"nume {i}", f"name {i}") for i in range(30)}
