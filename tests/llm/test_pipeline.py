"""Stages of the corpus pipeline on awkward rows and empty tables, each against its plain meaning."""

import collections
import hashlib

import pytest
from helpers import WORD, awkward, documents, prose, rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlight.llm import queries

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    passage = prose(77, 72)
    texts = [*awkward(), prose(1), prose(2), prose(3) + "\n" + passage, prose(4) + "\n" + passage, prose(5), prose(5), prose(5) + " more"]
    return documents(spark, rows_of(texts), clashes=True).cache()


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    docs.write.parquet(f"{root}/documents.parquet")
    labels = docs.where("doc_id IS NOT NULL").select("doc_id", F.when(F.col("doc_id") == 3, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"{root}/labels.parquet")
    return str(root)


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_classifier_stage_keeps_rows_as_they_are(spark, docs, folder):
    out = STAGES["quality_classifier"](spark, docs, folder)
    before, after = texts_of(docs), texts_of(out)
    assert out.columns == docs.columns and after.items() <= before.items() and len(after) == out.count() > 0


def test_line_stage_cuts_the_later_copy(spark, docs, folder):
    out = STAGES["line_dedup"](spark, docs, folder)
    before, after = texts_of(docs), texts_of(out)
    assert out.columns == docs.columns and after[10] == before[10]
    assert after[11].strip() == prose(4).strip()  # documents 10 and 11 end in the same passage
    assert 13 not in after and after[12] == before[12]  # all lines of 13 are copies
    assert all(after[i] == before[i] for i in range(10))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_join_stage_leaves_one_of_each_group(spark, docs, folder):
    out = STAGES["ngram_jaccard_join"](spark, docs, folder)
    before, after = texts_of(docs), texts_of(out)
    assert out.columns == docs.columns and after.items() <= before.items()
    # one of "word" twice, of "same row" twice, and of the three near copies; rows without words are all kept
    assert set(before) - set(after) == {4, 6, 13, 14}


def test_mixing_stage_repeats_rows_at_most_twice(spark, docs, folder):
    out = STAGES["mixing"](spark, docs, folder)
    before = texts_of(docs)
    rows = out.collect()
    taken = collections.Counter(r.doc_id for r in rows)
    assert out.columns == docs.columns and rows and all(r.n_chars == len(r.text) for r in rows)
    # the document that the target of a source ends in is taken in part, its first words
    cut = [r for r in rows if r.text != before[r.doc_id]]
    assert all(before[r.doc_id].startswith(r.text) for r in cut) and max(collections.Counter(r.source for r in cut).values(), default=0) <= 1
    assert max(taken.values()) <= 2 and all(WORD.search(before[i] or "") for i in taken)


def test_encoding_stage_equals_the_library(spark, docs, folder):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.vocabulary())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    before = texts_of(docs)
    rows = STAGES["bpe_encoding"](spark, docs, folder).collect()
    assert len(rows) == len(before)
    for r in rows:
        ids = tokenizer.encode(before[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_of_an_empty_table(spark, docs, folder, name):
    assert STAGES[name](spark, docs.limit(0), folder).count() == 0
