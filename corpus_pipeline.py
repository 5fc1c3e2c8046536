"""The corpus pipeline: score, cut repeated lines, join near duplicates, mix, encode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.llm import stages
from ledgerlight.llm.common import table
from ledgerlight.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", stages.keep_good),
    ("line_dedup", stages.cut_repeated_lines),
    ("ngram_jaccard_join", stages.one_of_each_group),
    ("mixing", stages.mix_sources),
    ("bpe_encoding", stages.encode),
]

#: Scores of a trained classifier and merges of a tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; all but the last are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for index, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if index + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
