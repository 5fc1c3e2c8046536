"""Pipeline stages: each applies one operator to all that the stage before has kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of docs as they came, so columns
of other names, whatever they are, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import bpe, line_runs, mixing, quality, queries, shingle_join
from ledgerlight.llm.common import table

ACCEPTED = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.3 or more; null and empty texts are scored like any others."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = "score"
    while name in docs.columns:
        name += "_"
    return quality.score_documents(docs, model, tuple(docs.columns), name).where(F.col(name) >= ACCEPTED).drop(name)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut and n_chars is counted anew; a document all of whose lines are copies goes."""
    done = line_runs.drop_repeated_runs(docs).where("n_dropped < n_lines OR n_dropped = 0")
    fresh = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return done.select(*[fresh.get(n, F.col(f"row.`{n}`")).alias(n) for n in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return shingle_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes, in training order."""
    return mixing.training_stream(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every row of the mix."""
    return bpe.encode_documents(docs, queries.vocabulary(), texts=True).drop("decoded")
