"""The corpus pipeline: language, near-duplicates, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet to the shared folder and reads them for the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import decontaminate, language, mixing, neardup, sharding
from stowage.llm.common import Scratch, fresh, read

SHARDS = 24


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language, which fills in where lang is null.

    Texts that are null, empty or without a letter go, as do those that no
    learned language codes as it codes its own; rows are judged one by one, so
    null ids and repeated rows change nothing.
    """
    pred, known = fresh(docs, "lang_pred", "recognised")
    found = language.identify(docs).where(F.col(known) & (F.col(pred) != "und"))
    return found.select(*[F.coalesce(c, pred).alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that near-duplicate search keeps, one of each group.

    Of rows of one id and one set of shingles the first by text stays; rows of
    one id and different sets are documents of their own.  Rows of null id and
    texts without words stay.
    """
    return neardup.distinct_documents(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts stay, each row is judged by itself."""
    (hits,) = fresh(docs, "_hits")
    found = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark"), out=hits)
    return found.where(F.size(hits) == 0).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, in training order; texts without words stay, once, at the end."""
    return mixing.training_order(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place in the shard; null texts count as no bytes, equal rows take places in turn."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("language", by_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The language model and the sketches have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
