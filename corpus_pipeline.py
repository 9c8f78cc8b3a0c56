"""Corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, encoding.

Every stage takes ``(spark, docs, sf_dir)`` and calls one operator of ``lamina.llm`` on all that its predecessor kept. Its
result is written as Parquet and read back as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import bpe, decontaminate, near_dedup, pii, quality_rules
from lamina.llm.common import materialise, ship, table, tidy

#: Ids up to this many (counted) are broadcast to filter by, more are joined by shuffle.
BROADCAST_IDS = 500_000
SHINGLE, PERCENT = 5, 80


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` but those whose id is in ``dropped``, a written table; rows with a null id can't be named and stay."""
    ids = dropped.select("doc_id").dropna().distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.kept_rows(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id: groups of five-word shingles, similarity 0.8 or more."""
    ship(spark)
    return _without(docs, near_dedup.near_duplicates(docs, size=SHINGLE, percent=PERCENT).filter("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship(spark)
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that give it away, are replaced in the texts; ``n_chars`` follows."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, decoded again for the digests."""
    ship(spark)
    return bpe.digests(docs)


STAGES = [("quality", quality), ("dedup", dedup), ("decontamination", decontamination), ("privacy", privacy), ("encoding", encoding)]
#: Latent retrieval and mutual information have no SQL form; tests/llm/test_corpus_operators.py holds the stages against plain versions.
ORACLE_SQL = None


@tidy("pipeline")
def _run(docs: DataFrame, sf_dir: str) -> DataFrame:
    for name, stage in STAGES:
        docs = materialise(stage(docs.sparkSession, docs, sf_dir), name)
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; only the last one's table stays in the shared folder."""
    ship(spark)
    return _run(table(spark, sf_dir, "documents"), sf_dir)
