"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last keep the columns of documents.

Defined results, for every stage: a null text has no words, so quality rules reject it; null ids are ids like any other,
as are repeated ones; repeated rows count as copies, of which one stays; very long texts pass whole; columns beside
those of documents are kept by all stages but the last and read by none; empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kvlake.llm import line_dedup, mixing, packing, quality_rules, simhash
from kvlake.llm.common import shared_dir, tables_released


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject."""
    return quality_rules.clean_documents(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines the first stays; documents left without words go."""
    return line_dedup.deduplicated(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents the one with the smallest id stays."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; the last one taken of a source is cut at the source's budget."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", clean), ("line dedup", drop_lines), ("SimHash near-dedup", drop_copies), ("mixing sources", mix), ("best-fit packing", pack)]

#: MinHash candidates, components and the packing plan aren't expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of documents after all stages, each read back from the shared folder before the next begins."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/kvlake-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with tables_released(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
