"""Preparation of a training corpus: five stages, each a table that the next one reads.

Documents of low quality and toxic ones go, one document of each near-duplicate group stays, documents that overlap the
benchmark go, and what remains is encoded and decoded again.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import flowlens
from flowlens.llm import chunked_bpe, decontaminate, quality_rank, simhash, toxicity
from flowlens.llm.common import stored, table

# Python workers get the package's functions with each task, whatever folder they run in.
cloudpickle.register_pickle_by_value(flowlens)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut."""
    return quality_rank.accepted(docs, quality_rank.fit(docs, table(spark, sf_dir, "labels"), cut=0.3), cut=0.3)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), cut=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints, over three-word shingles, that links of at most three differing bits join."""
    return simhash.one_of_each(docs, most=3, shingle=3)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return chunked_bpe.round_trip(chunked_bpe.encode(docs, ranks, pattern), ranks, pattern)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", byte_level_bpe),
]
# Fitted models and message passing are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
