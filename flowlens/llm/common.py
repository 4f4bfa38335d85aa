"""Helpers that the corpus operators share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.session import shared_dir

# Entries a Python worker's word cache may hold before it starts anew.
CACHE_ENTRIES = 120_000
# Operators whose state a Python worker holds; workers outlive the stages of a pipeline.
STATES = 2


def worker_state(name: str, make: Callable[[], Any]) -> Any:
    """One object per Python worker process: made by the first task that asks, reused by later tasks.

    The STATES objects that were asked for last are held, so a long session does not add them up.
    """
    held = sys.modules.setdefault("_corpus_worker_state", types.ModuleType("_corpus_worker_state")).__dict__.setdefault("held", {})
    found = held.pop(name, None)
    if found is None:
        while len(held) >= STATES:
            held.pop(next(iter(held)))
            pa.default_memory_pool().release_unused()
        found = make()
    held[name] = found
    return found


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone; other columns, whatever their names, are left out. A null text is empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def stored(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: later uses recompute nothing and survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/corpus/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def held_out(id_column):
    """True for the rows that fitting never sees: crc32 of the id as text, modulo 5, is 0. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0
