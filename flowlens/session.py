"""Session settings the operators rely on, and lineage cuts in shared storage."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Rows, and bytes of their values as text, a table may hold and still be sent to every executor.
BROADCAST_ROW_LIMIT = 200_000
BROADCAST_BYTE_LIMIT = 64 << 20


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """UTC times, last-wins map building and a fixed file-split size for this session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    # Split sizes otherwise follow the number of live cores, which may change
    # between two scans of one file; row indexes need both scans to agree.
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return spark


@contextmanager
def small_batches(spark: SparkSession):
    """Batches of 4 MB for the Python functions that run meanwhile, for rows that are wide themselves.

    A batch lies in buffers outside the heap, several times over while they grow; the default is 64 MB. A size that the session sets stays.
    """
    mine = spark.conf.get(BATCH_BYTES, None) is None
    if mine:
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    try:
        yield
    finally:
        if mine:
            spark.conf.unset(BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's checkpoint folder."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="flowlens-"))
    return context.getCheckpointDir()


# Folders that `materialize` wrote, by application.
_written: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Deletes all tables that `materialize` wrote in this application and returns their number.

    To be called when every result that reads them has been written or collected; results that have not
    been computed yet fail afterwards.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


def materialize(df: DataFrame, **options) -> DataFrame:
    """Writes `df` once to shared storage and reads it back: later uses see the same rows. `options` are those of the Parquet writer."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT, most_bytes: int = BROADCAST_BYTE_LIMIT) -> DataFrame:
    """Adds a broadcast hint when a count shows at most `limit` rows of few bytes in all; otherwise Spark shuffles."""
    fixed = sum(not isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)) for f in df.schema)
    sizes = [
        F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in df.schema
        if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))
    ]
    width = sum(sizes, F.lit(8 * fixed)).cast("long")
    rows, size = df.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and size <= most_bytes else df


def cached(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


# Rows of heavy per-row work that one task should have at most.
TASK_ROWS = 50_000


def spread(df: DataFrame, most: int = TASK_ROWS) -> DataFrame:
    """Spreads a scan of few splits over all cores, and over tasks of about `most` rows, before heavy per-row work.

    Splits follow bytes and row groups: a table of few, narrow columns would make few tasks of very many rows, some
    of them empty. A scan that already has so many splits stays as it is, without a shuffle.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // most))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


# Narrow rows that one task should sort or hash at most.
HELD_ROWS = 250_000


def held_tasks(df: DataFrame, most: int | None = None) -> int | None:
    """Tasks of about `most` rows, by default HELD_ROWS, for a shuffle of `df`; none while Spark's own tasks, about one per core, hold no more.

    Spark joins shuffle partitions until there is one task per core, by their packed bytes: narrow rows pack to a few bytes, so its
    tasks would grow with the table.
    """
    tasks = -(-df.count() // (most or HELD_ROWS))
    return tasks if tasks > df.sparkSession.sparkContext.defaultParallelism else None
