"""Global order without a single-task window: row indexes and exact order statistics.

Rows are range-partitioned and sorted, written once, and numbered from
per-partition counts. Only one number per partition ever reaches the driver.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import broadcast_if_small, held_tasks, materialize

# monotonically_increasing_id() keeps the partition above bit 33, the position below.
POSITION_BITS = 33


def _sorted_with_position(df: DataFrame, order_by: list[str]) -> DataFrame:
    tasks = held_tasks(df)
    ranges = df.repartitionByRange(tasks, *order_by) if tasks else df.repartitionByRange(*order_by)
    ordered = ranges.sortWithinPartitions(*order_by)
    # The written copy fixes the sampled range bounds, so every later pass agrees.
    return materialize(ordered.withColumn("_position", F.monotonically_increasing_id()))


def _partition_offsets(positioned: DataFrame) -> dict[int, tuple[int, int]]:
    """Partition → (rows before it, rows in it); one entry per shuffle partition."""
    part = F.shiftright("_position", POSITION_BITS)
    counts = positioned.groupBy(part.alias("part")).count().collect()
    offsets, before = {}, 0
    for row in sorted(counts, key=lambda r: r["part"]):
        offsets[row["part"]] = (before, row["count"])
        before += row["count"]
    return offsets


def with_row_index(df: DataFrame, order_by: list[str], output: str = "row_index") -> DataFrame:
    """Adds a contiguous 0-based index in the order of the columns `order_by`."""
    positioned = _sorted_with_position(df, order_by)
    offsets = _partition_offsets(positioned)
    if not offsets:
        return positioned.withColumn(output, F.col("_position")).drop("_position")
    before = F.lit([offsets.get(p, (0, 0))[0] for p in range(max(offsets) + 1)])
    part = F.shiftright("_position", POSITION_BITS).cast("int")
    place = F.col("_position").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return positioned.withColumn(output, F.get(before, part) + place).drop("_position")


def prefix_sums(df: DataFrame, by: tuple[str, ...], order: list[Column], sums: tuple[str, ...]) -> DataFrame:
    """Adds `<c>_through`, the sum of `c` over the rows of the same `by` up to this one in `order`, and `<c>_total`, over all of them.

    Rows are cut into ranges of `by` and `order` together, so a group whose values crowd together is cut as finely as any other and no
    task sees more than its range. Each range adds up its own rows, once, and is written with that; the sums of the ranges before, at
    most one row per range and one more per group, then join it. `sums` are whole numbers; nulls count 0 and stay apart as groups.
    """
    key = F.xxhash64(*by) if by else F.lit(0).cast("bigint")
    keys = [*(["_key"] if by else []), *order]
    ordered = df.withColumn("_key", key).repartitionByRange(*keys).sortWithinPartitions(*keys)
    added = [T.StructField("_part", T.IntegerType()), *(T.StructField(f"_{c}", T.LongType()) for c in sums)]
    schema = T.StructType([*ordered.schema.fields, *added])

    def run(batches):
        from pyspark import TaskContext

        part, last, carried = TaskContext.get().partitionId(), None, np.zeros(len(sums), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("_key").to_numpy()
            starts = np.flatnonzero(np.diff(keys, prepend=keys[0])) if last == keys[0] else np.append(0, np.flatnonzero(np.diff(keys)) + 1)
            columns = []
            for i, c in enumerate(sums):
                through = np.cumsum(pc.fill_null(batch.column(c), 0).to_numpy().astype(np.int64))
                # What stands before the first row of each group is none of its own.
                before = np.where(starts > 0, through[starts - 1], 0)
                through -= np.repeat(np.append(-carried[i] if not len(starts) or starts[0] else 0, before), np.diff(np.concatenate([[0], starts, [len(keys)]])))
                carried[i] = through[-1]
                columns.append(pa.array(through))
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(keys), part, np.int32)), *columns], schema.fieldNames())

    ranges = materialize(ordered.mapInArrow(run, schema))
    totals = ranges.groupBy("_key", "_part").agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums))
    # At most one row per range of a group.
    group = Window.partitionBy("_key")
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_key", "_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums), *(F.sum(c).over(group).alias(f"{c}_total") for c in sums))
    return ranges.join(broadcast_if_small(offsets), ["_key", "_part"]).select(
        *(F.col(c) for c in df.columns), *((F.col(f"_{c}") + F.col(f"_before_{c}")).alias(f"{c}_through") for c in sums), *(f"{c}_total" for c in sums))


def rows_at_ranks(df: DataFrame, order_by: list[str], ranks: list[int]) -> dict[int, tuple]:
    """The `order_by` values found at the given 0-based ranks, as rank → tuple.

    Only the columns of `order_by` are shuffled and sorted, never the whole rows.
    """
    positioned = _sorted_with_position(df.select(*order_by), order_by)
    wanted = {}
    for part, (before, size) in _partition_offsets(positioned).items():
        for rank in ranks:
            if before <= rank < before + size:
                wanted[(part << POSITION_BITS) + rank - before] = rank
    if not wanted:
        return {}
    found = positioned.filter(F.col("_position").isin(*wanted)).collect()
    return {wanted[r["_position"]]: tuple(r[c] for c in order_by) for r in found}


def before_key(order_by: list[str], key: tuple) -> Column:
    """True for rows that sort before `key`; nulls sort first, as they do in `orderBy`."""
    before, equal = F.lit(False), F.lit(True)
    for name, value in zip(order_by, key):
        col = F.col(name)
        if value is None:
            smaller, same = F.lit(False), col.isNull()
        else:
            smaller, same = col.isNull() | (col < F.lit(value)), col.eqNullSafe(F.lit(value))
        before = before | (equal & smaller)
        equal = equal & same
    return F.coalesce(before, F.lit(False))


def with_file_row_index(df: DataFrame, output: str = "row_index", start: int = 1) -> DataFrame:
    """Adds the line order inside each file to a freshly scanned file source.

    Splits are numbered from their own row counts; `_path` holds the file.
    """
    scanned = df.select(
        "*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_position"),
    )
    splits = scanned.groupBy("_path", "_block").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_position").alias("_first")
    )
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "_path", "_block", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return (
        scanned.join(broadcast_if_small(offsets), ["_path", "_block"])
        .withColumn(output, F.col("_position") + F.col("_shift") + start)
        .drop("_block", "_position", "_shift")
    )


def first_rows(df: DataFrame, n: int, split: tuple[str, ...] = ()) -> DataFrame:
    """The first `n` rows, ordered by `split` and then as `df` has them.

    `split`, columns that a file scan gives all rows of a file split alike, such as path and block, restores the file order that
    Spark's packing of splits into partitions changes; without it, the order is that of the partitions. Rows are counted per split; splits
    before the one that holds row `n` are kept whole, that one up to the row's place. No row is moved, so every split stays with its own task.
    """
    keys = [*split, "_part"]
    position = F.monotonically_increasing_id()
    placed = df.select("*", F.shiftright(position, POSITION_BITS).alias("_part"), position.alias("_place"))
    # One row per split.
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).orderBy(*keys).collect()
    kept, left = [], max(0, n)
    for r in counts:
        if left <= 0:
            break
        last = None
        if r["_rows"] > left:
            same = F.lit(True)
            for c in keys:
                same = same & F.col(c).eqNullSafe(F.lit(r[c]))
            last = placed.filter(same).select("_place").orderBy("_place").limit(left).agg(F.max("_place")).first()[0]
        kept.append((*(r[c] for c in keys), last))
        left -= r["_rows"]
    types = {f.name: f.dataType for f in placed.schema}
    table = df.sparkSession.createDataFrame(kept, T.StructType([*(T.StructField(c, types[c]) for c in keys), T.StructField("_last", T.LongType())]))
    table = broadcast_if_small(table.toDF(*(f"_own{i}" for i in range(len(keys))), "_last"))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_own{i}"))
    inside = F.col("_last").isNull() | (F.col("_place") <= F.col("_last"))
    return placed.join(table, same).filter(inside).select(*(F.col(c) for c in df.columns))
