"""Replay of a sliding-window rate limit over a request table."""

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import broadcast_if_small


def admit(times: np.ndarray, held: np.ndarray, limit: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(accepted, held) of sorted times; `held` are the accepted times, at most `limit`, that may still count.

    With room for r more, the next r are accepted at once; without, everything until the oldest held time
    has passed is rejected at once. The steps follow the accepted rows, however many are rejected.
    """
    accepted, at = np.zeros(len(times), bool), 0
    while at < len(times) and limit > 0:
        held = held[np.searchsorted(held, times[at] - width, side="right"):]
        room = limit - len(held)
        if room <= 0:
            at = int(np.searchsorted(times, held[0] + width, side="left"))
            continue
        accepted[at:at + room] = True
        # On a stream, times of a later batch may lie before those held.
        held = np.sort(np.concatenate([held, times[at:at + room]]), kind="stable")
        at += room
    return accepted, held


def rate_limit_audit(
    requests: DataFrame, limit: int, window_s: float, key: str = "key", ts_ms: str = "ts_ms", id_col: str = "request_id",
) -> DataFrame:
    """Adds `accepted`: false when `limit` accepted rows of the key lie in (t − window, t].

    Only the order inside overloaded stretches matters. Rows are counted per key and
    window-wide step; a step is calm when it and the step before hold at most `limit`
    rows together, and all its rows are accepted as they are. The rest is replayed per
    stretch of overloaded steps, led in by the calm step before it, with at most `limit`
    times in memory.
    """
    width = int(window_s * 1000)
    step = F.floor(F.col(ts_ms) / F.lit(float(width))).cast("bigint")
    rows = requests.withColumns({"_key": F.coalesce(F.col(key).cast("string"), F.lit("unknown")), "_step": step})
    steps = rows.groupBy("_key", "_step").agg(F.count(F.lit(1)).alias("n"))

    # One row per key and step: these windows see sums, not requests.
    by_key = Window.partitionBy("_key").orderBy("_step")
    follows = F.coalesce(F.lag("_step").over(by_key) == F.col("_step") - 1, F.lit(False))
    marked = steps.withColumns({
        "_busy": F.col("n") + F.when(follows, F.lag("n").over(by_key)).otherwise(0) > limit, "_follows": follows,
    })
    leads = F.coalesce(
        (F.lead("_step").over(by_key) == F.col("_step") + 1) & F.lead("_busy").over(by_key), F.lit(False)
    )
    replayed = marked.withColumn("_lead", ~F.col("_busy") & leads).withColumn(
        "_stretch", F.sum((F.col("_lead") | (F.col("_busy") & ~F.col("_follows"))).cast("int")).over(by_key)
    ).filter("_busy or _lead").select("_key", "_step", "_stretch")

    tagged = rows.join(broadcast_if_small(replayed), ["_key", "_step"], "left")
    plain = list(requests.columns)
    calm = tagged.filter("_stretch is null").select(*plain, F.lit(True).alias("accepted"))
    busy = (
        tagged.filter("_stretch is not null").repartition("_key", "_stretch")
        .sortWithinPartitions("_key", "_stretch", ts_ms, id_col)
    )
    schema = busy.select(*plain, F.lit(True).alias("accepted"), "_key", "_stretch").schema

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, np.empty(0, np.int64)
        for batch in batches:
            keys, stretches, times = (batch[c].to_numpy() for c in ("_key", "_stretch", ts_ms))
            accepted = np.zeros(len(batch), bool)
            changes = np.flatnonzero((keys[1:] != keys[:-1]) | (stretches[1:] != stretches[:-1])) + 1
            for begin, end in pairwise([0, *changes.tolist(), len(batch)] if len(batch) else []):
                if (keys[begin], stretches[begin]) != current:
                    current, held = (keys[begin], stretches[begin]), held[:0]
                accepted[begin:end], held = admit(times[begin:end], held, limit, width)
            yield batch.assign(accepted=accepted)[[f.name for f in schema.fields]]

    done = busy.select(*plain, F.lit(True).alias("accepted"), "_key", "_stretch").mapInPandas(replay, schema)
    return calm.unionByName(done.select(*plain, "accepted"))
