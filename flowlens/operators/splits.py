"""Train/test splits and cross-validation folds.

Membership is decided by comparing each row with a few exact cut keys, so only
narrow sort keys are shuffled and the wide rows are filtered where they are.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..constants import GROUP_KEYS
from ..functions.columns import as_column, non_empty
from ..session import broadcast_if_small
from .ordering import before_key, rows_at_ranks, with_row_index


@dataclass(frozen=True)
class Split:
    train: DataFrame
    test: DataFrame
    requested_mode: str
    actual_mode: str


def _label_counts(df: DataFrame, label: str) -> dict:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def time_split(
    df: DataFrame, test_size: float = 0.2, label: str = "label",
    order_by: tuple[str, ...] = ("window_start_ms", "window_end_ms", "id"), seed: int = 42,
) -> Split:
    """Oldest rows train, newest rows test; a side without both classes falls back to a stratified split.

    Missing times count as 0 and missing ids as empty text. Rows that agree in all of
    `order_by` stay on one side.
    """
    times = [F.coalesce(F.col(c), F.lit(0)).alias(f"_k{i}") for i, c in enumerate(order_by[:-1])]
    keys = [f"_k{i}" for i in range(len(order_by))]
    last = F.coalesce(F.col(order_by[-1]).cast("string"), F.lit("")).alias(keys[-1])
    keyed = df.select("*", *times, last)
    n = df.count()
    if n > 1:
        cut = max(1, min(n - 1, round(n * (1 - test_size))))
        key = rows_at_ranks(keyed, keys, [cut])[cut]
        in_train = before_key(keys, key)
        train, test = keyed.filter(in_train).drop(*keys), keyed.filter(~in_train).drop(*keys)
        y = F.col(label)
        sides = keyed.groupBy(in_train.alias("side")).agg(F.count_if(y == 0), F.count_if(y == 1)).collect()
        if len(sides) == 2 and all(r[1] > 0 and r[2] > 0 for r in sides):
            return Split(train, test, "time", "time")
    train, test = stratified_split(df, test_size, seed, label, order_by[-1])
    return Split(train, test, "time", "stratified")


def _shares(counts: dict, total: int) -> dict:
    """`total` rows shared out over the classes in proportion, largest remainders first."""
    n = sum(counts.values())
    exact = {k: total * c / n for k, c in counts.items()}
    shares = {k: math.floor(v) for k, v in exact.items()}
    rest = total - sum(shares.values())
    for k in sorted(exact, key=lambda k: (shares[k] - exact[k], str(k)))[:rest]:
        shares[k] += 1
    return shares


def _shuffle_keys(id_col: str, seed: int) -> list[Column]:
    """A random but repeatable order: hash of the id, then the id itself."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return [F.xxhash64(key, F.lit(seed)).alias("_hash"), key.alias("_key")]


def _cut_keys(df: DataFrame, label: str, id_col: str, seed: int, ranks: dict) -> dict:
    """label → keys at the given ranks inside that label's shuffled order."""
    counts = _label_counts(df, label)
    labels = sorted(counts, key=lambda v: (v is not None, v))
    starts, before = {}, 0
    for value in labels:
        starts[value], before = before, before + counts[value]
    wanted = [starts[v] + r for v in labels for r in ranks.get(v, ()) if r < counts[v]]
    keyed = df.select(F.col(label).alias("_label"), *_shuffle_keys(id_col, seed))
    found = rows_at_ranks(keyed, ["_label", "_hash", "_key"], wanted)
    return {v: [found[starts[v] + r][1:] for r in ranks.get(v, ()) if r < counts[v]] for v in labels}


def _fold_number(label: str, cuts: dict) -> Column:
    """How many of its label's cut keys a row has reached."""
    number = F.lit(None).cast("int")
    for value, keys in cuts.items():
        reached = F.lit(0)
        for key in keys:
            reached = reached + (~before_key(["_hash", "_key"], key)).cast("int")
        number = F.when(F.col(label).eqNullSafe(F.lit(value)), reached).otherwise(number)
    return number


def stratified_split(
    df: DataFrame, test_size: float = 0.2, seed: int = 42, label: str = "label", id_col: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """Random split with ceil(n · test_size) test rows, each label in proportion; ids must be unique."""
    counts = _label_counts(df, label)
    if not counts:
        return df, df
    test_rows = math.ceil(sum(counts.values()) * test_size)
    cuts = _cut_keys(df, label, id_col, seed, {k: [v] for k, v in _shares(counts, test_rows).items()})
    keyed = df.select("*", *_shuffle_keys(id_col, seed)).withColumn("_side", _fold_number(label, cuts))
    drop = ("_hash", "_key", "_side")
    return keyed.filter("_side > 0").drop(*drop), keyed.filter("_side = 0").drop(*drop)


def holdout_split(df: DataFrame, source: str, source_col: str = "dataset_source", label: str = "label") -> Split:
    """All rows of one data source test, the rest train; four kinds of useless splits are refused."""
    name = source.strip()
    is_test = F.col(source_col) == name
    train, test = df.filter(~is_test), df.filter(is_test)
    y = F.col(label)
    sides = {
        r["test"]: (r["zeros"], r["ones"])
        for r in df.groupBy(is_test.alias("test"))
        .agg(F.count_if(y == 0).alias("zeros"), F.count_if(y == 1).alias("ones")).collect()
    }
    if False not in sides:
        raise ValueError(f"hold-out source {name} leaves no training rows")
    if True not in sides:
        known = df.agg(F.count_distinct(source_col)).first()[0]
        raise ValueError(f"hold-out source {name} matches no rows of {known} known sources")
    if 0 in sides[False]:
        raise ValueError(f"training rows for hold-out source {name} lack one class")
    if 0 in sides[True]:
        raise ValueError(f"hold-out source {name} lacks one class")
    return Split(train, test, f"holdout:{name}", f"holdout:{name}")


def repeated_stratified_folds(
    df: DataFrame, k: int = 5, repeats: int = 3, seed: int = 42, label: str = "label", id_col: str = "id",
) -> DataFrame:
    """Adds `folds`, an array with the 0-based test fold of the row in each repeat; ids must be unique."""
    counts = _label_counts(df, label)
    assigned, columns = df, []
    for repeat in range(repeats):
        # The first n mod k folds of a label hold one row more.
        ranks = {v: [f * (c // k) + min(f, c % k) for f in range(1, k)] for v, c in counts.items()}
        cuts = _cut_keys(df, label, id_col, seed + repeat, ranks)
        keyed = assigned.select("*", *_shuffle_keys(id_col, seed + repeat))
        assigned = keyed.withColumn(f"_fold{repeat}", _fold_number(label, cuts)).drop("_hash", "_key")
        columns.append(f"_fold{repeat}")
    return assigned.withColumn("folds", F.array(*columns)).drop(*columns)


def default_group_by(df: DataFrame, window: str = "window") -> str:
    """The first grouping key that any record fills in, else `none`."""
    metadata = F.col(window)["metadata"]
    flags = df.agg(*[F.bool_or(non_empty(metadata[k]).isNotNull()).alias(k) for k in GROUP_KEYS]).first()
    return next((k for k in GROUP_KEYS if flags[k]), "none")


def group_key(window, group_by: str) -> Column:
    """Group of a record under a chosen key; a missing value is the group `unknown`."""
    if group_by == "none":
        return F.lit("")
    if group_by not in GROUP_KEYS + ("primary_scenario",):
        raise ValueError(f"unsupported grouping: {group_by}")
    metadata = as_column(window)["metadata"]
    value = metadata[group_by]
    if group_by == "scenario_signature":
        parts = metadata["component_scenarios"]
        joined = F.when(F.size(parts) > 0, F.array_join(F.array_sort(parts), "|"))
        return F.coalesce(F.nullif(value, F.lit("")), joined, F.lit("unknown"))
    return F.coalesce(value, F.lit("unknown"))


def stratified_group_folds(
    df: DataFrame, group: str = "group", k: int = 5, repeats: int = 3, seed: int = 42, label: str = "label",
) -> DataFrame:
    """Adds `folds` such that a group never spans two folds and labels stay balanced.

    Groups holding at least 1/(64·k) of the rows, of which there are at most 64·k, are
    placed one by one onto the fold that stays most even. All smaller groups are sorted
    by label mix and size and dealt out in turn, back and forth over the folds.
    """
    y = F.col(label)
    groups = df.groupBy(group).agg(
        F.count_if(y == 1).alias("_pos"), F.count_if(y == 0).alias("_neg"), F.count(F.lit(1)).alias("_n")
    )
    totals = groups.agg(F.count(F.lit(1)), F.sum("_pos"), F.sum("_neg")).first()
    if totals[0] < k:
        raise ValueError(f"only {totals[0]} groups for {k} folds")
    pos_total, neg_total = totals[1], totals[2]
    heavy = F.col("_n") * (64 * k) >= pos_total + neg_total
    heavy_rows = groups.filter(heavy).collect()
    light = groups.filter(~heavy)
    has_light = len(heavy_rows) < totals[0]

    assigned = df
    columns = []
    for repeat in range(repeats):
        fold = f"_fold{repeat}"
        placed = _place_heavy(heavy_rows, group, k, seed + repeat, pos_total, neg_total)
        schema = df.select(group).schema.add(fold, T.IntegerType())
        table = df.sparkSession.createDataFrame(placed, schema)
        if has_light:
            mix = F.round(F.col("_pos") / F.col("_n"), 2).alias("_mix")
            shuffled = F.xxhash64(F.col(group).cast("string"), F.lit(seed + repeat)).alias("_hash")
            ranked = with_row_index(
                light.select(F.col(group), mix, (-F.col("_n")).alias("_size"), shuffled),
                ["_mix", "_size", "_hash", group],
            )
            turn, place = F.floor(F.col("row_index") / k), (F.col("row_index") % k).cast("int")
            dealt = F.when(turn % 2 == 0, place).otherwise(k - 1 - place).cast("int")
            table = table.unionByName(ranked.select(group, dealt.alias(fold)))
        assigned = assigned.join(broadcast_if_small(table), group)
        columns.append(fold)
    return assigned.withColumn("folds", F.array(*columns)).drop(*columns)


def _place_heavy(rows, group: str, k: int, seed: int, pos_total: int, neg_total: int) -> list[tuple]:
    """Greedy placement of at most 64·k group totals; the fullest folds are avoided class by class."""
    import random

    order = list(rows)
    random.Random(seed).shuffle(order)
    order.sort(key=lambda r: -abs(r["_pos"] / max(pos_total, 1) - r["_neg"] / max(neg_total, 1)) - r["_n"] * 1e-9)
    loads = [[0.0, 0.0] for _ in range(k)]

    def spread(values):
        mean = sum(values) / k
        return sum((v - mean) ** 2 for v in values) / k

    placed = []
    for row in order:
        share = (row["_pos"] / max(pos_total, 1), row["_neg"] / max(neg_total, 1))
        best = None
        for fold in range(k):
            after = [[l[c] + (share[c] if f == fold else 0) for f, l in enumerate(loads)] for c in (0, 1)]
            cost = (spread(after[0]) + spread(after[1]), sum(loads[fold]), fold)
            if best is None or cost < best:
                best = cost
        fold = best[2]
        loads[fold] = [loads[fold][c] + share[c] for c in (0, 1)]
        placed.append((row[group], fold))
    return placed
