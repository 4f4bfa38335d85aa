"""Interaction audit of filters by a Gray-code walk over their subsets.

What a chain of filters keeps depends only on which documents fail which filters. Documents are counted per part and mask
of failed filters; these cells, 2 to the power of the filters for each part, are all that the audit needs. A Gray code
visits every subset of filters by switching one filter at a time. Each cell counts the active filters that it fails: at
the first one its documents leave the survivors, and when the last one is switched off they return. The survivors of all
subsets are stored; every order of the filters and every step is a difference of two of them.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import stored
from flowlens.llm.quality_rules import words

# Names of the filters of fail_masks(); the place in the string is the bit.
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_UPPER = 2
SYMBOLS = r"[#$%&*|]"
_COUNTS = ("n", "good", "toxic")


def text_failures(text: Column, list_of_words: Column) -> Column:
    """Bits of the filters A to D that a text fails.

    A: under 200 words; B: under half of the words are distinct; C: over 2 % of the characters are A-Z; D: holds one of #$%&*|.
    """
    n = F.size(list_of_words)
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    tests = (n < LEAST_WORDS, 100 * F.size(F.array_distinct(list_of_words)) < LEAST_DISTINCT * n, 100 * upper > MOST_UPPER * F.length(text), text.rlike(SYMBOLS))
    bits = [F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)]
    return sum(bits[1:], bits[0]).cast("int")


def fail_masks(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", label_id_col: str = "doc_id",
) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each source by the filters they fail, and how many are labelled good and toxic.

    Filter E fails for a text that stands under a smaller id anywhere in the table. Null texts are empty, a null source is
    the empty part. A null id is neither smaller nor greater than another and has no label; repeated rows count each, and
    an id with several labels is good or toxic if one of them says so. Texts are compared by SHA-256 and do not move; equal
    rows are summed before they are shuffled, so neither a frequent text nor a frequent source is one task.
    """
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("part"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    listed = rows.select("*", words(F.col("text")).alias("list"))
    flagged = listed.select("doc_id", "part", text_failures(F.col("text"), F.col("list")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    # Rows without an id get a key of their own, so that they are spread; `none` keeps them apart from real ids.
    none = F.col("doc_id").isNull()
    unique = stored(
        flagged.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("rows"))
        .select(F.coalesce("doc_id", F.xxhash64("digest")).alias("key"), none.alias("none"), "part", "mask", "digest", "rows"))
    firsts = unique.where(~F.col("none")).groupBy("digest").agg(F.min("key").alias("key")).select("key", F.lit(False).alias("none"), "digest", F.lit(True).alias("first"))
    label_id = labels[label_id_col].cast("long")
    known = labels.where(label_id.isNotNull()).groupBy(label_id.alias("key"), F.lit(False).alias("none")).agg(
        F.max((labels["quality"] == 1).cast("int")).alias("quality"), F.max((labels["toxic"] == 1).cast("int")).alias("bad"))
    joined = unique.join(known, ["key", "none"], "left").join(firsts, ["key", "none", "digest"], "left")
    repeated = ~F.col("none") & F.col("first").isNull()
    count = lambda flag: F.sum(F.col("rows") * F.coalesce(flag, F.lit(0))).alias
    return joined.groupBy("part", (F.col("mask") + F.when(repeated, 16).otherwise(0)).alias("mask")).agg(
        F.sum("rows").alias("n"), count(F.col("quality"))("good"), count(F.col("bad"))("toxic"))


def walk(counts: np.ndarray, filters: int) -> np.ndarray:
    """Survivors of every subset of filters, [subset, part, count], from the counts of the cells, [part, mask, count]."""
    masks = np.arange(1 << filters)
    failing = np.zeros(len(masks), np.int64)
    survivors = counts.sum(1)
    states = np.empty((len(masks), *survivors.shape), np.int64)
    states[0], subset = survivors, 0
    for step in range(1, len(masks)):
        bit = step & -step
        subset ^= bit
        hit = (masks & bit) > 0
        if subset & bit:
            failing[hit] += 1
            survivors = survivors - counts[:, hit & (failing == 1)].sum(1)
        else:
            failing[hit] -= 1
            survivors = survivors + counts[:, hit & (failing == 0)].sum(1)
        states[subset] = survivors
    return states


def _steps(filters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bit, subset before) of every step of every order of the filters."""
    orders = np.array([*permutations(range(filters))])
    bits = 1 << orders
    return np.repeat(np.arange(len(orders)), filters), bits.ravel(), (np.cumsum(bits, 1) - bits).ravel()


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from (part, mask, n, good, toxic).

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): documents that the
    step leaves and removes; that fail its filter but were removed before; that fail its filter alone; removed ones that are
    labelled good, and toxic; and the filter's removals summed over all orders. Zeros are rows too. A mask may have
    several rows; parts without rows, and so an empty table, have none.
    """
    k, names = len(filters), ["".join(p) for p in permutations(filters)]
    summed = cells.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    # At most one entry per mask.
    parts = summed.groupBy("part").agg(F.collect_list(F.struct("mask", *_COUNTS)).alias("cells"))

    def run(batches):
        order, bit, before = _steps(k)
        place = np.log2(bit).astype(int)
        for batch in batches:
            rows = batch.column("cells").to_pylist()
            counts = np.zeros((len(rows), 1 << k, len(_COUNTS)), np.int64)
            for i, row in enumerate(rows):
                for cell in row:
                    counts[i, cell["mask"]] = [cell[c] for c in _COUNTS]
            states = walk(counts, k)
            after = states[before | bit]
            gone = states[before] - after
            fails = (states[0] - states[bit])[..., 0]
            alone = (states[len(states) - 1 - bit] - states[-1])[..., 0]
            total = np.zeros((k, len(rows)), np.int64)
            np.add.at(total, place, gone[..., 0])
            # [step of an order, part] becomes part by part.
            column = lambda x: pa.array(np.ascontiguousarray(x.T).ravel(), pa.int64())
            part = batch.column("part").take(pa.array(np.repeat(np.arange(len(rows)), len(order))))
            labels = pa.array(names).take(pa.array(np.tile(order, len(rows))))
            yield pa.RecordBatch.from_arrays(
                [part, labels, pa.array(np.tile(np.arange(len(order)) % k + 1, len(rows)), pa.int32()), column(after[..., 0]), column(gone[..., 0]),
                 column(fails - gone[..., 0]), column(alone), column(gone[..., 1]), column(gone[..., 2]), column(total[place])],
                ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])

    return parts.mapInArrow(run, (
        "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"))
