"""Why a score is high: contributions of features, terms and single words."""

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import opaque
from ..session import BROADCAST_ROW_LIMIT, broadcast_if_small, materialize
from .vectorize import map_dot, placed


WHITE = re.compile(r"[ \t\n\x0b\f\r]+")


def direction(value: Column) -> Column:
    return F.when(value > 0, "increases_threat").otherwise("decreases_threat")


def feature_contributions(
    df: DataFrame, coefficients: DataFrame, id_col: str = "id", features: str = "features",
) -> DataFrame:
    """One row per (id, feature with a coefficient and a non-zero value).

    `coefficients` has `feature` and `coefficient`.
    """
    # `explode` would add a filter on the map's size that computes the map a second time.
    cells = df.select(id_col, F.explode_outer(features).alias("feature", "feature_value"))
    return (
        cells.filter(F.col("feature_value") != 0)
        .join(broadcast_if_small(coefficients), "feature")
        .select(id_col, "feature", "feature_value", "coefficient",
                F.abs(F.col("feature_value") * F.col("coefficient")).alias("importance_score"))
    )


def top_k_features(contributions: DataFrame, k: int = 5, id_col: str = "id") -> DataFrame:
    """The k strongest contributions per id, ranked from 1; equal ones by name."""
    order = Window.partitionBy(id_col).orderBy(F.col("importance_score").desc(), "feature")
    return (
        contributions.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .withColumn("contribution", direction(F.col("coefficient")))
        .select(id_col, "rank", "feature", "importance_score", "contribution", "feature_value")
    )


def explain_linear(
    df: DataFrame, coefficients: dict[str, float], k: int = 5, features: str = "features",
    output: str = "top_features",
) -> DataFrame:
    """Adds the k strongest features of each row as an array; no row leaves its partition.

    Equal strengths are ranked by name. Names without a coefficient and values of 0 or null are left out; a null map gives null.
    """
    known = {n: c for n, c in coefficients.items() if c is not None}
    names, weights = pa.array(list(known), pa.string()), np.array([*known.values(), 0.0])
    rank = np.empty(len(known), np.int64)
    rank[sorted(range(len(known)), key=[n.encode() for n in known].__getitem__)] = np.arange(len(known))
    towards = pa.array(["decreases_threat", "increases_threat"])
    schema = T.ArrayType(T.StructType([
        T.StructField("feature", T.StringType()), T.StructField("importance_score", T.DoubleType()), T.StructField("contribution", T.StringType()),
        T.StructField("feature_value", df.select(features).schema[0].dataType.valueType)]))

    @F.arrow_udf(schema)
    def strongest(keys: pa.Array, values: pa.Array) -> pa.Array:
        row, index, at = placed(keys, names)
        numbers = values.flatten()
        value = numbers.to_numpy(zero_copy_only=False)[at]
        used = (value != 0) & pc.is_valid(numbers).to_numpy(zero_copy_only=False)[at]
        row, index, at, strength = row[used], index[used], at[used], np.abs(value * weights[index])[used]
        order = np.lexsort((rank[index], -strength, row))
        counts = np.bincount(row, minlength=len(keys))
        # The place of each entry among those of its row.
        place = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        kept = order[place < k]
        entries = pa.StructArray.from_arrays(
            [names.take(pa.array(index[kept])), pa.array(strength[kept]), towards.take(pa.array((weights[index[kept]] > 0).astype(np.int8))),
             numbers.take(pa.array(at[kept]))], schema.elementType.fieldNames())
        offsets = np.concatenate([[0], np.cumsum(np.minimum(counts, k))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), entries, mask=pc.is_null(keys))

    return df.withColumn(output, opaque(strongest)(F.map_keys(features), F.map_values(features)))


def coefficient_table(df: DataFrame) -> DataFrame:
    """One row per feature; coefficients of a feature listed twice add up."""
    return df.groupBy("feature").agg(F.sum(F.col("coefficient").cast("double")).alias("coefficient"))


def score_linear(
    df: DataFrame, coefficients: DataFrame, intercept: float, id_col: str = "id", features: str = "features",
    most: int = BROADCAST_ROW_LIMIT,
) -> DataFrame:
    """Adds `score` = sigmoid(intercept + Σ value · coefficient); names without a coefficient count 0.

    A null or empty map scores sigmoid(intercept). A coefficient table of up to `most` rows goes to every task; a longer
    one is joined and summed per row. Both ways give the same scores, whatever ids repeat or are null.
    """
    table = coefficient_table(coefficients)
    short = table.limit(most + 1).collect()
    if len(short) <= most:
        return df.withColumn("score", sigmoid(map_dot(features, {r[0]: r[1] for r in short if r[0] is not None}) + F.lit(intercept)))
    # Written once, so that both readers see the same row numbers.
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    cells = rows.select("_row", F.explode(features).alias("feature", "_v"))
    sums = cells.join(table, "feature").groupBy("_row").agg(F.sum(F.col("_v") * F.col("coefficient")).alias("_s"))
    joined = rows.join(sums, "_row", "left")
    return joined.withColumn("score", sigmoid(F.coalesce("_s", F.lit(0.0)) + F.lit(intercept))).drop("_s", "_row")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _probability(logits: np.ndarray) -> np.ndarray:
    """Softmax of class 1; a single output is taken as it is."""
    logits = np.asarray(logits, float)
    if logits.ndim < 2 or logits.shape[1] < 2:
        return logits.reshape(len(logits))
    return 1 / np.exp(logits - logits[:, 1:2]).sum(1)


def occluded(text: str, words: list[str], most_chars: int, most_rows: int) -> Iterator[list[str]]:
    """The text, then the text without each word in turn, in lists of bounded length and size; none of them is kept."""
    batch, size = [text], len(text)
    for word in words:
        if len(batch) >= most_rows or size >= most_chars:
            yield batch
            batch, size = [], 0
        batch.append(text.replace(word, ""))
        size += len(batch[-1])
    yield batch


def explain_occlusion(
    df: DataFrame, make_predict_fn, k: int = 5, id_col: str = "id", text: str = "text", batch_size: int = 64, batch_chars: int = 1 << 22,
) -> DataFrame:
    """Impact of each distinct word: the score lost when all its occurrences are cut from the text; the k strongest of each row.

    `make_predict_fn()` returns a function from texts to class logits, as for score_external; it is called once a task. Words come from a
    white-space split; equal impacts are ranked by word. Variants of a text are made when a batch of them is scored, at most `batch_size` texts
    and about `batch_chars` characters at once, and only the k strongest words are held: nothing is shuffled, and a long text needs the memory of
    a batch and of its words. Null and empty texts give no rows; repeated rows give theirs each.
    """
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), *T._parse_datatype_string(
            "rank int, token string, impact_score double, contribution string, base_prediction double").fields])

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = make_predict_fn()
        for batch in batches:
            places, found = [], []
            for at, value in enumerate(batch.column(1).to_pylist()):
                words = [*dict.fromkeys(w for w in WHITE.split(value or "") if w)]
                if not words:
                    continue
                strongest, base, done = [], None, 0
                for variants in occluded(value, words, batch_chars, batch_size):
                    scores = _probability(predict(np.array(variants, dtype=object)))
                    if base is None:
                        base, scores = float(scores[0]), scores[1:]
                    impacts = base - scores
                    part = zip(impacts.tolist(), words[done:done + len(impacts)])
                    done += len(impacts)
                    strongest = heapq.nsmallest(k, [*strongest, *part], key=lambda e: (-abs(e[0]), e[1].encode()))
                for rank, (impact, word) in enumerate(strongest, 1):
                    places.append(at)
                    found.append((rank, word, impact, "increases_threat" if impact > 0 else "decreases_threat", base))
            kinds = (pa.int32(), pa.string(), pa.float64(), pa.string(), pa.float64())
            columns = [pa.array(c, kind) for c, kind in zip(zip(*found) if found else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), *columns], schema.fieldNames())

    return df.select(id_col, F.col(text).cast("string").alias("_text")).mapInArrow(explain, schema)
