"""Small helpers for linear models that are fitted on labelled rows: on all of them by Spark, or on bounded samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import held_out
from flowlens.session import broadcast_if_small

# Labelled ids, of two numbers each, that are sent to every task; more are joined by shuffle.
SENT_IDS = 2_000_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights of least logistic loss plus ridge, by Newton steps; y are probabilities, there is no intercept of its own."""
    w, weight = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    loss = lambda v: float(weight @ (np.logaddexp(0, x @ v) - y * (x @ v)) + ridge / 2 * v @ v)
    now = loss(w)
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, abs(before)):
            break
    return w


def sum_over(rows: DataFrame, columns: list[str], of: Callable[..., np.ndarray]) -> np.ndarray | None:
    """The sum over all rows of the vectors that `of` gives for a batch's columns, arrays as matrices; None without rows.

    Each task sends one vector to the driver.
    """
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                arrays = [c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
                part = of(*arrays)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    found = rows.select(*columns).mapInArrow(run, "v array<double>").collect()
    return np.sum([r["v"] for r in found], axis=0) if found else None


def fit_logistic_rows(rows: DataFrame, width: int, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """As `fit_logistic`, over all rows (x array, y, weight) of a table: each Newton step is a pass of Spark over them."""
    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def of(x, y, weight):
            z = x @ w
            p = sigmoid(z)
            return np.concatenate([[weight @ (np.logaddexp(0, z) - y * z)], x.T @ (weight * (p - y)), ((x * (weight * p * (1 - p))[:, None]).T @ x).ravel()])

        s = sum_over(rows, ["x", "y", "weight"], of)
        return s[0] + ridge / 2 * w @ w, s[1:1 + width] + ridge * w, s[1 + width:].reshape(width, width) + ridge * np.eye(width)

    w = np.zeros(width)
    now, slope, curve = at(w)
    for _ in range(steps):
        step, size = np.linalg.solve(curve, slope), 1.0
        new = at(w - step)
        # Sums over tasks come in no fixed order: a loss that is larger by rounding only is none.
        while size > 1e-6 and new[0] > now + 1e-12 * abs(now):
            size /= 2
            new = at(w - size * step)
        w, before = w - size * step, now
        now, slope, curve = new
        if before - now < 1e-9 * max(1.0, abs(before)):
            break
    return w


def _known(labels: DataFrame, label_col: str, label_id_col: str) -> DataFrame:
    """(doc_id, label) of the labels that fitting may see."""
    key = labels[label_id_col].cast("long")
    return labels.where(key.isNotNull() & ~held_out(key)).select(key.alias("doc_id"), labels[label_col].cast("int").alias("label")).distinct()


def class_weights(labels: DataFrame, label_col: str, per_class: int, label_id_col: str = "doc_id") -> tuple[float, float]:
    """Weights of the sampled rows of label 0 and of label 1, with which their mix is that of all labels; 1 on average.

    The sample takes at most `per_class` ids of each label, so its own mix changes with the size of the input.
    """
    known = _known(labels, label_col, label_id_col)
    n = {r["label"]: r["count"] for r in known.where(F.col("label").isin(0, 1)).groupBy("label").count().collect()}
    total = [n.get(y, 0) for y in (0, 1)]
    taken = [min(x, per_class) for x in total]
    return tuple(x / t * sum(taken) / sum(total) if t else 1.0 for x, t in zip(total, taken))


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, label): all rows with a label, 0 or 1, that fitting may see; null labels and ids are left out."""
    known = _known(labels, label_col, label_id_col).where(F.col("label").isin(0, 1))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return rows.join(broadcast_if_small(known, SENT_IDS), "doc_id")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
) -> DataFrame:
    """(doc_id, text, label): at most `per_class` labelled ids of each label, 0 and 1, of those that fitting may see.

    The ids come first by hash, so the same rows are taken whatever the partitions; null labels and ids are left out.
    At most twice `per_class` ids are sent to the tasks.
    """
    known = _known(labels, label_col, label_id_col)
    chosen = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")


def bounded_rows(sample: DataFrame, most: int) -> pd.DataFrame:
    """The sample's rows on the driver in an order of their own; an id that stands for very many rows counts `most` times at most in all."""
    frame = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most).toPandas()
    return frame.reset_index(drop=True)
