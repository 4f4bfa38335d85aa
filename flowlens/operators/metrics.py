"""Classification metrics, score curves and threshold search."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import safe_ratio
from .ordering import prefix_sums

METRICS = (
    "accuracy", "balanced_accuracy", "negative_precision", "negative_recall", "negative_f1",
    "positive_precision", "positive_recall", "positive_f1", "macro_precision", "macro_recall",
    "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1",
)


def _f1(hits, wrong) -> Column:
    return safe_ratio(2 * hits, 2 * hits + wrong)


def classification_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: tuple[str, ...] = (),
) -> DataFrame:
    """One row of metrics per group, from one pass that counts the confusion matrix."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    count = lambda truth, guess: F.count_if((y == truth) & (p == guess))
    tallies = df.groupBy(*by).agg(
        count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(1, 1).alias("tp")
    )
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n, negatives, positives = tn + fp + fn + tp, tn + fp, fn + tp
    per_class = {
        "precision": (safe_ratio(tn, tn + fn), safe_ratio(tp, tp + fp)),
        "recall": (safe_ratio(tn, negatives), safe_ratio(tp, positives)),
        "f1": (_f1(tn, fp + fn), _f1(tp, fp + fn)),
    }
    # Averages cover the classes that occur as truth or prediction.
    seen = ((negatives + fn > 0).cast("double"), (positives + fp > 0).cast("double"))
    has_truth = ((negatives > 0).cast("double"), (positives > 0).cast("double"))
    recall = per_class["recall"]
    columns = {
        "accuracy": safe_ratio(tn + tp, n),
        "balanced_accuracy": safe_ratio(recall[0] + recall[1], has_truth[0] + has_truth[1]),
    }
    for name, (negative, positive) in per_class.items():
        columns[f"negative_{name}"], columns[f"positive_{name}"] = negative, positive
        columns[f"macro_{name}"] = safe_ratio(negative + positive, seen[0] + seen[1])
        columns[f"weighted_{name}"] = safe_ratio(negative * negatives + positive * positives, n)
    return tallies.select(
        *by, *[columns[m].alias(m) for m in METRICS],
        negatives.cast("bigint").alias("negative_support"), positives.cast("bigint").alias("positive_support"),
        n.cast("bigint").alias("n_samples"), "tn", "fp", "fn", "tp",
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"),
    )


def score_curve(
    df: DataFrame, label: str = "label", score: str = "score", by: tuple[str, ...] = (),
) -> DataFrame:
    """One row per distinct score with its own and the running counts at `score >= threshold`.

    Columns: `by`, `threshold`, `pos`, `neg`, `tp`, `fp`, `positives`, `negatives`.
    Rows are summed per score before any ordering; running sums are those of prefix_sums(), so the input is read once and no task
    orders all scores of a group.
    """
    y = F.col(label).cast("int")
    points = (
        df.filter(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("threshold"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    )
    summed = prefix_sums(points, by, [F.col("threshold").desc()], ("pos", "neg"))
    return summed.select(
        *by, "threshold", "pos", "neg", F.col("pos_through").alias("tp"), F.col("neg_through").alias("fp"),
        F.col("pos_total").alias("positives"), F.col("neg_total").alias("negatives"),
    )


def _curve_area(curve: DataFrame) -> Column:
    """Ties count half: the trapezoid over one threshold step."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    return F.try_divide(area, F.max("positives").cast("double") * F.max("negatives"))


def _precision_sum(curve: DataFrame) -> Column:
    steps = F.sum(F.col("pos") * safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    both = (F.max("positives") > 0) & (F.max("negatives") > 0)
    return F.when(both, F.try_divide(steps, F.max("positives")))


def ranking_metrics(df: DataFrame, label="label", score="score", by: tuple[str, ...] = ()) -> DataFrame:
    """`roc_auc` and `average_precision`; null when one class is missing."""
    curve = score_curve(df, label, score, by)
    return curve.groupBy(*by).agg(
        _curve_area(curve).alias("roc_auc"), _precision_sum(curve).alias("average_precision")
    )


def roc_auc(df: DataFrame, label="label", score="score", by: tuple[str, ...] = ()) -> DataFrame:
    curve = score_curve(df, label, score, by)
    return curve.groupBy(*by).agg(_curve_area(curve).alias("roc_auc"))


def average_precision(df: DataFrame, label="label", score="score", by: tuple[str, ...] = ()) -> DataFrame:
    curve = score_curve(df, label, score, by)
    return curve.groupBy(*by).agg(_precision_sum(curve).alias("average_precision"))


def pr_curve(df: DataFrame, label="label", score="score", by: tuple[str, ...] = ()) -> DataFrame:
    """Precision and recall of every distinct threshold."""
    tp, fp = F.col("tp"), F.col("fp")
    return score_curve(df, label, score, by).select(
        *by, "threshold", safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, F.col("positives")).alias("recall"), "tp", "fp",
    )


def best_threshold(
    df: DataFrame, label="label", score="score", metric="macro_f1", by: tuple[str, ...] = (),
) -> DataFrame:
    """The lowest threshold with the highest objective, and that objective.

    No rows give 0.5; a single class gives the mean score.
    """
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    wrong = fp + F.col("positives") - tp
    objective = _f1(tp, wrong)
    if metric == "macro_f1":
        objective = (objective + _f1(F.col("negatives") - fp, wrong)) / 2.0
    curve = score_curve(df, label, score, by).withColumn("objective", objective)
    rows = F.sum(F.col("pos") + F.col("neg"))
    mean = F.try_divide(F.sum(F.col("threshold") * (F.col("pos") + F.col("neg"))), rows)
    rank = F.struct("objective", -F.col("threshold"))
    one_class = (F.max("positives") == 0) | (F.max("negatives") == 0)
    return curve.groupBy(*by).agg(
        F.when(rows.isNull(), 0.5).when(one_class, mean).otherwise(F.max_by("threshold", rank)).alias("threshold"),
        F.when(one_class, None).otherwise(F.max("objective")).alias("objective"),
    )


def evaluation(
    df: DataFrame, label="label", prediction="prediction", score="score", by: tuple[str, ...] = (),
) -> DataFrame:
    """Threshold and ranking metrics side by side, one row per group."""
    counts = classification_metrics(df, label, prediction, by)
    ranks = ranking_metrics(df, label, score, by)
    if by:
        return counts.join(ranks, list(by), "left")
    # Both sides are one-row aggregates.
    return counts.withColumn("_one", F.lit(1)).join(ranks.withColumn("_one", F.lit(1)), "_one").drop("_one")


def long_metrics(evaluated: DataFrame, keys: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """One row per (keys, metric)."""
    return evaluated.unpivot(list(keys), [F.col(n).cast("double").alias(n) for n in names], "metric", "value")


def summarize_folds(long: DataFrame, keys: tuple[str, ...] = ("model", "metric"), value: str = "value") -> DataFrame:
    """Mean, population deviation and 95 % bounds over folds, rounded to 4 digits; nulls are skipped."""
    sums = long.groupBy(*keys).agg(
        F.count(value).alias("folds"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std")
    )
    margin = F.lit(1.96) * F.col("_std") / F.sqrt(F.greatest(F.col("folds"), F.lit(1)).cast("double"))
    return sums.select(
        *keys, "folds", F.round("_mean", 4).alias("mean"), F.round("_std", 4).alias("std"),
        F.round(F.col("_mean") - margin, 4).alias("ci95_low"),
        F.round(F.col("_mean") + margin, 4).alias("ci95_high"),
    )


def comparison_summary(metrics: DataFrame) -> DataFrame:
    """Deltas structured − text and the latency ratio external / structured.

    `metrics` has one row per model: `model`, `accuracy`, `positive_f1`, `latency_ms`.
    """
    of = lambda model, name: F.max(F.when(F.col("model") == model, F.col(name)))
    structured, text, external = "structured_baseline", "tfidf_fallback", "distilbert"
    ratio = of(external, "latency_ms") / F.greatest(of(structured, "latency_ms"), F.lit(0.001))
    return metrics.agg(
        F.round(of(structured, "accuracy") - of(text, "accuracy"), 4).alias("accuracy_delta"),
        F.round(of(structured, "positive_f1") - of(text, "positive_f1"), 4).alias("f1_delta"),
        F.round(ratio, 1).alias("latency_ratio"),
    )
