"""Provenance counts, promotion gate, report warnings, request roll-ups."""

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    MIN_HOLDOUT_NEGATIVE_RECALL, MIN_HOLDOUT_POSITIVE_F1, UNVERIFIED_LABEL_SOURCES, WEAK_LABEL_SOURCES,
)
from ..functions.columns import non_empty


def _source(col: str) -> Column:
    return F.coalesce(non_empty(col), F.lit("unknown"))


def label_source_counts(df: DataFrame, label_source: str = "label_source") -> DataFrame:
    return df.groupBy(_source(label_source).alias("label_source")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy("label_source")


def dataset_source_counts(df: DataFrame, dataset_source: str = "dataset_source") -> DataFrame:
    return df.groupBy(_source(dataset_source).alias("dataset_source")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy("dataset_source")


def label_sources_by_dataset(df: DataFrame, dataset_source="dataset_source", label_source="label_source") -> DataFrame:
    """One row per data source with a map of label source → rows.

    Rows are summed per pair first; the maps then hold one entry per label source.
    """
    pairs = df.groupBy(
        _source(dataset_source).alias("dataset_source"), _source(label_source).alias("label_source")
    ).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("label_source", "n")))
    return pairs.groupBy("dataset_source").agg(F.map_from_entries(entries).alias("label_sources")) \
        .orderBy("dataset_source")


def feature_schemas(df: DataFrame, schema_col: str = "feature_schema") -> DataFrame:
    return df.select(F.col(schema_col).alias("feature_schema")).distinct()


def assert_single_schema(df: DataFrame, schema_col: str = "feature_schema") -> str:
    """The one schema tag of all rows; mixed tags are an error."""
    found = feature_schemas(df, schema_col).agg(F.count(F.lit(1)).alias("n"), F.min("feature_schema").alias("tag")).first()
    if found["n"] != 1:
        raise ValueError(f"expected one feature schema, found {found['n']}")
    return found["tag"]


def class_distribution(df: DataFrame, by: tuple[str, ...] = ("dataset_source",), label: str = "label") -> DataFrame:
    y = F.col(label)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y == 0).alias("label_0"), F.count_if(y == 1).alias("label_1")
    )


def weak_source_report(df: DataFrame, dataset_source="dataset_source", label_source="label_source") -> DataFrame:
    """Per data source: rows, and whether no row has a better label source than a rule or none."""
    weak = _source(label_source).isin(*UNVERIFIED_LABEL_SOURCES)
    return df.groupBy(_source(dataset_source).alias("dataset_source")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(weak).alias("weakly_labeled")
    )


def quality_gate(
    metrics: DataFrame, provenance: DataFrame, holdout_source: str | None,
    min_positive_f1: float = MIN_HOLDOUT_POSITIVE_F1,
    min_negative_recall: float = MIN_HOLDOUT_NEGATIVE_RECALL,
) -> DataFrame:
    """Promotion decision from one row of hold-out metrics and the (dataset, label source, n) counts.

    Ready only with a second source held out, both metrics above their floors and
    at least one strong label source in the hold-out.
    """
    held = F.col("dataset_source") == F.lit(holdout_source or "")
    facts = provenance.agg(
        F.count_distinct("dataset_source").alias("dataset_source_count"),
        F.count_if(held).alias("_held"),
        F.count_if(held & ~F.col("label_source").isin(*WEAK_LABEL_SOURCES)).alias("_strong"),
        F.array_sort(F.collect_set(F.when(held, F.col("label_source")))).alias("holdout_label_sources"),
    )
    # Two one-row tables.
    row = metrics.withColumn("_one", F.lit(1)).join(facts.withColumn("_one", F.lit(1)), "_one")
    f1, recall = F.coalesce("positive_f1", F.lit(0.0)), F.coalesce("negative_recall", F.lit(0.0))
    has_holdout = F.lit(bool(holdout_source))
    codes = F.array_compact(F.array(
        F.when(F.col("dataset_source_count") < 2, "single_source_dataset"),
        F.when(~has_holdout, "no_holdout_source"),
        F.when(has_holdout & (f1 < min_positive_f1), "holdout_structured_positive_f1_below_threshold"),
        F.when(has_holdout & (recall < min_negative_recall), "holdout_negative_recall_below_threshold"),
        F.when(has_holdout & (F.col("_held") == 0), "missing_holdout_label_provenance"),
        F.when(has_holdout & (F.col("_held") > 0) & (F.col("_strong") == 0), "weak_holdout_labels"),
    ))
    return row.select(
        (F.size(codes) == 0).alias("promotion_ready"), codes.alias("blocker_codes"),
        F.lit(float(min_positive_f1)).alias("min_holdout_positive_f1"),
        F.lit(float(min_negative_recall)).alias("min_holdout_negative_recall"),
        "dataset_source_count", F.lit(holdout_source).cast("string").alias("holdout_source"),
        "holdout_label_sources", f1.alias("holdout_structured_positive_f1"),
        recall.alias("holdout_negative_recall"),
    )


def credibility_warnings(label_sources: list[str], structured_f1_mean: float | None, requested: str, used: str) -> list[str]:
    """Warnings of a cross-validation report."""
    warnings = []
    if set(label_sources) <= set(UNVERIFIED_LABEL_SOURCES):
        warnings.append("weak_labels: labels are heuristic or unknown, metrics are weak-label results")
    if structured_f1_mean is not None and structured_f1_mean >= 0.99:
        warnings.append("near_perfect: the data may be too easy, validate on a harder hold-out")
    if requested == "auto" and used != "none":
        warnings.append(f"grouped: folds keep groups of {used} together")
    return warnings


def request_rollup(
    requests: DataFrame, window: str = "5 minutes", slide: str = "1 minute", ts_ms: str = "ts_ms",
) -> DataFrame:
    """Sliding request rate, 5xx and 200 rates per second and mean latency in ms per endpoint.

    Requests are summed per slide step first, so only the sums are copied into the
    overlapping windows. `window` must be a multiple of `slide`.
    """
    step = F.window(F.timestamp_millis(ts_ms), slide)
    steps = requests.groupBy(step["start"].alias("step"), "endpoint").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status").between(500, 599)).alias("errors"),
        F.count_if(F.col("status") == 200).alias("successes"),
        F.sum("duration_s").alias("busy_s"), F.count("duration_s").alias("timed"),
    )
    seconds = (F.unix_millis("w.end") - F.unix_millis("w.start")) / F.lit(1000.0)
    frames = steps.groupBy(F.window("step", window, slide).alias("w"), "endpoint").agg(
        *[F.sum(c).alias(c) for c in ("n", "errors", "successes", "busy_s", "timed")]
    )
    return frames.select(
        F.unix_millis("w.start").alias("window_start_ms"), "endpoint",
        (F.col("n") / seconds).alias("request_rate"), (F.col("errors") / seconds).alias("error_rate"),
        (F.col("successes") / seconds).alias("success_rate"),
        (F.try_divide(F.col("busy_s"), F.col("timed")) * 1000).alias("mean_latency_ms"),
    )
