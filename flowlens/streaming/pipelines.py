"""The streaming forms: detection, alert persistence, export, feed, windows; the rate limit is in limiter.py."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import feature_schema, settled, with_alert_explanation
from ..operators import alerts as A
from ..operators.features import _key_counts, window_rows, window_text
from ..operators.models import Detector, score_structured
from ..schemas import STORE_SCHEMAS
from ..session import cached, materialize, prepare
from ..sources.records import labeled_rows
from ..sources.store import AlertStore, day_of
from .limiter import ROCKSDB, rate_limit_stream  # noqa: F401

# State of many keys lies on disk and goes to the checkpoint as changes: the default provider holds all of it in the heap and writes it whole
# every ten batches, of which the last hundred are kept. Native memory is bounded for all partitions of an executor together.
ROCKSDB_OPTIONS = {"changelogCheckpointing.enabled": "true", "boundedMemoryUsage": "true", "maxMemoryUsageMB": "256"}


def window_identity(records: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Adds `window_id`, `start_ms`, `end_ms` and `payload_text` with their fallbacks.

    Without `now_ms` the time is the batch's, on a stream the micro-batch's; then many windows share it, and
    one without id and bounds is told apart by a hash of its content.
    """
    w = F.col("window")
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else F.lit(now_ms)
    start = F.coalesce(w["window_start_ms"], now)
    end = F.coalesce(w["window_end_ms"], start)
    given = [F.nullif(F.col("id"), F.lit("")), F.nullif(w["id"], F.lit(""))]
    bounds = F.concat_ws("-", "start_ms", "end_ms")
    if now_ms is None:
        unknown = w["window_start_ms"].isNull() & w["window_end_ms"].isNull()
        bounds = F.when(unknown, F.concat_ws("-", bounds, F.lower(F.hex(F.xxhash64(F.to_json("window")))))).otherwise(bounds)
    named = records.withColumns({"start_ms": start, "end_ms": end}).withColumn("window_id", F.coalesce(*given, bounds))
    texted = window_text(named, output="_generated")
    return texted.withColumn("payload_text", F.coalesce(F.nullif("text", F.lit("")), F.col("_generated"))).drop("_generated")


def build_alerts(scored: DataFrame, threshold: float | None = None, timestamp_ms: int | None = None) -> DataFrame:
    """Alert messages for scored windows that reach the effective threshold.

    `threshold` overrides the model's own one; without either it is 0.5. The alert time
    is the window end, unless given.
    """
    effective = F.lit(threshold) if threshold is not None else F.coalesce("threshold", F.lit(0.5))
    # Otherwise the filter would parse each window anew for every use of the score's inputs.
    settled_scores = scored.withColumns({"score": settled("score"), "threshold": effective.cast("double")})
    hit = settled_scores.filter(F.col("score") >= F.col("threshold"))
    explained = with_alert_explanation(hit, "window", "model", "score")
    at = F.col("end_ms") if timestamp_ms is None else F.lit(timestamp_ms).cast("bigint")
    return explained.select(
        F.lit("model_alert").alias("alert_type"), at.alias("timestamp"), "window_id", "window",
        feature_schema("window").alias("feature_schema"), F.lit(1).alias("model_label"),
        F.col("model").alias("model_type"), F.col("score").alias("model_score"), "threshold", "explanation_summary",
    )


def detect(
    records: DataFrame, detector: Detector | None, now_ms: int | None = None, threshold: float | None = None,
    timestamp_ms: int | None = None, scorer=None,
) -> DataFrame:
    """Records to alert messages; the same plan on a batch and on a stream. No shuffle is needed."""
    prepare(records.sparkSession)
    named = window_identity(records, now_ms)
    scored = scorer(named) if scorer else score_structured(named, detector)
    return build_alerts(scored, threshold, timestamp_ms)


def detect_stream(
    windows: DataFrame, detector: Detector | None, sink: str, checkpoint: str, threshold: float | None = None,
    scorer=None, available_now: bool = False, now_ms: int | None = None, **options,
):
    """Starts detection on a window stream, writing alerts to Kafka or to JSONL files.

    A window without bounds gets the time of its micro-batch, or `now_ms`.
    """
    alerts = detect(windows, detector, now_ms, threshold=threshold, scorer=scorer)
    return _start(alerts, sink, checkpoint, options, available_now)


def _start(rows: DataFrame, sink: str, checkpoint: str, options: dict, available_now: bool = False):
    if sink == "kafka":
        writer = rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).writeStream.format("kafka")
    else:
        writer = rows.writeStream.format("json").option("path", sink)
    writer = writer.options(**options).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# Columns of an alert message that the store takes.
MERGED = ("timestamp", "window_id", "model_type", "feature_schema", "model_score", "threshold", "explanation_summary")


def merge_batch(batch: DataFrame, batch_id: int, store: AlertStore, now=None) -> None:
    """Stores one batch of alert messages once per key, with one audit row per new alert.

    Repeating a batch rewrites the same folder from the same earlier batches. Only alerts
    in the time range of the batch are read for the comparison.
    """
    stamp = now if now is not None else batch.agg(F.max(F.timestamp_millis("timestamp"))).first()[0]
    rows = cached(batch.select(*MERGED).withColumn("triggered", F.col("model_score") >= F.col("threshold")))
    try:
        low, high = rows.agg(F.min("timestamp"), F.max("timestamp")).first()
        if low is None:
            return
        first_day, last_day = store.spark.range(1).select(day_of(F.lit(low)), day_of(F.lit(high))).first()
        near = store.load("alerts", before_batch=batch_id, days=lambda day: first_day <= day <= last_day).filter(F.col("timestamp").between(low, high))
        # Used several times below, so computed once.
        incoming = materialize(A.incoming_alerts(rows))
        added = materialize(A.added_alerts(near, incoming, stamp, store.last_alert_id(batch_id)))
        audit = A.append_audit(store.load("audit_log", before_batch=batch_id).limit(0), A.ingest_actions(added), stamp)
        last = A.last_id(store.load("audit_log", before_batch=batch_id))
        store.append_batch(added, A.backfilled_explanations(near, incoming, stamp), batch_id, audit.withColumn("id", F.col("id") + last))
    finally:
        rows.unpersist()


def suppress_repeats(alerts: DataFrame, within: str) -> DataFrame:
    """The first alert of each key (window, model, time); repeats go before they reach the store.

    A key is remembered until the watermark, `within` behind the latest alert, has passed its time; then its state goes. Alerts without a
    window id match nothing, as in the store, and all go on. Spark drops alerts that come with a time behind the watermark, so `within` must
    cover how late the source may be. The state is kept in RocksDB.
    """
    conf = alerts.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for name, value in ROCKSDB_OPTIONS.items():
        key = f"spark.sql.streaming.stateStore.rocksdb.{name}"
        if conf.get(key, None) is None:
            conf.set(key, value)
    named = F.coalesce("window_id", F.lit("")) != ""
    keyed = alerts.withColumns({
        "_at": F.timestamp_millis("timestamp"),
        "_window": F.when(named, F.col("window_id")).otherwise(F.uuid()),
    })
    return keyed.withWatermark("_at", within).dropDuplicatesWithinWatermark(["_window", "model_type", "timestamp"]).drop("_at", "_window")


def persist_stream(
    alerts: DataFrame, store: AlertStore, checkpoint: str, now=None, available_now: bool = False, repeats_within: str | None = None,
):
    """Writes an alert stream to the store: delivered at least once, stored once per key.

    With `repeats_within`, an interval such as `10 minutes`, repeats of an alert so close to it are dropped inside the stream.
    """
    if repeats_within is not None:
        alerts = suppress_repeats(alerts, repeats_within)
    # A batch arrives as computed rows: what is not stored, such as the parsed window, is left out before.
    writer = alerts.select(*MERGED).writeStream.foreachBatch(lambda batch, batch_id: merge_batch(batch, batch_id, store, now))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def export_stream(windows: DataFrame, path: str, checkpoint: str, seconds: float | None = None):
    """Writes windows as labeled dataset rows: all that are waiting, then it stops.

    With `seconds` it also takes what arrives until then and stops after that time at the latest. A bound
    on rows is the source's: `maxFilesPerTrigger`, or `maxOffsetsPerTrigger` for Kafka.
    """
    query = _start(labeled_rows(windows), path, checkpoint, {}, available_now=seconds is None)
    if seconds is not None and not query.awaitTermination(max(1, int(seconds))):
        query.processAllAvailable()
        query.stop()
    return query


def feed_stream(spark: SparkSession, store: AlertStore, since_id: int = 0) -> DataFrame:
    """Triggered alerts after `since_id`, as they reach the alert log."""
    log = spark.readStream.schema(STORE_SCHEMAS["alerts"]).parquet(store.log_path)
    return log.filter(F.col("triggered") & (F.col("id") > since_id)).select(STORE_SCHEMAS["alerts"].fieldNames())


def build_windows_stream(
    events: DataFrame, window_ms: int, dims: dict[str, str], watermark: str, time: str = "ts",
) -> DataFrame:
    """Tumbling windows of an event stream, each emitted once the watermark has passed its end.

    Counts per (window, value) come first, maps second, so a hot value is one state row.
    Events later than the watermark are dropped.
    """
    prepare(events.sparkSession)
    timed = events.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", watermark)
    counts = _key_counts(timed, F.window("_ts", f"{window_ms} milliseconds"), dims)
    return window_rows(counts, dims)
