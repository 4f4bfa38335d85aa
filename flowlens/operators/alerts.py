"""Alert tables: lists, statistics, merges, investigations, audit and the model registry.

Tables follow `STORE_SCHEMAS`. Every function takes and returns DataFrames; times
are arguments, so a rerun gives the same rows.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import INVESTIGATION_STATUSES, LEGACY_MODEL_TYPES, MODEL_TYPES
from ..schemas import STORE_SCHEMAS
from ..session import broadcast_if_small, held_tasks, materialize
from .ordering import with_row_index

ALERT_KEY = ["window_id", "model_type", "timestamp"]


# --- lists ---------------------------------------------------------------------

def _page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000, offset at least 0")
    return df.orderBy(*order).offset(offset).limit(limit)


def _where(df: DataFrame, **equals) -> DataFrame:
    for name, value in equals.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def list_alerts(alerts, model_type=None, triggered=None, limit=100, offset=0) -> DataFrame:
    """Newest alerts first, at most `limit` of them."""
    rows = _where(alerts, model_type=model_type or None, triggered=triggered)
    return _page(rows, [F.col("timestamp").desc(), F.col("id").desc()], limit, offset)


def alerts_between(alerts: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Alerts of a closed time range, newest first."""
    return alerts.filter(F.col("timestamp").between(start_ms, end_ms)).orderBy(
        F.col("timestamp").desc(), F.col("id").desc()
    )


def list_audit(audit, user_id=None, action=None, limit=100, offset=0) -> DataFrame:
    rows = _where(audit, user_id=user_id or None, action=action or None)
    return _page(rows, [F.col("created_at").desc(), F.col("id").desc()], limit, offset)


def list_models(models, model_type=None, active=None) -> DataFrame:
    rows = _where(models, model_type=model_type or None, active=active)
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc())


def list_investigations(investigations, status=None, limit=100, offset=0) -> DataFrame:
    if status is not None and status not in INVESTIGATION_STATUSES:
        raise ValueError(f"unknown status: {status}")
    rows = _where(investigations, status=status)
    return _page(rows, [F.col("created_at").desc(), F.col("id").desc()], limit, offset)


def get_by_id(df: DataFrame, row_id: int) -> DataFrame:
    return df.filter(F.col("id") == row_id)


def latest_incidents(alerts: DataFrame, n: int = 3) -> DataFrame:
    """The newest triggered alerts."""
    return list_alerts(alerts, triggered=True, limit=n)


def alert_feed(alerts: DataFrame, since_id: int = 0) -> DataFrame:
    """Every triggered alert after `since_id`, in id order; nothing is cut off by age."""
    return alerts.filter(F.col("triggered") & (F.col("id") > since_id)).orderBy("id")


def alert_investigations(alerts: DataFrame, investigations: DataFrame, alert_id=None) -> DataFrame:
    """Investigations of existing alerts, newest first."""
    asked = _where(investigations, alert_id=alert_id)
    rows = asked.join(_known_alerts(alerts, asked), "alert_id", "left_semi")
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc())


def _known_alerts(alerts: DataFrame, rows: DataFrame) -> DataFrame:
    """Ids of stored alerts among the `alert_id`s of `rows`: few ids go to the large table, not the other way round."""
    stored = alerts.select(F.col("id").alias("alert_id"))
    tasks = held_tasks(rows)
    ids = rows.select("alert_id")
    ids = (ids.repartition(tasks, "alert_id") if tasks else ids).distinct()
    sent = broadcast_if_small(ids)
    if sent is not ids:
        return stored.join(sent, "alert_id", "left_semi")
    # Ids pack to so few bytes that Spark would send millions of them to every task after all; the joins keep the tasks of the ids.
    return stored.join(ids.hint("merge"), "alert_id", "left_semi").hint("merge")


# --- counts and reports ------------------------------------------------------------

def alert_count(alerts, model_type=None, triggered=None) -> DataFrame:
    rows = _where(alerts, model_type=model_type or None, triggered=triggered)
    return rows.agg(F.count(F.lit(1)).alias("n"))


def alert_stats(alerts: DataFrame, now, hours: int = 24) -> DataFrame:
    """Alert count and mean score of the last hours: one row in total (`model` null), one per model."""
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
    return (
        alerts.filter(F.col("created_at") >= since)
        .select(F.col("model_type").alias("model"), "model_score").rollup("model")
        .agg(
            F.grouping("model").alias("is_total"), F.count(F.lit(1)).alias("count"),
            F.coalesce(F.avg("model_score"), F.lit(0.0)).alias("avg_score"),
        )
    )


HOUR_MS = 3_600_000


def hour_of(ts_ms) -> Column:
    return (F.floor(F.col(ts_ms) / F.lit(float(HOUR_MS))) * HOUR_MS).cast("bigint")


def threat_timeline(alerts: DataFrame, now_ms: int, hours: int = 24) -> DataFrame:
    """Hourly event and anomaly counts up to the current hour, empty hours included."""
    last = now_ms // HOUR_MS * HOUR_MS
    first = last - (hours - 1) * HOUR_MS
    in_range = (F.col("timestamp") >= first) & (F.col("timestamp") < last + HOUR_MS)
    anomaly = F.coalesce(F.col("triggered"), F.lit(False)) | (F.col("model_score") >= 0.8)
    counted = (
        alerts.filter(in_range).groupBy(hour_of("timestamp").alias("hour_ms"))
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(anomaly).alias("anomalies"))
    )
    buckets = alerts.sparkSession.range(first, last + 1, HOUR_MS).toDF("hour_ms")
    return (
        buckets.join(counted, "hour_ms", "left").na.fill(0, ["events", "anomalies"]).orderBy("hour_ms")
    )


def overview(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count(F.lit(1)).alias("alerts_recorded"),
        F.count_if(F.col("model_score") >= 0.8).alias("high_severity_alerts"),
    )


def model_confidence(model: DataFrame) -> DataFrame:
    """Accuracy of the active model in whole percent; null when unknown or zero."""
    percent = F.floor(F.col("accuracy") * 100 + F.lit(0.5)).cast("bigint")
    return model.select("model_type", F.when(F.col("accuracy") != 0, percent).alias("model_confidence"))


def hourly_performance(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(hour_of("timestamp").alias("hour_timestamp"), "model_type").agg(
        F.count(F.lit(1)).alias("alert_count"), F.avg("model_score").alias("avg_score")
    )


def current_status(investigations: DataFrame) -> DataFrame:
    """Status of the newest investigation of each alert."""
    return investigations.groupBy("alert_id").agg(
        F.max_by("status", F.struct("created_at", "id")).alias("status")
    )


def active_model(models: DataFrame, model_type: str | None = None) -> DataFrame:
    """The newest active model of a type; without a type structured, then external, then text."""
    wanted = [model_type] if model_type else list(MODEL_TYPES)
    priority = F.lit(len(wanted))
    for at, name in reversed(list(enumerate(wanted))):
        priority = F.when(F.col("model_type") == name, at).otherwise(priority)
    rows = models.filter(F.col("active") & F.col("model_type").isin(*wanted))
    return rows.orderBy(priority, F.col("created_at").desc(), F.col("id").desc()).limit(1)


# --- merges ----------------------------------------------------------------------------

def first_per_key(df: DataFrame, keys: list[str], order_by: list) -> DataFrame:
    """The first row of each key. Sums per key before the shuffle, so a hot key stays small."""
    order = F.struct(*order_by)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def new_alerts(batch: DataFrame, existing: DataFrame, keys: list[str] = ALERT_KEY) -> DataFrame:
    """Rows of `batch` whose key is not stored yet; a blank window id never matches.

    The stored table is first cut down to the keys of the batch, so a small batch
    is sent to the large table and never the other way round.
    """
    stored = existing.filter(F.length("window_id") > 0).select(*keys)
    met = stored.join(broadcast_if_small(batch.select(*keys)), keys, "left_semi")
    return batch.join(met, keys, "left_anti")


def last_id(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def _next_ids(rows: DataFrame, last: int, order_by: list[str]) -> DataFrame:
    indexed = with_row_index(rows, order_by)
    return indexed.withColumn("id", F.col("row_index") + 1 + last).drop("row_index")


def _columns(df: DataFrame, table: str) -> DataFrame:
    """`df` in the shape of a stored table; missing columns are null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in STORE_SCHEMAS[table].fields
    ])


def incoming_alerts(batch: DataFrame) -> DataFrame:
    """One row per key of a batch: the first arrival, with the first explanation given for the key.

    Rows with a blank window id are all kept. `arrival` orders the batch.
    """
    if "arrival" not in batch.columns:
        batch = batch.withColumn("arrival", F.col("timestamp"))
    for name in ("triggered", "feature_schema", "explanation_summary"):
        if name not in batch.columns:
            kind = STORE_SCHEMAS["alerts"][name].dataType
            batch = batch.withColumn(name, F.lit(None).cast(kind))
    keyed = batch.filter(F.length("window_id") > 0)
    # Ties in arrival are broken by content, so that a retried batch picks the same row.
    order = F.struct("arrival", "model_score", "threshold", "explanation_summary", "feature_schema")
    text = F.nullif("explanation_summary", F.lit(""))
    merged = keyed.groupBy(*ALERT_KEY).agg(
        F.min_by(F.struct("model_score", "threshold", "triggered", "feature_schema", "arrival"), order).alias("_r"),
        F.min_by(text, F.when(text.isNotNull(), order)).alias("explanation_summary"),
    ).select(*ALERT_KEY, "_r.*", "explanation_summary")
    blank = batch.filter(F.coalesce(F.length("window_id"), F.lit(0)) == 0).select(merged.columns)
    return merged.unionByName(blank)


def added_alerts(existing: DataFrame, incoming: DataFrame, now, last: int | None = None) -> DataFrame:
    """New rows for the alert table, with ids after `last`, by default the largest stored id."""
    last = last_id(existing) if last is None else last
    fresh = new_alerts(incoming, existing)
    stamped = fresh.withColumn(
        "triggered", F.coalesce(F.col("triggered"), F.col("model_score") >= F.col("threshold"))
    ).withColumns({"created_at": F.lit(now).cast("timestamp"), "updated_at": F.lit(now).cast("timestamp")})
    order = ["arrival", "timestamp", "window_id", "model_type", "model_score"]
    return _columns(_next_ids(stamped, last, order), "alerts")


def backfilled_explanations(existing: DataFrame, incoming: DataFrame, now) -> DataFrame:
    """(id, explanation_summary, updated_at) of stored alerts whose empty explanation is now known."""
    offered = incoming.filter(
        (F.length("window_id") > 0) & (F.length("explanation_summary") > 0)
    ).select(*ALERT_KEY, F.col("explanation_summary").alias("_text"))
    lacking = existing.filter(F.coalesce(F.length("explanation_summary"), F.lit(0)) == 0)
    matched = lacking.select("id", *ALERT_KEY).join(broadcast_if_small(offered), ALERT_KEY)
    # Only the first stored row of a key is filled in.
    return matched.groupBy(*ALERT_KEY).agg(F.min("id").alias("id"), F.first("_text").alias("explanation_summary")) \
        .select("id", "explanation_summary", F.lit(now).cast("timestamp").alias("updated_at"))


def apply_backfills(alerts: DataFrame, backfills: DataFrame) -> DataFrame:
    given = backfills.select(
        "id", F.col("explanation_summary").alias("_text"), F.col("updated_at").alias("_at")
    )
    joined = alerts.join(given, "id", "left")
    return joined.withColumns({
        "explanation_summary": F.coalesce("_text", "explanation_summary"),
        "updated_at": F.coalesce("_at", "updated_at"),
    }).select(alerts.columns)


def merge_alerts(existing: DataFrame, batch: DataFrame, now) -> DataFrame:
    """The alert table after a batch: first arrival of a key wins, empty explanations are filled in."""
    # Used by four joins below, so computed once.
    incoming = materialize(incoming_alerts(batch))
    kept = apply_backfills(existing, backfilled_explanations(existing, incoming, now))
    return kept.unionByName(added_alerts(existing, incoming, now))


def _apply_changes(table: DataFrame, changes: DataFrame, now, pick) -> DataFrame:
    fields = [c for c in changes.columns if c != "id"]
    unknown = set(fields) - set(table.columns)
    if unknown:
        raise ValueError(f"not in the table: {sorted(unknown)}")
    given = changes.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = table.join(broadcast_if_small(given), "id", "left")
    changed = {c: F.when(F.col("_hit"), pick(F.col(f"_new_{c}"), F.col(c))).otherwise(F.col(c)) for c in fields}
    changed["updated_at"] = F.when(F.col("_hit"), F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))
    return joined.withColumns(changed).select(table.columns)


def update_alerts(alerts: DataFrame, changes: DataFrame, now) -> DataFrame:
    """Applies `changes` (id plus the supplied columns, one row per id); a null in it leaves the value."""
    return _apply_changes(alerts, changes, now, lambda new, old: F.coalesce(new, old))


def update_investigations(investigations: DataFrame, changes: DataFrame, now) -> DataFrame:
    """As `update_alerts`; empty text leaves the old value too."""
    return _apply_changes(
        investigations, changes, now, lambda new, old: F.coalesce(F.nullif(new, F.lit("")), old)
    )


def append_audit(audit: DataFrame, actions: DataFrame, now) -> DataFrame:
    """Adds one audit row per action (`user_id`, `action`, `target`, optional `details`)."""
    stamped = actions.withColumn("created_at", F.lit(now).cast("timestamp"))
    return audit.unionByName(_columns(_next_ids(stamped, last_id(audit), ["action", "target", "user_id"]), "audit_log"))


def ingest_actions(alerts: DataFrame) -> DataFrame:
    """Audit actions for newly stored alerts."""
    label = F.col("triggered").cast("int")
    details = F.to_json(F.struct("window_id", "model_type", F.col("model_score").alias("score"), label.alias("label")))
    return alerts.select(
        F.lit("system:alert-router").alias("user_id"), F.lit("model_alert_ingested").alias("action"),
        F.concat(F.lit("alert:"), F.col("id").cast("string")).alias("target"), details.alias("details"),
    )


def create_investigations(investigations: DataFrame, new: DataFrame, alerts: DataFrame, now) -> DataFrame:
    """Adds investigations (`alert_id`, `user_id`, `status`, `notes`) of alerts that exist.

    A missing status is `open`; a row with a status outside the four known ones is an error.
    """
    status = F.coalesce("status", F.lit("open"))
    checked = F.when(status.isin(*INVESTIGATION_STATUSES), status).otherwise(
        F.raise_error(F.concat(F.lit("unknown status: "), status)).cast("string")
    )
    # Numbering counts, samples and sorts the rows, so they are joined once.
    rows = materialize(new.withColumn("status", checked).join(_known_alerts(alerts, new), "alert_id", "left_semi"))
    at = F.lit(now).cast("timestamp")
    stamped = rows.withColumns({"created_at": at, "updated_at": at})
    order = [c for c in ("alert_id", "user_id", "status", "notes") if c in stamped.columns]
    return investigations.unionByName(
        _columns(_next_ids(stamped, last_id(investigations), order), "alert_investigations")
    )


def investigation_actions(rows: DataFrame, action: str) -> DataFrame:
    """Audit actions for created (`create_investigation`) or changed (`update_investigation`) rows."""
    target = (
        F.concat(F.lit("alert:"), F.col("alert_id").cast("string")) if action == "create_investigation"
        else F.concat(F.lit("investigation:"), F.col("id").cast("string"))
    )
    return rows.select("user_id", F.lit(action).alias("action"), target.alias("target"))


def set_active_model(models: DataFrame, model_id: int) -> DataFrame:
    """Makes one model the only active one of its type; an unknown id changes nothing."""
    found = models.filter(F.col("id") == model_id).select("model_type").first()
    if found is None:
        return models
    same = F.col("model_type") == found[0]
    return models.withColumn("active", F.when(same, F.col("id") == model_id).otherwise(F.col("active")))


def registered_type(model_type) -> Column:
    """Current name of a model type; an unnamed model is the structured baseline."""
    raw = F.col(model_type) if isinstance(model_type, str) else model_type
    name = raw
    for old, new in LEGACY_MODEL_TYPES.items():
        name = F.when(raw == old, new).otherwise(name)
    return F.coalesce(name, F.lit("structured_baseline"))


def register_model(models: DataFrame, manifest: DataFrame, now, activate: bool = False) -> DataFrame:
    """Adds the model described by a one-row manifest; `activate` retires others of its type."""
    fields = manifest.schema
    def path(*names):
        kind, col = fields, None
        for name in names:
            if name not in kind.fieldNames():
                return F.lit(None)
            col, kind = (F.col(name) if col is None else col[name]), kind[name].dataType
        return col

    def metric(name):
        return F.coalesce(*[
            path("metrics", tier, *block, name).try_cast("double")
            for tier in ("structured_baseline", "text_tfidf") for block in (("holdout",), ())
        ])

    tag = F.coalesce(path("feature_text").cast("string"), path("feature_schema").cast("string"))
    version = F.concat_ws("_", F.concat(F.lit("v"), path("feature_version").cast("string")), tag)
    row = manifest.select(
        registered_type(path("model_type").cast("string")).alias("model_type"),
        F.coalesce(F.nullif(version, F.lit("")), F.lit("unknown")).alias("version"),
        metric("accuracy").alias("accuracy"), metric("positive_f1").alias("f1_score"),
        metric("roc_auc").alias("roc_auc"), path("n_samples").cast("bigint").alias("n_samples"),
        F.lit(activate).alias("active"),
        F.to_json(F.struct(
            F.coalesce(path("quality_gate", "promotion_ready").cast("boolean"), F.lit(False)).alias("promotion_ready"),
            tag.alias("feature_schema"),
            path("quality_gate", "observed", "holdout_source").cast("string").alias("holdout_source"),
        )).alias("model_metadata"),
        F.lit(now).cast("timestamp").alias("created_at"),
    )
    row = row.withColumn("id", F.lit(last_id(models) + 1))
    if activate:
        kind = row.select("model_type").first()[0]
        models = models.withColumn("active", F.when(F.col("model_type") == kind, False).otherwise(F.col("active")))
    return models.unionByName(_columns(row, "models"))


def merge_by_id(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace current ones with the same id; largest id first."""
    kept = current.join(incoming.select("id"), "id", "left_anti").select(current.columns)
    return kept.unionByName(incoming.select(current.columns)).orderBy(F.col("id").desc())


def route_by_family(
    df: DataFrame, family_thresholds: DataFrame, default_threshold: float, family: str = "family",
) -> DataFrame:
    """Adds `routed_model` and `threshold`; a family threshold counts only where the family has a model.

    `family_thresholds` has `family`, `threshold` and `has_model`, one row per family.
    """
    table = family_thresholds.select(
        F.col("family").alias(family), F.col("threshold").alias("_t"), F.col("has_model").alias("_m")
    )
    joined = df.join(broadcast_if_small(table), family, "left")
    own = F.coalesce("_m", F.lit(False))
    return joined.withColumns({
        "routed_model": F.when(own, F.col(family)).otherwise("global"),
        "threshold": F.when(own, F.coalesce("_t", F.lit(default_threshold))).otherwise(F.lit(default_threshold)),
    }).drop("_t", "_m")
