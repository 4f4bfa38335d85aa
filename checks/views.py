"""Flow, record, alert and request tables derived from the driver's `events`.

The same SQL text feeds Spark and the check database; only the token {MS} differs.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.constants import DATASET_ORIGIN, FEATURE_SCHEMA
from flowlens.schemas import METADATA_SCHEMA, WINDOW_SCHEMA, build_struct
from flowlens.session import prepare, spread

FLOWS = """
SELECT event_id AS flow_id, {MS} AS start_ms, {MS} + 10000 AS end_ms,
  concat('10.0.0.', CAST(user_id % 50 AS VARCHAR(9))) AS srcip,
  concat('192.168.1.', CAST(event_id % 20 AS VARCHAR(9))) AS dstip,
  CASE event_id % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' ELSE 'icmp' END AS proto,
  event_type AS service,
  CASE event_id % 4 WHEN 0 THEN 'con' WHEN 1 THEN 'fin' WHEN 2 THEN 'int' ELSE 'req' END AS state,
  CASE WHEN event_id % 13 = 0 THEN 0.0e0 ELSE value / 10.0e0 END AS dur,
  value * 100.0e0 AS sbytes,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value * 25.0e0 END AS dbytes,
  CAST(event_id % 17 AS DOUBLE) AS spkts, CAST(event_id % 11 AS DOUBLE) AS dpkts,
  1 + event_id % 3 AS event_count,
  CASE event_id % 3 WHEN 0 THEN 'src_a' WHEN 1 THEN 'src_b' ELSE 'src_c' END AS dataset_source,
  CASE event_id % 6 WHEN 0 THEN 'metadata' WHEN 1 THEN 'dataset_ground_truth' WHEN 2 THEN 'external_heuristic'
    WHEN 3 THEN 'legacy_rule' WHEN 4 THEN '' ELSE 'unknown' END AS label_source,
  CASE event_type WHEN 'error' THEN 'attack' WHEN 'signup' THEN ' TRUE ' WHEN 'view' THEN '0'
    WHEN 'click' THEN 'benign' ELSE 'maybe' END AS raw_label,
  CASE WHEN event_type IN ('error','signup') THEN 1 ELSE 0 END AS label,
  CASE event_type WHEN 'error' THEN 'DoS' WHEN 'signup' THEN 'Recon' ELSE NULL END AS attack_cat,
  value / (value + 20.0e0) AS score
FROM events
"""

# Labels in every place a record may carry one.
RECORDS = """
SELECT *,
  CASE WHEN flow_id % 10 < 3 THEN raw_label END AS rec_label,
  CASE WHEN flow_id % 5 = 0 THEN raw_label END AS meta_label,
  CASE flow_id % 7 WHEN 0 THEN 'attack' WHEN 1 THEN 'normal' END AS gt_label,
  CASE WHEN flow_id % 4 = 1 THEN flow_id % 3 END AS malicious,
  CASE WHEN flow_id % 8 = 1 THEN 1 END AS benign,
  CASE WHEN flow_id % 9 = 2 THEN flow_id % 2 END AS type_attack,
  CASE WHEN flow_id % 11 = 3 THEN flow_id % 2 END AS family_count,
  CASE flow_id % 6 WHEN 0 THEN 'High' WHEN 1 THEN 'odd' END AS tier,
  CASE WHEN flow_id % 12 = 5 THEN NULL ELSE 'campaign_' || CAST(flow_id % 40 AS VARCHAR(9)) END AS campaign
FROM flows
"""

ALERTS = """
SELECT flow_id AS id, start_ms AS timestamp, concat('w', CAST(flow_id % 5000 AS VARCHAR(9))) AS window_id,
  CASE flow_id % 3 WHEN 0 THEN 'structured_baseline' WHEN 1 THEN 'distilbert' ELSE 'tfidf_fallback' END AS model_type,
  'network_flow_v1' AS feature_schema,
  score AS model_score, 0.5e0 AS threshold, score >= 0.5e0 AS triggered,
  CASE WHEN flow_id % 4 = 0 THEN NULL ELSE concat('flow | proto=', proto, ' | state=', state) END AS explanation_summary
FROM flows
"""

INVESTIGATIONS = """
SELECT id * 2 + k AS id, id AS alert_id, concat('analyst_', CAST(id % 3 AS VARCHAR(9))) AS user_id,
  CASE (id + k) % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'investigating' WHEN 2 THEN 'resolved' ELSE 'false_positive' END AS status,
  CASE WHEN k = 0 THEN 'first look' END AS notes, timestamp + k * 60000 AS created_ms
FROM (SELECT *, {EXPLODE} AS k FROM alerts) t WHERE k = 0 OR triggered
"""

REQUESTS = """
SELECT event_id AS request_id, {MS} AS ts_ms, concat('/', event_type) AS endpoint, user_id,
  CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 9 = 0 THEN 404 ELSE 200 END AS status,
  value / 1000.0e0 AS duration_s
FROM events
"""

VIEWS = {"flows": FLOWS, "records": RECORDS, "alerts": ALERTS, "investigations": INVESTIGATIONS, "requests": REQUESTS}
SPARK_TOKENS = {"{MS}": "unix_millis(CAST(ts AS TIMESTAMP))", "{EXPLODE}": "explode(array(0, 1))"}
CHECK_TOKENS = {"{MS}": "(epoch_us(ts) // 1000)", "{EXPLODE}": "unnest([0, 1])"}


def _filled(text: str, tokens: dict) -> str:
    for token, value in tokens.items():
        text = text.replace(token, value)
    return text


def check_sql(body: str) -> str:
    """`body` with every view in front of it."""
    ctes = ", ".join(f"{name} AS ({_filled(text, CHECK_TOKENS)})" for name, text in VIEWS.items())
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


SOURCE = {"flows": "events", "records": "flows", "alerts": "flows", "investigations": "alerts", "requests": "events"}


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    source = SOURCE[name]
    below = view(spark, sf, source) if source in VIEWS else table(spark, sf, source)
    text = _filled(VIEWS[name], SPARK_TOKENS).replace(f"FROM {source}", "FROM {source}")
    return spark.sql(text, source=below)


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Nested records of the flows, with `flow_id` kept."""
    rec = spread(view(spark, sf, "records"))
    c = F.col
    one = F.lit(1).cast("bigint")
    counts = lambda *pairs: F.create_map(*[x for k, v in pairs for x in (F.lit(k), v.cast("bigint"))])
    ground_truth = F.when(c("gt_label").isNotNull(), F.to_json(F.struct(c("gt_label").alias("label"))))
    window = build_struct(WINDOW_SCHEMA, {
        "window_start_ms": c("start_ms"), "window_end_ms": c("end_ms"), "event_count": c("event_count"),
        **{n: c(n) for n in ("srcip", "dstip", "proto", "service", "state")},
        **{n: c(n) for n in ("dur", "sbytes", "dbytes", "spkts", "dpkts")},
        "counts_by_service": F.when(
            c("flow_id") % 2 == 0, F.create_map(c("service"), F.lit(2).cast("bigint"), F.lit("other"), one)),
        "ground_truth": ground_truth,
        "simulation_malicious_event_count": c("malicious"), "simulation_benign_event_count": c("benign"),
        "simulation_counts_by_type": F.when(c("type_attack").isNotNull(), counts(("attack", c("type_attack")), ("benign", one))),
        "simulation_counts_by_attack_family": F.when(c("family_count").isNotNull(), counts(("Flood", c("family_count")))),
        "metadata": build_struct(METADATA_SCHEMA, {
            "dataset_origin": F.lit(DATASET_ORIGIN), "feature_schema": F.lit(FEATURE_SCHEMA),
            "attack_cat": c("attack_cat"), "label": c("meta_label"), "campaign_signature": c("campaign"),
            "attack_family": F.lower(c("attack_cat")),
        }),
    })
    return rec.select(
        "flow_id", c("flow_id").cast("string").alias("id"), c("rec_label").alias("label"), "label_source",
        c("tier").alias("label_quality_tier"), "dataset_source", c("start_ms").alias("window_start_ms"),
        c("end_ms").alias("window_end_ms"), F.lit(None).cast("string").alias("text"), window.alias("window"),
    )


def stored_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts in the shape of the alert table."""
    at = F.timestamp_millis("timestamp")
    return view(spark, sf, "alerts").withColumns({"created_at": at, "updated_at": at})


def stored_investigations(spark: SparkSession, sf: str) -> DataFrame:
    at = F.timestamp_millis("created_ms")
    return view(spark, sf, "investigations").withColumns({"created_at": at, "updated_at": at}).drop("created_ms")
