import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowlens.functions.columns import severity
from flowlens.operators import alerts as A
from flowlens.schemas import ALERT_MESSAGE_SCHEMA, STORE_SCHEMAS
from flowlens.sources import records as SRC
from flowlens.sources.store import AlertStore
from flowlens.streaming import pipelines as ST
from tests.conftest import FLOW

NOW = "2024-01-02 00:00:00"
BATCH = "timestamp long, window_id string, model_type string, model_score double, threshold double, explanation_summary string, arrival long"


@pytest.fixture
def stored(spark):
    rows = [(1, 100, "w1", "m", None, 0.9, 0.5, True, None, None, None), (2, 200, "w2", "m", None, 0.2, 0.5, False, "known", None, None),
            (3, 100, "w1", "m", None, 0.9, 0.5, True, None, None, None), (4, 50, "", "m", None, 0.7, 0.5, True, None, None, None)]
    return spark.createDataFrame(rows, STORE_SCHEMAS["alerts"])


def test_merge_alerts(spark, stored):
    batch = spark.createDataFrame([
        (100, "w1", "m", 0.1, 0.5, None, 1), (100, "w1", "m", 0.1, 0.5, "because", 2), (200, "w2", "m", 0.1, 0.5, "other", 3),
        (300, "w9", "m", 0.6, 0.5, None, 5), (300, "w9", "m", 0.4, 0.5, "late", 6), (50, "", "m", 0.3, 0.5, None, 4), (50, "", "m", 0.3, 0.5, None, 4),
    ], BATCH)
    rows = A.merge_alerts(stored, batch, NOW).orderBy("id").collect()
    assert [(r["id"], r["window_id"], r["explanation_summary"]) for r in rows] == [
        (1, "w1", "because"), (2, "w2", "known"), (3, "w1", None), (4, "", None), (5, "", None), (6, "", None), (7, "w9", "late")]
    assert rows[0]["updated_at"] is not None and rows[1]["updated_at"] is None
    assert rows[6]["model_score"] == 0.6 and rows[6]["triggered"] and not rows[4]["triggered"]


def test_lists_and_bounds(stored):
    assert [r["id"] for r in A.list_alerts(stored, triggered=True, limit=2).collect()] == [3, 1]
    assert [r["id"] for r in A.alerts_between(stored, 100, 200).collect()] == [2, 3, 1]
    assert [r["id"] for r in A.alert_feed(stored, 1).collect()] == [3, 4]
    with pytest.raises(ValueError):
        A.list_alerts(stored, limit=1001)
    with pytest.raises(ValueError):
        A.list_investigations(stored, status="closed")


def test_investigations(spark, stored):
    empty = spark.createDataFrame([], STORE_SCHEMAS["alert_investigations"])
    new = spark.createDataFrame([(1, "u", None, "a"), (99, "u", "open", "b"), (2, "v", "resolved", "c")], "alert_id long, user_id string, status string, notes string")
    made = A.create_investigations(empty, new, stored, NOW)
    assert [(r["id"], r["alert_id"], r["status"]) for r in made.orderBy("id").collect()] == [(1, 1, "open"), (2, 2, "resolved")]
    bad = spark.createDataFrame([(1, "u", "closed", "a")], new.schema)
    with pytest.raises(Exception, match="unknown status"):
        A.create_investigations(empty, bad, stored, NOW).collect()
    changed = A.update_investigations(made, spark.createDataFrame([(1, "", "seen")], "id long, status string, notes string"), "2024-01-03 00:00:00")
    row = changed.filter("id = 1").first()
    assert (row["status"], row["notes"], str(row["updated_at"])) == ("open", "seen", "2024-01-03 00:00:00")
    assert A.alert_investigations(stored, made, 77).count() == 0
    later = spark.createDataFrame([(9, 1, "u", "false_positive", None, None, None)], STORE_SCHEMAS["alert_investigations"]).withColumn("created_at", F.lit("2024-02-01").cast("timestamp"))
    assert {r["alert_id"]: r["status"] for r in A.current_status(made.unionByName(later)).collect()} == {1: "false_positive", 2: "resolved"}


def test_update_alerts_and_audit(spark, stored):
    changed = A.update_alerts(stored, spark.createDataFrame([(2, "new")], "id long, explanation_summary string"), NOW)
    assert {r["id"]: r["explanation_summary"] for r in changed.collect()} == {1: None, 2: "new", 3: None, 4: None}
    with pytest.raises(ValueError):
        A.update_alerts(stored, spark.createDataFrame([(2, "x")], "id long, nope string"), NOW)
    audit = A.append_audit(spark.createDataFrame([], STORE_SCHEMAS["audit_log"]), A.ingest_actions(stored), NOW)
    row = audit.orderBy("id").first()
    assert (row["id"], row["user_id"], row["target"]) == (1, "system:alert-router", "alert:1") and json.loads(row["details"])["window_id"] == "w1"


def test_models_table(spark):
    empty = spark.createDataFrame([], STORE_SCHEMAS["models"])
    text = '{"model_type": "tfidf", "n_samples": 5, "feature_schema": "s1", "metrics": {"text_tfidf": {"positive_f1": 0.0, "accuracy": 0.5}}, "quality_gate": {"promotion_ready": true, "observed": {"holdout_source": "b"}}}'
    manifest = spark.read.json(spark.sparkContext.parallelize([text]))
    one = A.register_model(empty, manifest, "2024-01-01 00:00:00", activate=True)
    two = A.register_model(one, manifest, "2024-01-02 00:00:00", activate=True)
    rows = two.orderBy("id").collect()
    assert [(r["id"], r["model_type"], r["version"], r["f1_score"], r["active"]) for r in rows] == [
        (1, "tfidf_fallback", "s1", 0.0, False), (2, "tfidf_fallback", "s1", 0.0, True)]
    assert json.loads(rows[0]["model_metadata"])["holdout_source"] == "b" and rows[0]["roc_auc"] is None
    assert [r["id"] for r in A.set_active_model(two, 1).filter("active").collect()] == [1]
    assert A.active_model(two).first()["id"] == 2 and A.active_model(two, "distilbert").count() == 0


def test_timeline_fills_empty_hours(spark, stored):
    rows = A.threat_timeline(stored, 7_200_001, 3).collect()
    assert [(r["hour_ms"], r["events"], r["anomalies"]) for r in rows] == [(0, 4, 3), (3_600_000, 0, 0), (7_200_000, 0, 0)]


def test_store_versions_and_incomplete_snapshot(spark, stored, tmp_path):
    store = AlertStore(spark, str(tmp_path))
    assert store.load("models").count() == 0
    store.save("alerts", stored)
    store.save("alerts", store.load("alerts").filter("id < 3"))
    (tmp_path / "alerts" / "version=3").mkdir()
    assert sorted(r["id"] for r in store.load("alerts").collect()) == [1, 2]


def _score(df):
    return df.withColumns({"score": F.coalesce(F.col("window.sbytes"), F.lit(0.0)) / 2000.0, "model": F.lit("structured_baseline"), "threshold": F.lit(0.5)})


def _write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows) + "broken\n")


def test_detect_uses_the_effective_threshold(records):
    rows = records({"id": "a", "window": {**FLOW, "window_start_ms": 1, "window_end_ms": 9}}, {"id": "b", "window": {**FLOW, "sbytes": 100}},
                   {"window_start_ms": 5, "window_end_ms": 6, "sbytes": 1900, "text": "given"})
    alerts = ST.detect(rows, None, now_ms=77, scorer=_score).collect()
    assert [(r["window_id"], r["timestamp"], r["model_label"], r["threshold"]) for r in alerts] == [("a", 9, 1, 0.5), ("5-6", 6, 1, 0.5)]
    assert ST.detect(rows, None, threshold=0.75, scorer=_score).count() == 1
    named = ST.window_identity(rows, 77).collect()
    assert (named[1]["start_ms"], named[1]["end_ms"], named[2]["payload_text"]) == (77, 77, "given")


def test_detect_persist_feed(spark, tmp_path):
    window = lambda i, b: {"id": f"w{i}", "window": {**FLOW, "sbytes": b, "window_start_ms": i, "window_end_ms": i + 10}}
    _write(tmp_path / "in", "1.jsonl", [window(i, 1500 if i % 2 else 10) for i in range(10)])
    store = AlertStore(spark, str(tmp_path / "store"))

    def run():
        ST.detect_stream(SRC.read_window_stream(spark, str(tmp_path / "in")), None, str(tmp_path / "alerts"), str(tmp_path / "c1"),
                         scorer=_score, available_now=True).awaitTermination()
        ST.persist_stream(SRC.read_alert_stream(spark, str(tmp_path / "alerts")), store, str(tmp_path / "c2"), NOW, True).awaitTermination()

    run()
    first = store.load("alerts").orderBy("id").collect()
    assert [(r["id"], r["window_id"]) for r in first] == [(i + 1, f"w{2 * i + 1}") for i in range(5)]
    # The same windows again, and one more: known keys are not stored twice.
    _write(tmp_path / "in", "2.jsonl", [window(i, 1500) for i in (1, 3, 20)])
    run()
    assert sorted((r["id"], r["window_id"]) for r in store.load("alerts").collect())[5:] == [(6, "w20")]
    # Repeating a batch changes nothing.
    batch = SRC.parse_alerts(spark.read.text(str(tmp_path / "alerts")))
    ST.merge_batch(batch, 1, store, NOW)
    assert sorted(r["id"] for r in store.load("alerts").collect()) == [1, 2, 3, 4, 5, 6]
    feed = ST.feed_stream(spark, store, 3).writeStream.format("memory").queryName("feed").trigger(availableNow=True).start()
    feed.awaitTermination()
    assert sorted(r["id"] for r in spark.table("feed").collect()) == [4, 5, 6]


def test_late_explanation_is_filled_in(spark, tmp_path):
    store = AlertStore(spark, str(tmp_path))
    message = lambda text: spark.createDataFrame([("model_alert", 5, "w", None, None, 1, "m", 0.9, 0.5, text)], ALERT_MESSAGE_SCHEMA)
    ST.merge_batch(message(None), 0, store, NOW)
    ST.merge_batch(message("why"), 1, store, "2024-01-05 00:00:00")
    ST.merge_batch(message("later"), 2, store, NOW)
    rows = store.load("alerts").collect()
    assert [(r["id"], r["explanation_summary"], str(r["updated_at"])) for r in rows] == [(1, "why", "2024-01-05 00:00:00")]


def test_export_stream(spark, tmp_path):
    _write(tmp_path / "in", "1.jsonl", [{**FLOW, "window_start_ms": 1, "window_end_ms": 2, "metadata": {"label": 1}}, {**FLOW, "window_start_ms": 3, "window_end_ms": 4}])
    ST.export_stream(SRC.read_window_stream(spark, str(tmp_path / "in"), "earliest"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.json(str(tmp_path / "out")).select("id", "label", "label_quality_tier").collect()
    assert sorted(map(tuple, got)) == [("1-2", 1, "high"), ("3-4", 0, "low")]
    records = SRC.read_records(spark, str(tmp_path / "out"))
    SRC.write_dataset(records, str(tmp_path / "copy"), 1)
    assert spark.read.json(str(tmp_path / "copy")).count() == 1


def test_rate_limit_stream_state_spans_batches(spark, tmp_path):
    r = random.Random(5)
    rows = sorted(((int(r.random() * 60_000), f"k{i % 3}", i) for i in range(120)))
    schema = "ts_ms long, key string, request_id long"
    for part, chunk in enumerate((rows[:50], rows[50:])):
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ST.rate_limit_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 4, 5)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")) \
            .trigger(availableNow=True).start().awaitTermination()
    times, expected = defaultdict(list), {}
    for t, key, rid in rows:
        times[key] = [x for x in times[key] if x > t - 5000]
        expected[rid] = len(times[key]) < 4
        if expected[rid]:
            times[key].append(t)
    assert {x["request_id"]: x["accepted"] for x in spark.read.parquet(str(tmp_path / "out")).collect()} == expected


def _limited(spark, folder, *args, **options):
    stream = ST.rate_limit_stream(spark.readStream.schema("ts_ms long, key string, request_id long").option("maxFilesPerTrigger", 1).parquet(str(folder / "in")), *args, **options)
    query = stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _replayed(rows, limit, width):
    times, accepted = defaultdict(list), {}
    for t, key, rid in rows:
        times[key] = [x for x in times[key] if x > t - width]
        accepted[rid] = len(times[key]) < limit
        if accepted[rid]:
            times[key].append(t)
    return accepted


def test_rate_limit_stream_forgets_quiet_keys(spark, tmp_path):
    """Two keys fall quiet; once the watermark has passed their windows their state is gone."""
    quiet = [(1000 + i, f"quiet{i % 2}", i) for i in range(6)]
    busy = [(t, "busy", 100 + i) for i, t in enumerate(range(100_000, 400_000, 10_000))]
    for i, chunk in enumerate((quiet, busy[:15], busy[15:])):
        spark.createDataFrame(chunk, "ts_ms long, key string, request_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = _limited(spark, tmp_path, 2, 5, lateness="20 seconds")
    rows = [p["stateOperators"][0]["customMetrics"] for p in map(dict, query.recentProgress) if p["stateOperators"]]
    assert {r["request_id"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == _replayed(quiet + busy, 2, 5000)
    left = spark.read.format("statestore").option("stateVarName", "times").load(str(tmp_path / "c"))
    keys = {r["key"][0] for r in left.select("key").collect()}
    assert keys <= {"busy"} and rows


def test_rate_limit_stream_with_a_hot_key(spark, tmp_path):
    """One key over many Arrow batches, out of order and with equal times, is taken by time whether it fits in memory or not."""
    r = random.Random(9)
    rows = [(50 + int(r.random() * 300_000) // 50 * 50, "hot" if r.random() < 0.9 else f"k{i % 5}", i) for i in range(6000)]
    ordered = sorted(rows, key=lambda x: (x[0], x[2]))
    expected = _replayed(ordered, 5, 3000)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        for name, held in (("memory", 1_000_000), ("aside", 700)):
            folder = tmp_path / name
            folder.mkdir()
            spark.createDataFrame(rows, "ts_ms long, key string, request_id long").repartition(4).coalesce(1).write.parquet(str(folder / "in"))
            _limited(spark, folder, 5, 3, held_rows=held)
            assert {x["request_id"]: x["accepted"] for x in spark.read.parquet(str(folder / "out")).collect()} == expected, name
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_rate_limit_stream_of_odd_rows(spark, tmp_path):
    rows = [(10, None, 1), (10, None, None), (None, "a", 2), (10, "a", 3), (10, "a", 3), (11, "a", 4)]
    spark.createDataFrame(rows, "ts_ms long, key string, request_id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    _limited(spark, tmp_path, 1, 5)
    got = sorted((r["key"], str(r["request_id"]), r["accepted"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "3", False), ("a", "3", True), ("a", "4", False), ("unknown", "1", True), ("unknown", "None", False)]


def test_repeats_end_inside_the_stream(spark, tmp_path):
    day = 86_400_000
    batches = [[(5, "a"), (6, "b"), (5, "a")], [(6, "b"), (7, "a"), (5, ""), (5, "")], [(40 * day, "a")], [(40 * day + 1, "z"), (40 * day, "a")]]
    for rows in batches:
        _messages(spark, *rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ALERT_MESSAGE_SCHEMA).parquet(str(tmp_path / "in"))
        query = ST.suppress_repeats(stream, "2 days").writeStream.format("parquet").option("path", str(tmp_path / "out")) \
            .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((r["timestamp"], r["window_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(5, ""), (5, ""), (5, "a"), (6, "b"), (7, "a"), (40 * day, "a"), (40 * day + 1, "z")]
    # What lies behind the watermark is forgotten.
    held = spark.read.format("statestore").load(str(tmp_path / "c")).count()
    assert held <= 2


def test_repeats_are_remembered_as_changes_on_disk(spark, tmp_path):
    from flowlens.sources.records import read_alert_stream, write_alerts

    rows = _messages(spark, *[(i, f"w{i % 40}") for i in range(1, 61)])
    for _ in range(2):
        write_alerts(rows.coalesce(1), str(tmp_path / "in"), compression="gzip")
    assert {p.suffix for p in (tmp_path / "in").glob("part-*")} == {".gz"}
    stream = ST.suppress_repeats(read_alert_stream(spark, str(tmp_path / "in"), maxFilesPerTrigger=1), "2 days")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    query.trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["timestamp"], r["window_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((i, f"w{i % 40}") for i in range(1, 61))
    kinds = {p.suffix for p in (tmp_path / "c" / "state").rglob("*.*") if not p.name.startswith(".")}
    assert ".changelog" in kinds and not kinds & {".delta", ".snapshot"}


def test_first_rows_of_files(spark, tmp_path):
    for name, n in (("b", 40), ("a", 25), ("c", 0)):
        lines = [json.dumps({"id": f"{name}{i}", "window": {"sbytes": i}}) if i % 5 else "no json" for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    every = [f"{name}{i}" for name, n in (("b", 40), ("a", 25)) for i in range(n) if i % 5]
    paths = [str(tmp_path / f"{name}.jsonl") for name in "bac"]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        for n in (0, 1, 17, 32, 33, 52, 900):
            rows = SRC.read_records(spark, paths, n) if n else SRC.read_records(spark, paths)
            assert sorted(r["id"] for r in rows.collect()) == sorted(every[:n or None])
        SRC.write_dataset(SRC.read_records(spark, paths, placed=True), str(tmp_path / "out"), 40)
        out = spark.read.json(str(tmp_path / "out"))
        assert sorted(r["id"] for r in out.collect()) == sorted(every[:40])
        assert "_path" not in out.columns and len(list((tmp_path / "out").glob("part-*.json"))) > 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    SRC.write_dataset(spark.range(0, 100, 1, 10), str(tmp_path / "plain"), 33)
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "plain")).collect()) == [*range(33)]
    SRC.write_dataset(spark.range(5).limit(0), str(tmp_path / "none"), 3)
    assert spark.read.schema("id long").json(str(tmp_path / "none")).count() == 0


def _size(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_a_change_is_written_alone_and_folded_in_by_day(spark, tmp_path):
    store, day = AlertStore(spark, str(tmp_path)), 86_400_000
    rows = [(i, i % 10 * day + i, f"w{i}", "m", None, 0.9, 0.5, True, None) for i in range(1, 2001)]
    alerts = spark.createDataFrame(rows, "id long, timestamp long, window_id string, model_type string, feature_schema string, model_score double, threshold double, triggered boolean, explanation_summary string") \
        .withColumns({"created_at": F.lit(NOW).cast("timestamp"), "updated_at": F.lit(NOW).cast("timestamp")})
    store.save("alerts", alerts)
    assert store.days("alerts") == {f"1970-01-{d + 1:02d}": 1 for d in range(10)}
    at = "2024-02-01 00:00:00"
    store.change("alerts", spark.createDataFrame([(7, "seen", None), (999_999, "lost", None)], "id long, explanation_summary string, model_score double"), at)
    store.change("alerts", spark.createDataFrame([(7, 0.1), (18, 0.2)], "id long, model_score double"), "2024-02-02 00:00:00")
    assert _size(tmp_path / "alerts_changes") < _size(tmp_path / "alerts") / 5

    def listed():
        return {r["id"]: (r["explanation_summary"], r["model_score"], str(r["updated_at"])[:10]) for r in store.load("alerts").collect()}

    want = {i: (None, 0.9, NOW[:10]) for i in range(1, 2001)} | {7: ("seen", 0.1, "2024-02-02"), 18: (None, 0.2, "2024-02-02")}
    assert listed() == want
    assert {r["id"] for r in store.load("alerts", days="1970-01-08".__eq__).collect()} == {i for i in range(1, 2001) if i % 10 == 7}
    # Two days hold changed rows; the others are not written again.
    assert store.compact("alerts") == ["1970-01-08", "1970-01-09"]
    assert {d: v for d, v in store.days("alerts").items() if v == 2} == {"1970-01-08": 2, "1970-01-09": 2}
    assert listed() == want and store.compact("alerts") == []
    # A stream's batch, and a change to one of its rows.
    ST.merge_batch(_messages(spark, (3 * day, "new"), (40 * day, "late")), 0, store, NOW)
    store.change("alerts", spark.createDataFrame([(2001, "why")], "id long, explanation_summary string"), at)
    assert store.compact("alerts") == ["1970-01-04", "1970-02-10"]
    got = {r["window_id"]: r["explanation_summary"] for r in store.load("alerts").filter("id > 2000").collect()}
    assert got == {"new": "why", "late": None} and store.load("alerts").count() == 2002
    for bad in ("timestamp", "no_such"):
        with pytest.raises(ValueError):
            store.change("alerts", spark.createDataFrame([(1, 5)], f"id long, {bad} long"), NOW)


def test_changes_of_investigations_keep_values_where_the_text_is_empty(spark, tmp_path):
    store = AlertStore(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, 5, "u", "open", "n"), (2, 5, "u", "open", None)], "id long, alert_id long, user_id string, status string, notes string")
    store.save("alert_investigations", rows.withColumns({"created_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(NOW).cast("timestamp")}))
    changes = spark.createDataFrame([(1, "resolved", ""), (2, "", "seen")], "id long, status string, notes string")
    plain = A.update_investigations(store.load("alert_investigations"), changes, NOW).collect()
    store.change("alert_investigations", changes, NOW)
    assert sorted(store.load("alert_investigations").collect()) == sorted(plain)
    assert store.compact("alert_investigations") == ["none"] and sorted(store.load("alert_investigations").collect()) == sorted(plain)
    assert store.compact("models") == [] and store.load("models").count() == 0


def test_severity(one):
    assert [one(severity(F.lit(x))) for x in (0.81, 0.8, 0.6)] == ["threat", "anomaly", "insight"]


def _messages(spark, *rows):
    return spark.createDataFrame([("model_alert", t, w, None, None, 1, "m", 0.9, 0.5, None) for t, w in rows], ALERT_MESSAGE_SCHEMA)


def test_store_updated_and_compacted_between_batches(spark, tmp_path):
    store = AlertStore(spark, str(tmp_path))
    listed = lambda: sorted((r["id"], r["window_id"], r["explanation_summary"]) for r in store.load("alerts").collect())
    ST.merge_batch(_messages(spark, (5, "a"), (6, "b")), 0, store, NOW)
    changes = spark.createDataFrame([(1, "seen")], "id long, explanation_summary string")
    store.save("alerts", A.update_alerts(store.load("alerts"), changes, NOW))
    assert listed() == [(1, "a", "seen"), (2, "b", None)]
    ST.merge_batch(_messages(spark, (6, "b"), (7, "c")), 1, store, NOW)
    assert listed() == [(1, "a", "seen"), (2, "b", None), (3, "c", None)]
    store.compact()
    # A retry after the batch was folded in, then a new batch.
    ST.merge_batch(_messages(spark, (6, "b"), (7, "c")), 1, store, NOW)
    ST.merge_batch(_messages(spark, (5, "a"), (8, "d")), 2, store, NOW)
    assert listed() == [(1, "a", "seen"), (2, "b", None), (3, "c", None), (4, "d", None)]
    audit = sorted((r["id"], r["target"], r["action"]) for r in store.load("audit_log").collect())
    assert audit == [(i, f"alert:{i}", "model_alert_ingested") for i in (1, 2, 3, 4)]
    store.save("audit_log", A.append_audit(store.load("audit_log"), spark.createDataFrame([("u", "read", "alert:1")], "user_id string, action string, target string"), NOW))
    assert store.load("audit_log").count() == 5


def test_windows_without_id_and_bounds_stay_apart(spark, tmp_path):
    _write(tmp_path / "in", "1.jsonl", [{"window": {**FLOW, "sbytes": b}} for b in (1500, 1600, 1700)])
    ST.detect_stream(SRC.read_window_stream(spark, str(tmp_path / "in")), None, str(tmp_path / "alerts"), str(tmp_path / "c1"), scorer=_score, available_now=True).awaitTermination()
    store = AlertStore(spark, str(tmp_path / "store"))
    ST.persist_stream(SRC.read_alert_stream(spark, str(tmp_path / "alerts")), store, str(tmp_path / "c2"), available_now=True).awaitTermination()
    rows = store.load("alerts").collect()
    assert len(rows) == 3 and len({r["window_id"] for r in rows}) == 3 and min(r["timestamp"] for r in rows) > 1_600_000_000_000


def test_many_ids_are_neither_sent_to_every_task_nor_joined_in_few(spark, monkeypatch):
    from flowlens import session

    monkeypatch.setattr(session, "HELD_ROWS", 10_000)
    alerts = spark.range(0, 300_000, 1, 4)
    asked = alerts.select((F.col("id") * 2).alias("alert_id"))
    known = asked.join(A._known_alerts(alerts, asked), "alert_id", "left_semi")
    assert known.rdd.getNumPartitions() == 30
    assert sorted(r["alert_id"] for r in known.collect()) == list(range(0, 300_000, 2))
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_created_investigations_of_repeated_and_unknown_alerts(spark, monkeypatch):
    from flowlens import session

    monkeypatch.setattr(session, "HELD_ROWS", 2)
    alerts = spark.createDataFrame([(i % 40,) for i in range(60)] + [(None,)], "id long")
    new = spark.createDataFrame([(i % 50 if i % 7 else None, "u", None, str(i)) for i in range(100)], "alert_id long, user_id string, status string, notes string")
    old = spark.createDataFrame([(7, 1, "u", "open", None, None, None)], STORE_SCHEMAS["alert_investigations"])
    made = A.create_investigations(old, new, alerts, NOW).collect()
    want = sorted((i % 50, str(i)) for i in range(100) if i % 7 and i % 50 < 40)
    assert sorted((r["id"], r["alert_id"], r["notes"]) for r in made if r["id"] > 7) == [(8 + at, a, n) for at, (a, n) in enumerate(want)]


def test_windows_are_parsed_once_before_the_filter_on_scores(spark):
    lines = [json.dumps({"id": "a", "window": {"sbytes": 900}}), json.dumps({"id": "b", "sbytes": 500, "label": "1"}), json.dumps({"window": 5, "sbytes": 950})]
    records = SRC.parse_records(spark.createDataFrame([(x,) for x in lines], "value string"))

    def score(df):
        return df.withColumns({"score": F.col("window.sbytes") / 1000.0, "model": F.lit("m"), "threshold": F.lit(0.6)})

    found = ST.detect(records, None, 1, scorer=score)
    filters = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("+- ") if line.startswith("Filter")]
    assert filters and not any("from_json" in line for line in filters)
    assert sorted((r["window"]["sbytes"], r["model_score"]) for r in found.collect()) == [(900.0, 0.9), (950.0, 0.95)]
    assert sorted((r["window"]["sbytes"], r["window"]["label"]) for r in records.collect()) == [(500.0, "1"), (900.0, None), (950.0, None)]
    alerts = SRC.parse_alerts(spark.createDataFrame([('{"timestamp": "3.0"}',), ('{"timestamp": "x"}',), ("{}",)], "value string"))
    filters = [line for line in alerts._jdf.queryExecution().optimizedPlan().toString().split("+- ") if line.startswith("Filter")]
    assert filters and not any("from_json" in line for line in filters) and [r["timestamp"] for r in alerts.collect()] == [3]


def test_persisted_batches_hold_no_windows(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(ST, "merge_batch", lambda batch, *_: seen.append(batch.columns))
    _messages(spark, (5, "a")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ALERT_MESSAGE_SCHEMA).parquet(str(tmp_path / "in"))
    ST.persist_stream(stream, AlertStore(spark, str(tmp_path / "s")), str(tmp_path / "c"), NOW, True).awaitTermination()
    assert seen == [list(ST.MERGED)]
