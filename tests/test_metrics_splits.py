import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowlens.operators import metrics as M, reports as R, splits as S
from flowlens.operators.ordering import rows_at_ranks, with_row_index
from flowlens.operators.rate_limit import rate_limit_audit


# Published confusion matrices and the values they must give.
@pytest.mark.parametrize("cells, expected", [
    ((28544, 27456, 2201, 117140), dict(accuracy=0.8309, balanced_accuracy=0.7456, negative_precision=0.9284, negative_recall=0.5097, negative_f1=0.6581,
                                       positive_precision=0.8101, positive_recall=0.9816, positive_f1=0.8876, macro_f1=0.7729, weighted_f1=0.8143)),
    ((51996, 4004, 17895, 101446), dict(accuracy=0.8751, balanced_accuracy=0.8893, negative_precision=0.7440, negative_recall=0.9285, negative_f1=0.8260,
                                        positive_precision=0.9620, positive_recall=0.8501, positive_f1=0.9026, macro_f1=0.8643, weighted_f1=0.8781)),
])
def test_published_metrics(spark, cells, expected):
    pairs = [(y, p, n) for (y, p), n in zip(((0, 0), (0, 1), (1, 0), (1, 1)), cells)]
    rows = spark.createDataFrame(pairs, "label int, prediction int, n int").select("label", "prediction", F.explode(F.sequence(F.lit(1), "n")))
    got = M.classification_metrics(rows).first()
    assert {k: round(got[k], 4) for k in expected} == expected
    assert got["confusion_matrix"] == [[cells[0], cells[1]], [cells[2], cells[3]]]


def test_metrics_of_one_class(spark):
    got = M.classification_metrics(spark.createDataFrame([(1, 1), (1, 1)], "label int, prediction int")).first()
    assert got["macro_f1"] == 1.0 and got["balanced_accuracy"] == 1.0 and got["negative_f1"] == 0.0


def _scored(seed, n=300):
    r = random.Random(seed)
    # A third of all rows share one score.
    return [(r.randint(0, 1), 0.5 if r.random() < 0.33 else round(r.random(), 2)) for _ in range(n)]


def test_curve_against_brute_force(spark):
    rows = _scored(1)
    df = spark.createDataFrame(rows, "label int, score double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = M.ranking_metrics(df).first()
    assert got["roc_auc"] == pytest.approx(auc)
    ap, last = 0.0, 0.0
    best = (-1.0, None)
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
        ap, last = ap + (tp / len(pos) - last) * tp / (tp + fp), tp / len(pos)
        f1 = lambda hit, wrong: 2 * hit / (2 * hit + wrong) if hit + wrong else 0.0
        wrong = fp + len(pos) - tp
        value = (f1(tp, wrong) + f1(len(neg) - fp, wrong)) / 2
        best = max(best, (value, -t))
    assert got["average_precision"] == pytest.approx(ap)
    row = M.best_threshold(df).first()
    assert (row["objective"], row["threshold"]) == (pytest.approx(best[0]), -best[1])


def test_threshold_special_cases(spark):
    empty = spark.createDataFrame([], "label int, score double")
    assert M.best_threshold(empty).first()["threshold"] == 0.5
    single = spark.createDataFrame([(1, 0.2), (1, 0.6)], "label int, score double")
    assert M.best_threshold(single).first()["threshold"] == pytest.approx(0.4)
    assert M.roc_auc(single).first()[0] is None and M.average_precision(single).first()[0] is None


def test_fold_summary(spark):
    rows = spark.createDataFrame([("m", "f1", 0.5), ("m", "f1", 0.7), ("m", "auc", 0.9), ("m", "auc", None)], "model string, metric string, value double")
    got = {r["metric"]: r for r in M.summarize_folds(rows).collect()}
    assert (got["f1"]["mean"], got["f1"]["std"], got["f1"]["ci95_low"]) == (0.6, 0.1, 0.4614)
    assert (got["auc"]["mean"], got["auc"]["std"], got["auc"]["ci95_high"]) == (0.9, 0.0, 0.9)


def test_row_index_and_ranks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("payload")).repartition(5)
    rows = with_row_index(df, ["k"]).collect()
    assert sorted((r["row_index"], r["k"]) for r in rows) == [(i, i) for i in range(1000)]
    assert rows_at_ranks(df, ["k"], [0, 500, 999, 1000]) == {0: (0,), 500: (500,), 999: (999,)}


def _rows(spark, n=240):
    return spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.col("id").alias("window_start_ms"), (F.col("id") + 1).alias("window_end_ms"),
        (F.col("id") % 3 == 0).cast("int").alias("label"), F.when(F.col("id") < n // 3, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 30).cast("string"))).alias("group"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("dataset_source"))


def test_time_split(spark):
    s = S.time_split(_rows(spark))
    assert (s.train.count(), s.test.count(), s.actual_mode) == (192, 48, "time")
    assert s.train.agg(F.max("window_start_ms")).first()[0] < s.test.agg(F.min("window_start_ms")).first()[0]
    four = spark.createDataFrame([(0, 1, 2), (0, 3, 4), (1, 5, 6), (1, 7, 8)], "label int, window_start_ms long, window_end_ms long").withColumn("id", F.col("window_start_ms").cast("string"))
    s = S.time_split(four, 0.5)
    assert (s.requested_mode, s.actual_mode, s.train.count(), s.test.count()) == ("time", "stratified", 2, 2)


def test_stratified_split(spark):
    df = _rows(spark)
    train, test = S.stratified_split(df, 0.25)
    assert Counter(r["label"] for r in test.collect()) == {0: 40, 1: 20}
    assert {r["id"] for r in train.collect()}.isdisjoint(r["id"] for r in test.collect()) and train.count() + test.count() == 240
    again = S.stratified_split(df.repartition(3), 0.25)[1]
    assert {r["id"] for r in again.collect()} == {r["id"] for r in test.collect()}
    assert {r["id"] for r in S.stratified_split(df, 0.25, seed=7)[1].collect()} != {r["id"] for r in test.collect()}


def test_holdout_refusals(spark):
    df = _rows(spark)
    assert S.holdout_split(df, " b ").test.count() == 120
    with pytest.raises(ValueError, match="matches no rows"):
        S.holdout_split(df, "zzz")
    with pytest.raises(ValueError, match="no training rows"):
        S.holdout_split(df.filter("dataset_source = 'a'"), "a")
    with pytest.raises(ValueError, match="lacks one class"):
        S.holdout_split(df.filter("dataset_source = 'a' or label = 1"), "b")
    with pytest.raises(ValueError, match="lack one class"):
        S.holdout_split(df.filter("dataset_source = 'b' or label = 1"), "b")


def test_folds(spark):
    rows = S.repeated_stratified_folds(_rows(spark, 103), 5, 3).collect()
    assert len(rows) == 103
    for repeat in range(3):
        for label in (0, 1):
            sizes = Counter(r["folds"][repeat] for r in rows if r["label"] == label)
            assert len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) <= 1
    assert [r["folds"][0] for r in rows] != [r["folds"][1] for r in rows]


def test_group_folds(spark):
    # One group holds a third of all rows, and 2000 tiny groups take the distributed path.
    many = _rows(spark, 3000).withColumn("group", F.when(F.col("group") == "hot", "hot").otherwise(F.col("id")))
    for df, k in ((_rows(spark), 4), (many, 2)):
        rows = S.stratified_group_folds(df, "group", k, 2).collect()
        assert len(rows) == df.count()
        for repeat in range(2):
            folds = {}
            for r in rows:
                folds.setdefault(r["group"], set()).add(r["folds"][repeat])
            assert all(len(f) == 1 for f in folds.values())
            sizes = Counter(r["folds"][repeat] for r in rows)
            assert len(sizes) == k
            assert {r["label"] for r in rows if r["folds"][repeat] == 0} == {0, 1}
    with pytest.raises(ValueError):
        S.stratified_group_folds(_rows(spark).filter("group = 'hot'"), "group", 2)


def test_group_key(records):
    rows = records({"window": {"metadata": {"component_scenarios": ["b", "a"]}}}, {"window": {"metadata": {"scenario_signature": "s"}}}, {"window": {"dur": 1}})
    assert S.default_group_by(rows) == "scenario_signature"
    assert [r[0] for r in rows.select(S.group_key("window", "scenario_signature")).collect()] == ["a|b", "s", "unknown"]
    assert S.default_group_by(records({"window": {"dur": 1}})) == "none"


def test_quality_gate(spark):
    def codes(sources, holdout, f1, recall):
        provenance = spark.createDataFrame(sources, "dataset_source string, label_source string, n long")
        metrics = spark.createDataFrame([(f1, recall)], "positive_f1 double, negative_recall double")
        row = R.quality_gate(metrics, provenance, holdout).first()
        assert row["promotion_ready"] == (not row["blocker_codes"])
        return row["blocker_codes"]
    strong = [("a", "metadata", 5), ("b", "metadata", 5)]
    assert codes(strong, "b", 0.9, 0.9) == []
    assert codes(strong[:1], None, 0.9, 0.9) == ["single_source_dataset", "no_holdout_source"]
    assert codes(strong, "b", 0.1, 0.1) == ["holdout_structured_positive_f1_below_threshold", "holdout_negative_recall_below_threshold"]
    assert codes(strong, "zzz", 0.9, 0.9) == ["missing_holdout_label_provenance"]
    assert codes([("a", "metadata", 5), ("b", "unknown", 5)], "b", 0.9, 0.9) == ["weak_holdout_labels"]


def test_credibility_warnings():
    assert R.credibility_warnings(["metadata"], 0.5, "none", "none") == []
    assert [w.split(":")[0] for w in R.credibility_warnings(["unknown"], 0.995, "auto", "campaign_signature")] == ["weak_labels", "near_perfect", "grouped"]


def test_request_rollup_window(spark):
    rows = spark.createDataFrame([(0, "/a", 200, 0.1), (30_000, "/a", 500, 0.3), (60_000, "/a", 404, 0.2)], "ts_ms long, endpoint string, status int, duration_s double")
    got = {r["window_start_ms"]: r for r in R.request_rollup(rows).collect()}
    assert len(got) == 6
    assert got[0]["request_rate"] == 0.01 and got[0]["error_rate"] == pytest.approx(1 / 300) and got[0]["mean_latency_ms"] == pytest.approx(200)
    assert got[60_000]["request_rate"] == pytest.approx(1 / 300)


@pytest.mark.parametrize("limit, window_s", [(3, 10), (1, 5), (8, 2)])
def test_rate_limit_against_brute_force(spark, limit, window_s):
    r = random.Random(limit)
    # Key "hot" holds a third of the rows; bursts and pauses alternate.
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 5}", int(r.choice((0, 20_000, 40_000, 45_000)) + r.random() * 12_000)) for i in range(400)]
    expected, times = {}, {}
    for rid, key, t in sorted(rows, key=lambda x: (x[2], x[0])):
        kept = [x for x in times.get(key, []) if x > t - window_s * 1000]
        expected[rid] = len(kept) < limit
        times[key] = kept + [t] if expected[rid] else kept
    df = spark.createDataFrame(rows, "request_id long, key string, ts_ms long")
    got = {x["request_id"]: x["accepted"] for x in rate_limit_audit(df, limit, window_s).collect()}
    assert got == expected and not all(expected.values())


def test_release_deletes_written_tables(spark):
    from pathlib import Path

    from flowlens.session import materialize, release

    release(spark)
    written = materialize(spark.range(5))
    assert written.count() == 5
    folder = Path(written.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists() and release(spark) == 1 and not folder.exists() and release(spark) == 0


def test_broadcast_is_bounded_in_bytes(spark):
    from pyspark.sql import functions as F

    from flowlens.session import broadcast_if_small

    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    small = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("note"))
    assert hinted(broadcast_if_small(small)) and not hinted(broadcast_if_small(small, most_bytes=5000)) and not hinted(broadcast_if_small(small, 5))


def test_admit_equals_a_row_by_row_limit():
    import numpy as np

    from flowlens.operators.rate_limit import admit

    r = random.Random(9)
    for _ in range(300):
        limit, width = r.randint(0, 4), r.randint(1, 30)
        times = np.array(sorted(r.randint(0, 120) for _ in range(r.randint(0, 60))), np.int64)
        held, want = [], []
        for t in times.tolist():
            held = [x for x in held if x > t - width]
            want.append(len(held) < limit)
            if want[-1]:
                held.append(t)
        cut = r.randint(0, len(times))
        first, rest = admit(times[:cut], np.empty(0, np.int64), limit, width)
        second, _ = admit(times[cut:], rest, limit, width)
        assert [*first.tolist(), *second.tolist()] == want


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_prefix_sums_against_plain_sums(spark, batch):
    """Groups with disjoint, equal and crowded values, a null group and null counts; each hot group is cut into several ranges."""
    from flowlens.operators.ordering import prefix_sums

    r = random.Random(8)
    rows = [("low", r.random(), r.randint(0, 5)) for _ in range(3000)] + [("high", 1000 + r.random() / 1e6, 1) for _ in range(3000)]
    rows += [(None, float(i), 2) for i in range(5)] + [("one", 1.0, None), ("gap", 1.0, 3), ("gap", 2.0, None), ("gap", 3.0, 4)]
    df = spark.createDataFrame(rows, "g string, x double, n int")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_sums(df, ("g",), [F.col("x").desc()], ("n",)).collect()
        alone = prefix_sums(df.filter("g = 'low'").drop("g"), (), [F.col("x").asc()], ("n",)).collect()
        assert prefix_sums(df.limit(0), ("g",), [F.col("x").desc()], ("n",)).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, total = {}, {}
    for g, x, n in sorted(rows, key=lambda row: -row[1]):
        total[g] = total.get(g, 0) + (n or 0)
        want[g, x] = total[g]
    assert {(a.g, a.x): (a.n_through, a.n_total) for a in got} == {k: (v, total[k[0]]) for k, v in want.items()}
    running, want = 0, {}
    for _, x, n in sorted((row for row in rows if row[0] == "low"), key=lambda row: row[1]):
        running += n
        want[x] = running
    assert {a.x: a.n_through for a in alone} == want


def test_crowded_groups_are_cut_into_ranges(spark):
    from flowlens.operators.metrics import score_curve

    rows = [(m, i % 2, base + i * step) for m, base, step in (("a", 0.0, 1e-4), ("b", 100.0, 1e-9)) for i in range(4000)]
    df = spark.createDataFrame(rows, "model string, label int, score double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        curve = score_curve(df, by=("model",))
        ranges = spark.read.parquet(curve.inputFiles()[0].rsplit("/", 1)[0]).groupBy("model").agg(F.count_distinct("_part").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.model for r in ranges} == {"a", "b"} and all(r.n >= 3 for r in ranges)
    last = curve.filter("threshold IN (0.0, 100.0)").select("model", "tp", "fp", "positives", "negatives").collect()
    assert sorted(map(tuple, last)) == [("a", 2000, 2000, 2000, 2000), ("b", 2000, 2000, 2000, 2000)]
