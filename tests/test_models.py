import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import explain as E, fold_fit as FF, models as ML
from flowlens.operators.features import flow_features
from flowlens.plans import training as P
from tests.conftest import FLOW


@pytest.fixture(scope="module")
def corpus(spark):
    """Two sources of flows; attacks send more bytes and mostly use udp."""
    from flowlens.sources.records import parse_records
    r = random.Random(3)
    rows = []
    for i in range(400):
        attack = r.random() < 0.4
        rows.append({"id": f"r{i}", "label": int(attack), "label_source": "metadata", "dataset_source": "a" if i % 2 else "b",
                     "window_start_ms": i, "window_end_ms": i + 5,
                     "window": {"window_start_ms": i, "window_end_ms": i + 5, "event_count": 2, "dur": r.random() + 0.1,
                                "sbytes": r.gauss(900 if attack else 300, 150), "dbytes": 50, "spkts": r.randint(1, 9), "dpkts": 2,
                                "proto": "udp" if attack != (r.random() < 0.2) else "tcp", "service": "dns", "state": "con",
                                "metadata": {"attack_cat": "DoS" if attack else None, "campaign_signature": f"c{i % 12}"}}})
    return parse_records(spark.createDataFrame([(json.dumps(x),) for x in rows], "value string"))


@pytest.fixture(scope="module")
def detector(corpus):
    return P.train(corpus, "b", max_iter=60)


def test_train_manifest(detector):
    m = detector.manifest
    assert m["n_samples"] == 400 and m["dataset_source_counts"] == {"a": 200, "b": 200} and m["test_source_counts"] == {"b": 200}
    assert m["evaluation_split"] == "holdout:b" and m["feature_schema"] == "network_flow_v1" and m["feature_version"] == 7
    assert m["metrics"]["structured_baseline"]["positive_f1"] > 0.85 and m["metrics"]["structured_baseline"]["roc_auc"] > 0.9
    assert m["metrics"]["text_tfidf"]["positive_f1"] > 0.6
    assert m["quality_gate"]["promotion_ready"] and m["quality_gate"]["observed"]["holdout_source"] == "b"
    assert not any("attack_cat" in name or "dos" in name for name in detector.structured.coefficients())


def test_train_refusals(spark, corpus, tmp_path):
    with pytest.raises(ValueError, match="hold-out source is needed"):
        P.train(corpus)
    with pytest.raises(ValueError, match="only one class"):
        P.train(corpus.filter("label = '1'"), "b")
    mixed = corpus.withColumn("window", F.col("window").withField("feature_schema", F.when(F.col("id") == "r1", "other_v1")))
    with pytest.raises(ValueError, match="one feature schema"):
        P.train(mixed, "b")
    path = str(tmp_path / "m")
    with pytest.raises(RuntimeError, match="promotion gate"):
        P.train(corpus.withColumn("label_source", F.lit("unknown")), "b", out=path, runtime_path=path, max_iter=5)


def test_fit_minimizes_the_penalized_balanced_loss(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 2))
    y = (x[:, 0] + 0.5 * x[:, 1] + r.normal(size=300) > 0.7).astype(int)
    rows = [({"a": float(a), "b": float(b)}, int(t), 0.5) for (a, b), t in zip(x, y)]
    df = spark.createDataFrame(rows, "features map<string,double>, label int, w double")
    model = ML.fit_structured(df, weight="w", C=1.5, tol=1e-7, max_iter=60)
    w = np.array([model.coefficients()["a"], model.coefficients()["b"]])
    b = model.classifier.intercept
    u = 0.5 * np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    residual = u * (1 / (1 + np.exp(-(x @ w + b))) - y)
    assert np.allclose(w + 1.5 * x.T @ residual, 0, atol=1e-3) and abs(residual.sum()) < 1e-3


def test_scores_equal_the_linear_formula(spark, corpus, detector):
    rows = flow_features(corpus).select("id", "features", "window")
    m = detector.structured
    table = spark.createDataFrame(list(m.coefficients().items()), "feature string, coefficient double")
    linear = {r["id"]: r["score"] for r in E.score_linear(rows, table, m.classifier.intercept).collect()}
    scored = ML.score_structured(rows, detector).collect()
    assert {r["id"]: r["score"] for r in scored} == pytest.approx(linear, abs=1e-9)
    assert all(r["prediction"] == int(r["score"] >= m.threshold) for r in scored)
    # The join path of a table too long to send around.
    limit, E.BROADCAST_ROW_LIMIT = E.BROADCAST_ROW_LIMIT, 3
    try:
        joined = {r["id"]: r["score"] for r in E.score_linear(rows, table, m.classifier.intercept).collect()}
    finally:
        E.BROADCAST_ROW_LIMIT = limit
    assert joined == pytest.approx(linear, abs=1e-9)


def test_explanations_agree(spark, corpus, detector):
    rows = flow_features(corpus).select("id", "features")
    table = spark.createDataFrame(list(detector.structured.coefficients().items()), "feature string, coefficient double")
    long = E.top_k_features(E.feature_contributions(rows, table), 4)
    short = ML.explain_model(rows, detector.structured, 4).select("id", F.posexplode("top_features").alias("at", "t")).select("id", (F.col("at") + 1).alias("rank"), "t.*")
    key = lambda df: sorted((r["id"], r["rank"], r["feature"], r["contribution"]) for r in df.collect())
    assert key(long) == key(short)
    text = ML.explain_model(corpus, detector.text, 3).first()["top_features"]
    assert len(text) == 3 and text[0]["importance_score"] >= text[1]["importance_score"]


def test_save_and_load(spark, corpus, detector, tmp_path):
    detector.save(spark, str(tmp_path / "d"))
    loaded = ML.Detector.load(spark, str(tmp_path / "d"))
    key = lambda d: {r["id"]: (r["score"], r["threshold"]) for r in ML.score_structured(corpus, d).collect()}
    assert key(loaded) == key(detector) and loaded.manifest["n_samples"] == 400
    text = lambda d: sorted((r["id"], r["score"]) for r in ML.score_text(corpus, d).collect())
    assert text(loaded) == text(detector)


def test_family_models_route(corpus, detector):
    import dataclasses
    family = dataclasses.replace(detector.structured, threshold=0.0)
    routed = dataclasses.replace(detector, families={"network_dos": family})
    rows = ML.score_structured(corpus, routed).select("window.metadata.attack_cat", "threshold", "prediction").collect()
    assert {(r["attack_cat"], r["threshold"]) for r in rows} == {("DoS", 0.0), (None, detector.structured.threshold)}


def test_fallback_order(detector):
    assert ML.choose_model(["tfidf_fallback", "distilbert"]) == "tfidf_fallback"
    assert ML.choose_model(["tfidf_fallback", "structured_baseline"], "distilbert") == "structured_baseline"
    assert ML.choose_model(["distilbert"], "tfidf_fallback") == "distilbert"
    with pytest.raises(ValueError):
        ML.choose_model([])


def test_external_model_and_occlusion(spark):
    def make():
        def predict(texts):
            hits = np.array([t.count("bad") for t in texts], dtype=float)
            return np.stack([np.zeros_like(hits), hits], axis=1)
        return predict
    df = spark.createDataFrame([(1, "bad good bad x"), (2, "fine")], "id int, text string")
    scored = {r["id"]: r for r in ML.score_external(df, make).collect()}
    assert scored[1]["score"] == pytest.approx(1 / (1 + math.exp(-2))) and scored[2]["score"] == 0.5 and scored[2]["prediction"] == 1
    top = E.explain_occlusion(df, make, 2).filter("id = 1").orderBy("rank").collect()
    assert top[0]["token"] == "bad" and top[0]["impact_score"] == pytest.approx(1 / (1 + math.exp(-2)) - 0.5)
    assert top[0]["contribution"] == "increases_threat" and top[1]["impact_score"] == 0.0


def test_evaluate_compare_credibility(corpus, detector):
    report = P.evaluate(corpus, detector)
    assert report["split_mode"] == "time" and report["threshold_mode"] == "global_threshold" and report["n_samples"] == 80
    assert report["thresholds_used"] == [detector.structured.threshold]
    compared = P.compare(corpus, ML.scorers(detector), "none")
    assert compared["structured_baseline"]["n_samples"] == 400 and set(compared["summary"]) == {"accuracy_delta", "f1_delta", "latency_ratio"}
    cv = P.credibility(corpus, folds=2, repeats=1, max_iter=10)
    assert cv["evaluation"]["group_by"] == "campaign_signature" and cv["evaluation"]["scheme"] == "stratified_group_kfold"
    assert cv["summary"]["always_normal"]["positive_f1"]["mean"] == 0.0 and cv["summary"]["structured_baseline"]["positive_f1"]["mean"] > 0.8
    assert any(w.startswith("grouped") for w in cv["warnings"])


def test_only_scored_rows_get_features(corpus, detector, monkeypatch):
    seen = []
    plain = P.flow_features
    monkeypatch.setattr(P, "flow_features", lambda df, *a: (seen.append(df.count()), plain(df, *a))[1])
    report = P.evaluate(corpus, detector)
    compared = P.compare(corpus, ML.scorers(detector))
    assert seen == [80, 80] and report["n_samples"] == 80 == compared[ML.STRUCTURED]["n_samples"]
    want = P.M.evaluation(ML.score_structured(P.split_rows(P.prepared_rows(corpus, "off", 2), "time", 0.2).test, detector)).first()
    assert {k: report[k] for k in ("tn", "fp", "fn", "tp", "roc_auc")} == {k: want[k] for k in ("tn", "fp", "fn", "tp", "roc_auc")}


def test_model_info(spark):
    rows = [("structured_baseline", True, False, 0.3), ("tfidf_fallback", True, False, 0.5), ("distilbert", False, True, 0.5)]
    models = spark.createDataFrame(rows, "model string, available boolean, requested boolean, threshold double")
    info = ML.model_info(models).first()
    assert (info["active_model"], info["available_models"], info["active_threshold_mode"], info["active_threshold"]) == (
        "structured_baseline", ["structured_baseline", "tfidf_fallback"], "global", 0.3)
    families = spark.createDataFrame([("network_dos", 0.2)], "family string, threshold double")
    info = ML.model_info(models, families).first()
    assert (info["active_threshold_mode"], info["active_threshold"], info["active_family_thresholds"]) == ("per_family", None, {"network_dos": 0.2})


def test_linear_scores_the_same_both_ways(spark):
    from flowlens.operators.explain import score_linear

    rows = spark.createDataFrame(
        [(1, {"a": 1.0, "b": 2.0}), (1, {"a": 3.0}), (2, None), (3, {}), (None, {"a": 1.0, "z": 9.0}), (4, {"b": None, "a": 2.0})], "id int, features map<string,double>")
    coefficients = spark.createDataFrame([("a", 0.5), ("b", -1.0), ("a", 0.25)], "feature string, coefficient double")
    got = [sorted((str(r["id"]), round(r["score"], 12)) for r in score_linear(rows, coefficients, 0.1, most=most).collect()) for most in (10, 1)]
    sigma = lambda x: round(1 / (1 + math.exp(-x)), 12)
    want = sorted([("1", sigma(0.1 + 0.75 - 2)), ("1", sigma(0.1 + 2.25)), ("2", sigma(0.1)), ("3", sigma(0.1)), ("None", sigma(0.85)), ("4", sigma(1.6))])
    assert got[0] == want and got[1] == want


def test_all_family_thresholds_are_kept(spark):
    from flowlens.operators.models import model_info

    models = spark.createDataFrame([("structured_baseline", True, False, 0.4)], "model string, available boolean, requested boolean, threshold double")
    families = spark.range(12_000).selectExpr("concat('f', id) family", "id / 12000 threshold")
    row = model_info(models, families).first()
    assert len(row["active_family_thresholds"]) == 12_000 and row["active_threshold_mode"] == "per_family"
    assert model_info(models, families.limit(0)).first()["active_threshold"] == 0.4


def test_scores_after_an_observation(spark):
    from pyspark.sql import Observation, functions as F

    from flowlens.operators.models import fit_structured

    seen = Observation()
    rows = spark.range(60).select(
        F.col("id"), (F.col("id") % 2).cast("int").alias("label"), F.create_map(F.lit("x"), (F.col("id") % 2) * 2.0 + F.rand(1)).alias("features"))
    rows.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 60
    scores = fit_structured(rows).score(rows).select("label", "score").collect()
    assert all((r["score"] > 0.5) == (r["label"] == 1) for r in scores)


def test_occlusion_of_odd_and_long_texts(spark):
    def make():
        return lambda texts: np.array([len(t) for t in texts], dtype=float)

    def plain(value, k):
        words = [*dict.fromkeys(w for w in re.split(r"[ \t\n\x0b\f\r]+", value or "") if w)]
        found = [(len(value) - len(value.replace(w, "")), w) for w in words]
        return [(r, w, float(i)) for r, (i, w) in enumerate(sorted(found, key=lambda e: (-e[0], e[1].encode()))[:k], 1)]

    texts = [None, "", "  \n", "one", "é b é bb b", "a b c a", "a b c a", " ".join(f"w{i}" for i in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").selectExpr("*", "1 rank", "'x' token")
    for size, chars in ((64, 1 << 22), (2, 1 << 22), (64, 10)):
        rows = E.explain_occlusion(df, make, 3, batch_size=size, batch_chars=chars).collect()
        for i, value in enumerate(texts):
            assert sorted((r["rank"], r["token"], r["impact_score"]) for r in rows if r["id"] == i) == plain(value, 3)
    assert E.explain_occlusion(df.limit(0), make).count() == 0


def test_occlusion_makes_variants_as_they_are_scored():
    """A text of 20,000 different words: 2 GB of variants, some megabytes at once."""
    import tracemalloc

    words = [f"word{i:05d}" for i in range(20_000)]
    text, lists, made = " ".join(words), 0, 0
    tracemalloc.start()
    for variants in E.occluded(text, words[:1000], 1 << 22, 64):
        lists, made = lists + 1, made + len(variants)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == 1001 and lists > 10 and peak < 50 << 20


@pytest.mark.parametrize("bent", [16_000_000, 0])
def test_folds_fitted_together_equal_single_fits(spark, monkeypatch, bent):
    monkeypatch.setattr(FF, "MOST_CURVATURE", bent)
    rng = random.Random(3)
    rows = []
    for i in range(240):
        y = int(rng.random() < 0.4)
        features = {"big": rng.gauss(2000.0 * y, 4000.0), "small": rng.gauss(0.2 * y, 0.5), f"kind={i % 7}": 1.0}
        if i == 17:
            features["once"] = 3.0
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"] + ["hot", "very hot"] * y) for _ in range(rng.randint(1, 12)))
        rows.append((i, y, features, text, [i % 3, (i // 5) % 3]))
    df = spark.createDataFrame(rows, "id long, label int, features map<string,double>, window_text string, folds array<int>")
    models = P.fit_folds(df, 3, 2, tol=1e-12)
    for number in range(6):
        train = df.filter(F.col("folds")[number // 3] != number % 3)
        for single, many, names in ((ML.fit_structured(train, tol=1e-14), models.structured, models.features), (ML.fit_text(train, tol=1e-14), models.text, models.terms)):
            want, got = single.coefficients(), dict(zip(names, many.coefficients[number]))
            scale = {"big": 4000.0}
            assert max(abs(got[n] - want.get(n, 0.0)) * scale.get(n, 1.0) for n in names) < 1e-6, number
            assert many.intercepts[number] == pytest.approx(single.classifier.intercept, abs=1e-6)
    # The test rows of a fold do not shape its model: row 17 alone has this feature.
    once = [abs(models.structured.coefficients[n][models.features.index("once")]) for n in range(6)]
    assert [n for n in range(6) if once[n] < 1e-6] == [17 % 3, 3 + (17 // 5) % 3]


def test_partial_sums_of_many_tasks_and_wide_models(spark, monkeypatch):
    rng = np.random.default_rng(0)
    width, n = 50, 120
    cells = [sorted(rng.choice(width, rng.integers(0, 6), replace=False).tolist()) for _ in range(n)]
    rows = [(c, rng.normal(size=len(c)).tolist(), int(rng.integers(2)), [float(x) for x in rng.random(3)]) for c in cells]
    df = spark.createDataFrame(rows, "indices array<int>, values array<double>, y int, w array<double>").repartition(7)
    model = FF.Linear(rng.normal(size=(2, width)), rng.normal(size=2))
    which = np.array([0, 2])
    dense = np.zeros((n, width))
    for i, (c, v, _, _) in enumerate(rows):
        dense[i, c] = v
    y, w = np.array([r[2] for r in rows], float)[:, None], np.array([r[3] for r in rows])[:, which]
    for block, direct, part, most in ((1 << 16, 1 << 20, 100_000, 2_000_000), (16, 2, 7, 0)):
        monkeypatch.setattr(FF, "DENSE", most)
        monkeypatch.setattr(FF, "BLOCK", block)
        monkeypatch.setattr(FF, "DIRECT", direct)
        monkeypatch.setattr(FF, "CELLS", part)
        for scale in (None, rng.random((2, width)) * (rng.random((2, width)) < 0.7)):
            at = FF.Linear(model.coefficients, model.intercepts, scale)
            loss, slope, shift, bend = FF.loss_and_gradient(df, F.col("w"), at, which, 7, True)
            for j in range(2):
                x = dense * (1 if scale is None else scale[j])
                if scale is not None:
                    x = x / np.where((norm := np.sqrt((x ** 2).sum(1, keepdims=True))) > 0, norm, 1)
                m = x @ at.coefficients[j] + at.intercepts[j]
                rest = w[:, j] * (1 / (1 + np.exp(-m)) - y[:, 0])
                assert loss[j] == pytest.approx(float((w[:, j] * (np.logaddexp(0, m) - y[:, 0] * m)).sum()))
                assert np.allclose(slope[j], x.T @ rest) and shift[j] == pytest.approx(rest.sum())
                z, p = np.column_stack([x, np.ones(n)]), 1 / (1 + np.exp(-m))
                assert np.allclose(bend[j], z.T @ (z * (w[:, j] * p * (1 - p))[:, None]))


def test_slopes_are_zero_at_the_fit_and_not_beside_it(spark, corpus):
    rows = P.resolve_records(corpus)
    model = ML.fit_structured(rows, weight="weight")
    assert max(map(abs, ML.penalized_gradient(rows, model, weight="weight").values())) < 1e-3
    assert max(map(abs, ML.penalized_gradient(rows.filter("label = 0 or id like '%1'"), model, weight="weight").values())) > 1e-3


def test_vectors_are_the_same_by_list_and_by_table(spark, tmp_path):
    from flowlens.operators.vectorize import SparseFeatureVectorizer, SparseFeatureVectorizerModel

    rows = [(1, {"b": 2.0, "a": 1.0}), (1, {"b": 2.0, "a": 1.0}), (2, {}), (3, None), (None, {"é": 4.0, "z z": None}), (4, {f"n{i}": float(i) for i in range(50)})]
    df = spark.createDataFrame(rows, "id int, features map<string,double>")
    new = spark.createDataFrame([*rows, (5, {"unseen": 1.0, "a": 7.0})], df.schema)
    listed, tabled = SparseFeatureVectorizer().fit(df), SparseFeatureVectorizer(most=5).fit(df)
    assert not tabled.isSet(tabled.vocabulary) and tabled.getOrDefault(tabled.size) == len(listed.getVocabulary()) == 54
    tabled.write().overwrite().save(str(tmp_path / "m"))
    for model in (tabled, SparseFeatureVectorizerModel.load(str(tmp_path / "m"))):
        vectors = [sorted((str(r["id"]), str(r["feature_vector"])) for r in m.transform(new).collect()) for m in (listed, model)]
        assert vectors[0] == vectors[1]
    names = lambda m: sorted(map(tuple, m.names(spark).collect()))
    assert names(listed) == names(tabled)


def test_a_model_over_a_table_of_names(spark):
    from flowlens.operators.explain import score_linear
    from flowlens.operators.vectorize import SparseFeatureVectorizer

    rng = random.Random(2)
    rows = [(i, i % 2, {f"f{rng.randint(0, 30)}": 1.0, "x": rng.gauss(i % 2, 1)}) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, label int, features map<string,double>")
    vectorizer = SparseFeatureVectorizer(most=3).fit(df)
    model = ML.LinearModel(vectorizer, ML.fit_linear(vectorizer.transform(df), "feature_vector"))
    plain = ML.fit_structured(df)
    table = {r["feature"]: r["coefficient"] for r in model.coefficient_table(spark).collect()}
    assert table == pytest.approx(plain.coefficients(), abs=1e-6)
    scored = score_linear(df, model.coefficient_table(spark), float(model.classifier.intercept), most=3)
    want = {r["id"]: r["score"] for r in plain.score(df).collect()}
    assert {r["id"]: r["score"] for r in scored.collect()} == pytest.approx(want, abs=1e-6)


def test_packed_blocks_and_guided_search(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [([0, 1 + i % 3], [1.0 + rng.random(), rng.normal()], int(rng.random() < 0.4), [0.01, 0.02 * rng.random()]) for i in range(80)]
    df = spark.createDataFrame(rows, "indices array<int>, values array<double>, y int, w array<double>")
    which = np.array([0, 1])
    for scale in (None, 0.5 + rng.random((2, 4))):
        point = FF.Linear(rng.normal(size=(2, 4)), rng.normal(size=2), scale)
        plain = FF.loss_and_gradient(df, F.col("w"), point, which, 1, True)
        for a, b in zip(plain, FF.loss_and_gradient(FF.packed(df, F.col("w"), 4, scale), None, point, which, 1, True)):
            assert np.allclose(a, b, atol=1e-12)
    newton = FF.fit_folds(df, F.col("w"), [0.01, 0.02], 4, None, 1e-9, 50)
    monkeypatch.setattr(FF, "CURVED_COLUMNS", 0)
    monkeypatch.setattr(FF, "GUIDE_ROWS", 40)
    guided = FF.fit_folds(df, F.col("w"), [0.01, 0.02], 4, None, 1e-9, 50)
    assert np.allclose(newton.coefficients, guided.coefficients, atol=1e-6) and np.allclose(newton.intercepts, guided.intercepts, atol=1e-6)


def test_packed_blocks_lie_in_small_row_groups(spark):
    import pyarrow.parquet as pq

    # A row of 2000 cells: 50 of them make a block of 1.2 MB.
    wide = spark.range(3000).coalesce(1).select(
        F.sequence(F.lit(0), F.lit(1999)).alias("indices"), F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: F.rand(1) + i).alias("values"),
        (F.col("id") % 2).cast("int").alias("y"), F.array(F.lit(1.0)).alias("w"))
    packs = FF.packed(wide, F.col("w"), 2000)
    sizes = [m.row_group(i).total_byte_size for f in packs.inputFiles() for m in [pq.read_metadata(f.removeprefix("file://"))] for i in range(m.num_row_groups)]
    assert sum(sizes) > 40 << 20 and max(sizes) < 24 << 20
    assert packs.agg(F.sum("rows")).first()[0] == 3000


def test_fits_of_folds_run_with_small_batches(spark, monkeypatch):
    seen, key = [], "spark.sql.execution.arrow.maxBytesPerBatch"

    # A session of its own: one that has set a size keeps it.
    own = spark.newSession()

    def fit(*args, **options):
        seen.append(own.conf.get(key))
        raise RuntimeError("enough")

    monkeypatch.setattr(P, "fit_folds", fit)
    before = own.conf.get(key)
    for _ in range(2):
        with pytest.raises(RuntimeError, match="enough"):
            P.fold_metrics(own.range(1), 2, 1)
        assert seen[0] == str(4 << 20) and own.conf.get(key) == (before if len(seen) == 1 else "2097152")
        own.conf.set(key, str(2 << 20))
    assert seen[1] == str(2 << 20)


def test_texts_are_made_before_the_wide_feature_maps(spark, records):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        rows = P.resolve_records(records({"id": "a", "label": 1, "window": FLOW}))
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    # The plan is written from its last step down: no step that makes the text copies a map.
    assert 0 <= plan.index("map_from_arrays") < plan.index("ArrowEvalPython")
    assert rows.columns[-3:] == ["window", "features", "window_text"]
    row = rows.first()
    assert row["window_text"].startswith("feature_schema=") and row["features"]["bytes_total"] == 1800.0


def test_scores_and_explanations_are_single_functions_over_names(spark):
    inf, nan = math.inf, math.nan
    maps = [{"a": 2.0, "b": -1.0, "zz": 9.0}, {"b": 0.0, "é": 1.0, "a": -0.0}, {}, None, {"c": nan, "a": 1.0}, {"d": -inf}, {"a": None, "b": 3.0}, {"e": 2.0, "c": 2.0, "a": 1.0}]
    df = spark.createDataFrame([*enumerate(maps)], "id int, features map<string,double>").coalesce(1)
    weights = {"b": 0.5, "a": -1.5, "é": 2.0, "c": 1.0, "d": 1.0, "e": 1.0, "gone": None}
    plans = []

    def rows(found, column):
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
        return {r["id"]: r[column] for r in found.collect()}

    top = rows(E.explain_linear(df, weights, 2), "top_features")
    assert top[3] is None and top[2] == []
    for i in (0, 1, 5, 6, 7):
        cells = [(n, v) for n, v in maps[i].items() if v not in (None, 0.0) and weights.get(n) is not None]
        want = sorted(((-abs(v * weights[n]), n.encode(), n, v) for n, v in cells))[:2]
        assert [(t["feature"], t["importance_score"], t["contribution"], t["feature_value"]) for t in top[i]] == [
            (n, -o, "increases_threat" if weights[n] > 0 else "decreases_threat", v) for o, _, n, v in want]
    assert [t["feature"] for t in top[4]] == ["a", "c"]

    table = spark.createDataFrame([(n, c) for n, c in weights.items()], "feature string, coefficient double")
    short, long = (rows(E.score_linear(df, table, 0.25, most=most), "score") for most in (100, 1))
    assert all(short[i] == pytest.approx(long[i], nan_ok=True) for i in short)

    training = spark.createDataFrame([({"a": float(i % 5), "b": float(i % 3)} if i % 7 else {"a": 1.0}, i % 2) for i in range(60)], "features map<string,double>, label int")
    model = ML.fit_structured(training)
    vectors = model.classifier.transform(model.vectorizer.transform(df.filter("id <> 6")))
    want = {r["id"]: float(r["probability"][1]) for r in vectors.collect()}
    assert rows(model.score(df.filter("id <> 6")), "score") == pytest.approx(want, abs=1e-15, nan_ok=True)
    texts = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(["ab cd ab", "cd ef", "", "ab", "ef ef gh", "gh ab"] * 3)], "id int, window_text string, label int")
    text = ML.fit_text(texts)
    want = {r["id"]: float(r["probability"][1]) for r in text.classifier.transform(text.vectorizer.transform(texts)).collect()}
    assert rows(text.score(texts), "score") == pytest.approx(want, abs=1e-15)
    # Neither interpreted functions of single cells nor a column of vectors.
    assert not any("lambda" in p or "vector" in p for i, p in enumerate(plans) if i != 2)
