import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Observation, functions as F

from flowlens.functions import labels as L
from flowlens.functions.columns import with_alert_explanation
from flowlens.operators.cleaning import clean_fractured, clean_fractured_columns
from flowlens.operators.features import flow_features, map_stats, window_text
from flowlens.operators.vectorize import NgramTfidf, SparseFeatureVectorizer, ngrams
from flowlens.sources.flow_csv import read_flow_csv
from flowlens.sources.records import labeled_rows, parse_records, read_records, undecodable
from tests.conftest import ATTACK, BENIGN, FLOW, FRACTURED


def test_flow_features_worked_values(records):
    f = flow_features(records({"window": FLOW})).first()["features"]
    assert f["bytes_total"] == 1800.0 and f["packets_total"] == 20.0 and f["proto=udp"] == 1.0
    assert f["bytes_per_second"] == 450.0 and f["service_rate=dns"] == 1.0 and "rate" not in f
    empty = flow_features(records({"window": {"metadata": {}}})).first()["features"]
    assert empty["event_count"] == 1.0 and empty["source_ip_total"] == 0.0 and empty["proto=unknown"] == 1.0


def test_map_count_replaces_one_hot(records):
    f = flow_features(records({"window": {**FLOW, "counts_by_proto": {"tcp": 4, " udp": 1, "udp": 2, "bad": -3}}})).first()["features"]
    assert f["proto=tcp"] == 4.0 and f["proto=udp"] == 2.0 and f["proto=bad"] == 0.0
    values = [4, 1, 2, 0]
    mean = sum(values) / 4
    assert f["proto_std"] == math.sqrt(sum((v - mean) ** 2 for v in values) / 4) and f["proto_unique"] == 4.0


def test_window_text_and_explanation(records):
    row = window_text(records({"window": {**FLOW, "ct_srv_src": 2}})).first()["window_text"]
    assert row.startswith("feature_schema=network_flow_v1 event_count=1 dur=4.000000 sbytes=1300.000 ")
    assert row.endswith("proto=udp service=dns state=int ct_srv_src=2.000") and "Exploit" not in row
    scored = records({"window": FLOW}).withColumns({"model_type": F.lit("m"), "model_score": F.lit(0.875)})
    text = with_alert_explanation(scored).first()["explanation_summary"]
    assert text == "m flagged anomalous network flow [Exploits] (proto=udp, service=dns, state=int, sbytes=1300.0, dbytes=500.0, score=0.88)"


def test_drop_and_relabel(records):
    rows = records(FRACTURED, BENIGN, ATTACK)
    seen = Observation()
    assert [r["id"] for r in clean_fractured(rows, "drop", observation=seen).collect()] == ["quiet", "burst"]
    assert seen.get["affected"] == 1
    fixed = clean_fractured(rows, "relabel").filter("id = 'lone'")
    w = fixed.first()["window"]
    assert fixed.select(L.record_label("label", "window")).first()[0] == 0
    assert (w["simulation_malicious_event_count"], w["simulation_benign_event_count"]) == (0, 1)
    assert w["simulation_counts_by_type"] == {"benign": 1} and w["simulation_counts_by_attack_family"] == {}
    assert w["metadata"]["attack_family"] is None and w["metadata"]["primary_scenario"] is None
    assert json.loads(w["labels"]) == {"malicious": "0"}
    assert clean_fractured(rows, "off") is rows
    with pytest.raises(ValueError):
        clean_fractured(rows, "keep")
    with pytest.raises(ValueError):
        clean_fractured(rows, "drop", 0)


def test_clean_columns_refusals(spark):
    df = spark.createDataFrame([(1, "a")], "event_count int, family string")
    with pytest.raises(ValueError):
        clean_fractured_columns(df)
    with pytest.raises(ValueError):
        clean_fractured_columns(df.drop("family"))
    assert clean_fractured_columns(df, attack_families=("A",)).count() == 0


def test_jsonl_sources_and_cap(spark, tmp_path):
    (tmp_path / "alpha.jsonl").write_text('\n{"label": 0, "dataset_source": "x", "window": {"window_start_ms": 0}}\nnope\n[1]\n{"label": 1}\n')
    (tmp_path / "beta.v2.jsonl").write_text('{"label": "attack", "event_count": 4}\n')
    paths = [str(tmp_path / "alpha.jsonl"), str(tmp_path / "beta.v2.jsonl")]
    rows = read_records(spark, paths).collect()
    assert sorted((r["dataset_source"], r["label"]) for r in rows) == [("alpha", "0"), ("alpha", "1"), ("beta.v2", "attack")]
    assert [r["window"]["event_count"] for r in rows if r["dataset_source"] == "beta.v2"] == [4]
    assert [r["label"] for r in read_records(spark, paths, 2).collect()] == ["0", "1"]
    assert undecodable(spark.read.text(paths[0])).count() == 3


def test_json_scalars_of_any_type(records):
    w = records({"window": {"dur": "2.5", "sbytes": "x", "event_count": "3", "counts_by_proto": {"tcp": "2", "x": "y"}}}).first()["window"]
    assert (w["dur"], w["sbytes"], w["event_count"], w["counts_by_proto"]) == (2.5, 0.0, 3, {"tcp": 2})


def test_flow_csv(spark, tmp_path):
    path = tmp_path / "train_flows.csv"
    path.write_text("﻿id,Stime,Ltime,dur,srcip,proto,state,sbytes,attack_cat,label\n"
                    "1,1700000000,1700000002,2.0,10.0.0.1,tcp,CON,1200,Normal,0\n"
                    ",,,,10.0.0.5,UDP,INT,oops,DoS,1\n3,,,1.0,,,,,,\n,,,1.5,,,,7,,1\n", encoding="utf-8")
    rows = {r["id"]: r for r in read_flow_csv(spark, str(path)).collect()}
    assert set(rows) == {"1", "train_flows-2", "train_flows-4"} and rows["1"]["label"] == 0
    second, fourth = rows["train_flows-2"]["window"], rows["train_flows-4"]
    assert second["counts_by_proto"] == {"udp": 1} and second["sbytes"] is None and rows["train_flows-2"]["label_quality_tier"] == "high"
    assert (fourth["window_start_ms"], fourth["window_end_ms"]) == (1_700_000_000_004, 1_700_000_001_504)
    assert fourth["window"]["proto"] == "unknown" and fourth["window"]["counts_by_source_ip"] == {} and "DoS" not in rows["train_flows-2"]["text"]
    assert [r["id"] for r in read_flow_csv(spark, str(path), "named", 2).collect()] == ["1", "named-2"]


def test_labeled_rows(records):
    row = labeled_rows(records({"window": {**FLOW, "window_start_ms": 5, "window_end_ms": 9, "metadata": {"label": 1}}})).first()
    assert (row["id"], row["label"], row["label_source"], row["label_quality_tier"]) == ("5-9", 1, "dataset_ground_truth", "high")


def test_vectorizer_ignores_unseen_names(spark, tmp_path):
    rows = spark.createDataFrame([({"b": 1.0, "a": 2.0},), ({"a": 3.0},)], "features map<string,double>")
    model = SparseFeatureVectorizer().fit(rows)
    assert model.getVocabulary() == ["a", "b"]
    model.write().overwrite().save(str(tmp_path / "v"))
    loaded = type(model).load(str(tmp_path / "v"))
    v = loaded.transform(spark.createDataFrame([({"b": 5.0, "zzz": 1.0, "a": 4.0},), ({},)], "features map<string,double>")).collect()
    assert list(v[0]["feature_vector"].toArray()) == [4.0, 5.0] and list(v[1]["feature_vector"].toArray()) == [0.0, 0.0]


def test_tfidf_by_hand(spark):
    docs = ["The cat sat", "the the dog", "x"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, window_text string")
    grams = [["the", "cat", "sat", "the cat", "cat sat"], ["the", "the", "dog", "the the", "the dog"], []]
    assert [sorted(r[0]) for r in df.orderBy("id").select(ngrams("window_text")).collect()] == [sorted(g) for g in grams]
    weights = {r["id"]: r["term_weights"] for r in NgramTfidf().fit(df).weights(df).collect()}
    idf = lambda t: math.log(4 / (1 + sum(t in g for g in grams))) + 1
    for i, g in enumerate(grams):
        raw = {t: (1 + math.log(g.count(t))) * idf(t) for t in set(g)}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        assert weights[i] == pytest.approx({t: v / norm for t, v in raw.items()})
    vectors = NgramTfidf(maxTerms=2).fit(df)
    assert vectors.getVocabulary() == ["cat", "the"]


def test_names_not_cells_are_sent_to_the_tasks(spark, tmp_path):
    from checks import catalog

    rows = [(i, f"2024-01-01 00:00:{i:02d}", i, ("view", "error")[i % 2], float(i)) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double")
    events.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "events.parquet"))
    plan = catalog.QUERIES["f5_vector_entries"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_spread_bounds_the_rows_of_a_task(spark):
    from flowlens.session import spread

    many = spread(spark.range(0, 2_000_000, 1, spark.sparkContext.defaultParallelism))
    sizes = [r[0] for r in many.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 60_000 and sum(sizes) == 2_000_000
    cut = spark.range(0, 1000, 1, 40)
    assert spread(cut).rdd.getNumPartitions() == 40


def test_terms_are_summed_in_runs_of_bounded_words(spark):
    from collections import Counter

    from flowlens.operators.vectorize import _counted_terms, _term_finder, _term_sums, _word_runs

    texts = ["ab cd ab cd", None, "", "x y", "ab", "cd ab ÉTÉ été ab cd ab", "cd cd cd", "ab_1 99 99 ab_1"] * 3
    parts = [F.col("n") % 2 == 0, F.when(F.col("n") > 4, F.col("n") < 12)]
    df = spark.createDataFrame([*enumerate(texts)], "n int, t string").coalesce(2)
    grams = [r["g"] or [] for r in df.orderBy("n").select(ngrams("t").alias("g")).collect()]
    inside = [[True] * len(texts), [n % 2 == 0 for n in range(len(texts))], [4 < n < 12 for n in range(len(texts))]]
    every, docs = [Counter() for _ in inside], [Counter() for _ in inside]
    for n, terms in enumerate(grams):
        for j, part in enumerate(inside):
            if part[n]:
                every[j].update([None, *terms])
                docs[j].update([None, *set(terms)])
    for most in (1, 5, 1000):
        found = {r["term"]: (r["corpus_count"], r["doc_count"]) for r in _counted_terms(df, "t", most=most).collect()}
        assert found == {t: (n, docs[0][t]) for t, n in every[0].items()}
        found = {r["term"]: (r["corpus_count"], r["doc_count"]) for r in _counted_terms(df, "t", parts, most=most).collect()}
        assert found == {t: ([every[1][t], every[2][t]], [docs[1][t], docs[2][t]]) for t in every[0]}
    assert _counted_terms(df.filter("n < 0"), "t").collect() == []

    lists, within = pa.array([(w or "").split() for w in texts]), np.array(inside[1:]).T
    whole = [*_term_sums(lists, within, 10_000)]
    for most in (1, 7, 40):
        slices = [*_term_sums(lists, within, most)]
        assert len(slices) > 1 and max(c.size for _, c, _ in slices) <= max(most, 2)
        assert pa.concat_arrays([t for t, _, _ in slices]).to_pylist() == whole[0][0].to_pylist()
        assert all(np.array_equal(np.concatenate([s[k] for s in slices]), whole[0][k]) for k in (1, 2))

    batch = pa.RecordBatch.from_arrays([pa.array([["a"] * k if k is not None else None for k in (3, 0, 9, None, 2, 2, 2, 1)])], ["words"])
    runs = [r.column(0).to_pylist() for r in _word_runs([batch, batch], 4)]
    assert [w for r in runs for w in r] == batch.column(0).to_pylist() * 2
    assert all(sum(map(len, filter(None, r))) <= 4 or sum(map(bool, r)) == 1 for r in runs) and all(runs)

    names = ["cd", "ab cd", "none", "cd ab", "no such pair", "cd cd", ""]
    rows, places = _term_finder(names)(pa.array([["ab", "cd", "ab", "cd"], None, [], ["x", "cd"], ["cd", "x", "ab"], ["cd", "cd", "cd"]]))
    assert sorted(zip(rows.tolist(), places.tolist())) == [(0, 0), (0, 0), (0, 1), (0, 1), (0, 3), (3, 0), (4, 0), (5, 0), (5, 0), (5, 0), (5, 5), (5, 5)]
    assert [x.tolist() for x in _term_finder([])(pa.array([["ab", "cd"]]))] == [[], []]
