"""Quality ranking and toxicity: held-out accuracy, edge cases, and their parts."""

import zlib

import numpy as np
import pytest

from flowlens.llm import quality_rank, toxicity
from flowlens.llm.linear import class_weights, fit_logistic, fit_logistic_rows, labelled_sample

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def _hits(result, labels, label):
    rows = result.where("held_out").join(labels, "doc_id").select(label, "predicted", "score").collect()
    y, p, s = (np.array(x) for x in zip(*rows))
    return (p[y == 1] == 1).mean(), (p[y == 0] == 0).mean(), s


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    good, bad, scores = _hits(quality_rank.classify(docs, quality_rank.fit(docs, labels)), labels, "quality")
    assert good > 0.98 and bad > 0.95 and scores.min() >= 0 and scores.max() <= 1


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    toxic, clean, scores = _hits(toxicity.classify(docs, model), labels, "toxic")
    assert toxic > 0.8 and clean > 0.98 and scores.min() >= 0 and scores.max() <= 1
    assert model.accuracies["none"] > 0.8 and model.accuracies["two_kinds"] > 0.8


@pytest.mark.parametrize("module,label", [(quality_rank, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, module, label):
    rows = [(1, "a b c " * 30), (2, "idiot moron trash " * 10), (2, "idiot moron trash " * 10), (3, None), (4, ""), (None, "some text"), (5, "w " * 300_000), (6, "İİ stupid ẞ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 score", "'x' label", "2 predicted")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (6, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        model = module.fit(docs, known)
        got = module.classify(docs, model).collect()
        assert sorted((str(r.doc_id) for r in got)) == sorted(str(d) for d, _ in rows)
        for r in got:
            assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    assert module.classify(docs.limit(0), module.fit(docs.limit(0), labels)).count() == 0
    kept = module.scored(docs, model, "_s")
    assert kept.columns == [*docs.columns, "_s"] and kept.count() == len(rows)


def test_sample_never_has_held_out_rows(spark):
    docs = spark.range(500).selectExpr("id doc_id", "'t' text")
    labels = spark.range(500).selectExpr("id doc_id", "cast(id % 2 as int) toxic")
    ids = [r.doc_id for r in labelled_sample(docs, labels, "toxic", 50).collect()]
    assert len(ids) == 100 and all(zlib.crc32(str(i).encode()) % 5 for i in ids)


def test_logistic_fit_and_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-x @ [2.0, -1.0]))).astype(float)
    assert np.allclose(fit_logistic(x, y), [2, -1], atol=0.25)
    for good, bad in ((3, 5), (5, 3), (1, 1), (200, 7)):
        a, b = quality_rank.preference_pairs(good, bad, 500)
        assert set(a) == set(range(good)) and set(b) == set(range(bad)) and len(set(zip(a, b))) == min(500, good * bad) or good * bad > 500


def test_label_model_learns_accuracies_and_shares_weight():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    say = lambda right: np.where(rng.random(4000) < right, truth, ~truth) * 2 - 1
    one = say(0.75)
    votes = np.column_stack([say(0.9), say(0.8), say(0.85), one, one, one])
    belief, right, share = toxicity.label_model(votes, np.clip((votes.mean(1) + 1) / 2, 0.05, 0.95))
    assert ((belief > 0.5) == truth).mean() > 0.9
    assert abs(right[0] - 0.9) < 0.06 and abs(right[3] - 0.75) < 0.08
    assert share[3] < 0.5 < share[0]


def test_rows_per_class_do_not_move_the_calibration(spark, tables):
    docs, labels = tables
    seen = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    total = seen.where("toxic = 1").count() / seen.where("toxic in (0, 1)").count()
    # The first sample is half toxic, the last is nearly all labels.
    for per_class in (150, 4000):
        model = toxicity.fit(docs, labels, per_class)
        got = toxicity.classify(docs.join(labels, "doc_id"), model).agg({"score": "avg"}).first()[0]
        assert abs(got - total) < 0.03, per_class
    assert class_weights(labels, "toxic", 10**9) == (1.0, 1.0)
    low, high = class_weights(labels, "toxic", 150)
    assert abs(high / (low + high) - total) < 1e-9


def test_quality_learns_from_every_labelled_row(spark):
    rows = [(i, ("plain words of a text, " if i % 2 else "### $$ A A ") * (1 + i % 7) + str(i)) for i in range(10_600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    model = quality_rank.fit(docs, labels)
    x = np.array([quality_rank.features(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5])
    y = np.array([i % 2 for i, _ in rows if zlib.crc32(str(i).encode()) % 5])
    assert min((y == 1).sum(), (y == 0).sum()) > 4000
    assert np.allclose(model.centre, x.mean(0), rtol=1e-12) and np.allclose(model.spread, x.std(0) + 1e-6, rtol=1e-9)
    assert (model.score(x[y == 1]) >= 0.3).all() and (model.score(x[y == 0]) < 0.3).all()


def test_fit_over_rows_equals_fit_on_driver(spark):
    rng = np.random.default_rng(3)
    x, u = rng.normal(size=(300, 3)), rng.uniform(0.5, 2, 300)
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=300) > 0).astype(float)
    table = spark.createDataFrame([(a.tolist(), float(b), float(c)) for a, b, c in zip(x, y, u)], "x array<double>, y double, weight double").repartition(5)
    assert np.allclose(fit_logistic_rows(table, 3, ridge=3.0), fit_logistic(x, y, u, ridge=3.0), atol=1e-8)
