"""The corpus pipeline against a plain version, and its stages on odd rows."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest

import corpus_pipeline
from flowlens.llm import quality_rank, toxicity
from tests.llm.test_simhash import plain_classes, plain_fingerprint


def _write(spark, folder, documents, labels, benchmark):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    item = [rng.choice(words) for _ in range(30)]
    documents, labels = [], []
    for i in range(240):
        text, good, bad = prose(rng.randint(80, 200)), 1, 0
        if i % 6 == 0:
            text, good = " | ".join([rng.choice(words[:9])] * 60), 0
        elif i % 6 == 1:
            at = rng.randint(0, 60)
            text, bad = f"{text[:at]} you idiot and moron {text[at:]} what stupid trash", 1
        elif i % 24 == 2:
            text = f"{prose(50)} {' '.join(item)} {prose(50)}"
        elif i % 24 == 3 and i > 24:
            text = documents[-24][1]
        documents.append((i, text, "en", "s", len(text)))
        if i % 3 != 2:
            labels.append((i, good, bad))
    documents += [(1000, "", None, None, 0), (1001, None, None, None, None), (None, prose(90), "en", None, 1), (1002, "word " * 50_000, "en", "s", 1)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    _write(spark, folder, documents, labels, [(1, " ".join(item)), (2, None)])
    return folder, documents, " ".join(item)


def test_pipeline_against_a_plain_version(spark, corpus):
    import tiktoken

    folder, documents, item = corpus
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    ranker = quality_rank.fit(docs, labels)
    left = [d for d in documents if ranker.score(quality_rank.features(d[1] or "")[None])[0] >= 0.3]
    voters = toxicity.fit(spark.createDataFrame(left, docs.schema), labels)
    left = [d for d in left if voters.score([d[1]])[0] < 0.5]
    best = {}
    for d, c in zip(left, plain_classes([plain_fingerprint(d[1]) for d in left])):
        best[c] = min(best.get(c, d), d, key=lambda x: (x[0] is None, x[0] or 0))
    left = [d for d in best.values() if item not in (d[1] or "")]
    assert 90 < len(left) < 180

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d in left:
        ids = library.encode_ordinary(d[1] or "")
        want.append((str(d[0]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d[1] or "").encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got) == sorted(want)


def test_stages_catch_planted_rows_and_keep_clean_ones(spark, corpus):
    folder, documents, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        kept.append({r.doc_id for r in after.select("doc_id").collect()})
        docs = after
    ids = lambda test: {d[0] for d in documents if d[0] is not None and d[0] < 240 and test(d[0])}
    assert not kept[0] & ids(lambda i: i % 6 == 0) and kept[0] >= ids(lambda i: i % 6)
    assert not kept[1] & ids(lambda i: i % 6 == 1) and kept[1] >= ids(lambda i: i % 6 > 1)
    assert not kept[2] & ids(lambda i: i % 24 == 3 and i > 24) and 3 in kept[2]
    assert not kept[3] & ids(lambda i: i % 24 == 2) and kept[3] >= ids(lambda i: i % 6 > 3)


def test_stages_on_empty_and_wider_tables(spark, corpus, tmp_path):
    folder, documents, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.limit(40).selectExpr("*", "1 quality_score", "2 toxic_score", "3 fingerprint", "4 row", "5 leak_id", "6 doc", "7 label")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, folder).columns == wide.columns, name
    _write(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
