import random

import numpy as np
import xxhash

from flowlens.llm import simhash
from flowlens.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_classes(values, most=3):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_fingerprint_and_pieces(monkeypatch):
    rng = random.Random(5)
    texts = ["", "one", "Two Words", "THREE small words", "é É ñ x", "a\x0bb\x1cc d e f", *(" ".join(rng.choice("abcde") for _ in range(n)) for n in (3, 50, 400))]
    for piece in (1 << 20, 7):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert [simhash.fingerprint(t) % (1 << 64) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_covering_finds_every_pair():
    rng = random.Random(1)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(1, 3)):
            y ^= 1 << b
        keys, values, homes = simhash.anchors(np.array([x, y], np.uint64).view(np.int64))
        at = [{int(k) for k, v, h in zip(keys, values.view(np.uint64), homes) if v == z and (h or not home)} for z, home in ((x, True), (y, False))]
        assert at[0] & at[1]
        assert len(at[1]) <= 32


def test_links_and_hot_anchors(spark, monkeypatch):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    values = {0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(200))}
    for _ in range(400):
        values.add(centre ^ sum(1 << b for b in rng.sample(range(0, 64, 5), rng.randint(0, 4))))
    chain = rng.getrandbits(64)
    for b in range(0, 60, 3):
        values.add(chain := chain ^ (7 << b))
    values = sorted(values)
    for home in (2048, 5):
        monkeypatch.setattr(simhash, "HOME", home)
        df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fingerprint long")
        roots = {r.node % (1 << 64): r.root % (1 << 64) for r in components(simhash.links(df)).collect()}
        groups = {}
        for v, c in zip(values, plain_classes(values)):
            groups.setdefault(c, set()).add(v)
        got = {}
        for v in values:
            got.setdefault(roots.get(v, v), set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(3, 3), (-5, 200), (200, -5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 7 for i in range(8, 60)}, 200: -5}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split() * 30
    near = [*words]
    near[100] = "other"
    rows = [(5, " ".join(words)), (9, " ".join(near)), (9, " ".join(near)), (2, " \n "), (1, None), (None, ""), (None, "quite alone here"), (4, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 fingerprint", "'a' root", "2 first")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    values = [plain_fingerprint(t) for _, t in rows]
    classes = plain_classes(values)
    want = []
    for (doc, _), v, c in zip(rows, values, classes):
        want.append((doc, f"{v:016x}", min((d for (d, _), k in zip(rows, classes) if k == c and d is not None), default=None)))
    assert got == sorted(want, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
