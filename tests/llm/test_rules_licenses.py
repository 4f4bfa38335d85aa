"""The native operators against plain Python on whole texts."""

import math
import random
import re

import duckdb
import pytest

from flowlens.llm import check_sql, licenses, quality_rules

ODD = [
    (1, "The quick brown the quick brown the quick fox.\n\n \nline one\nline one\n\x0bline one \n"), (2, None), (3, ""), (4, " \t\r\n\x0c "), (5, "a a a a"), (5, "a a a a"),
    (None, "no id here"), (6, "one two three"), (7, "#%% ***| x\x1cy é\xa0z"), (8, "w x y z " * 30_000), (9, "a b c d a b c e b c d"),
    (10, "The MIT license and the Apache License; GNU General Public License. mit license"), (11, "licenseK İMIT LICENSE mit-license MIT\nLicense x"),
    (12, "license general public license license"), (13, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\n"), (14, "mitté license"),
    (15, "filler " * 40 + "Permission is hereby granted, free of charge, to any individual obtaining a copy of this software and associated documentation files (the "
         "\"Software\"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish"),
    (16, "ÀÉ Released UNDER the mit License " * 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "case when doc_id % 2 = 0 then 'en' end lang", "1 row", "'z' words", "2 label", "3 n_words")


def _plain_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i:i + 3]), []).append(i)
    marked = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked),
            len(words) < 50 or 100 * len(marked) > 50 * len(words))


def test_base_rules(spark, odd):
    got = quality_rules.judge(odd).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((str(r.doc_id), *(r[c] for c in columns)) for r in got)) == sorted((str(d), *_plain_rules(t)) for d, t in ODD)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.judge(odd.limit(0)).count() == 0


def test_base_rules_on_random_texts(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab \n\t|") for _ in range(rng.randint(0, 300)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang")
    got = {r.doc_id: tuple(r)[1:7] for r in quality_rules.judge(docs).collect()}
    assert got == {i: _plain_rules(t) for i, t in rows}


def test_js_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    df = spark.createDataFrame([(p, q), (p, p), ([1.0, 0.0, 0.0], [0.0, 0.0, 1.0])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(quality_rules.js_distance(df.p, df.q)).collect()]
    assert got == pytest.approx([math.sqrt((kl(p) + kl(q)) / 2), 0, 1], abs=1e-9)


def test_divergence_keeps_clean_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.judge(docs).join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1


def test_references_follow_the_number_of_documents_smoothly(spark):
    """The same German texts beside 59, 60, 61 and 400 others of their language: distances move by the language's weight, in Spark and in SQL."""
    rng = random.Random(4)
    english = "the of and to in is that for it with was house river stone cloud light garden window market".split()
    german = "der die und das von zu mit den ist haus fluss stein wolke licht garten fenster markt strasse".split()
    prose = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(n))
    base = [(i, prose(english, 150), "en") for i in range(300)]
    others = [(1000 + i, prose(german, 150), "de") for i in range(400)]
    asked = [(5000, prose(german, 150), "de"), (5001, prose(german, 70), "de"), (5002, "x1 " * 60 + "y2 z3 " * 3, "de"), (5003, prose(english + german, 140), None), (5004, prose(german, 55), "xx")]
    found = []
    for n in (59, 60, 61, 400):
        rows = base + others[:n] + asked
        judged = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
        found.append({r.doc_id: r.word_distance for r in judged if r.doc_id >= 5000})
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
        want = {r[0]: r[1:] for r in con.execute(check_sql.quality_rules()).fetchall()}
        assert {r.doc_id: tuple(r)[1:8] for r in judged} == want
    steps = [abs(a[5000] - b[5000]) for a, b in zip(found, found[1:])]
    assert max(steps[:2]) < 0.01 and found[3][5000] < found[0][5000]


def test_guards_of_short_texts(spark):
    rows = [(i, n, far, 0.99) for i, (n, far) in enumerate([(59, 0.99), (60, 0.99), (60, 0.0), (99, 0.0), (100, 0.0)])]
    df = spark.createDataFrame(rows, "id int, n_words int, character_distance double, word_distance double")
    assert [r[0] for r in df.orderBy("id").select(quality_rules.near()).collect()] == [True, False, True, True, False]


def _plain_base(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    found = [(i, label) for i in range(len(words)) for phrase, label in licenses.PHRASES if tuple(words[i:i + len(phrase)]) == phrase]
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))


def test_license_scan(spark, odd):
    got = licenses.scan(odd).collect()
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(((d, *_plain_base(t)) for d, t in ODD), key=key)
    labels = {r.doc_id: (r.labels, r.score) for r in got}
    assert labels[13][0] == "cc-by-nc,mit" and labels[13][1] == 1.0
    assert labels[15][0] == "mit" and 0.5 <= labels[15][1] < 1
    assert labels[16][0] == "mit" and labels[6] == ("", 0.0) and labels[12][0] == "gpl"
    assert licenses.scan(odd.limit(0)).count() == 0


def test_diagonals_by_brute_force(spark):
    rng = random.Random(2)
    label, text = licenses.TEMPLATES[0]
    words = text.split()
    rows = []
    for i in range(40):
        part = words[rng.randint(0, 10):rng.randint(15, len(words))]
        part = [w if rng.random() > 0.03 else "changed" for w in part]
        rows.append((i, " ".join(["pre"] * rng.randint(0, 9) + part)))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    own = cut(text)
    grams = [tuple(own[i:i + 4]) for i in range(len(own) - 3)]
    for i, t in rows:
        doc = cut(t)
        votes = {}
        for p in range(len(doc) - 3):
            for a, g in enumerate(grams):
                if tuple(doc[p:p + 4]) == g:
                    votes.setdefault(p - a, []).append(a)
        best = max((len(v) for v in votes.values()), default=0) / len(grams)
        assert ("mit" in got[i].labels) == (best >= 0.5) and (best < 0.5 or abs(got[i].score - best) < 1e-9)


def test_siblings_are_told_apart(spark):
    gpl = next(t for label, t in licenses.TEMPLATES if label == "gpl")
    named = lambda name: gpl.replace("GNU General", f"GNU {name} General")
    cases = [
        (gpl, "gpl"), (named("Lesser"), "gpl,lgpl"), (named("Affero"), "agpl,gpl"), (named("Library"), "gpl"), (f"{gpl} {'x ' * 30} {named('Affero')}", "agpl,gpl"),
        ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa"), ("Licensed under CC BY-NC-ND 4.0.", ""), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("Licensed under CC BY-SA 4.0.", "cc-by-sa"), ("Licensed under CC BY-ND 4.0.", "cc-by-nd"), ("Licensed under CC BY 4.0.", "cc-by"), ("nc by nc licensed", ""),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ""),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"), ("general", ""), ("nc", ""), ("lesser", ""),
        ("It was released under the MIT umbrella of research labs.", ""), ("It is licensed under the MIT rules of the house.", ""),
        ("This source code form is subject to the terms of the house.", ""), ("Released under the MIT License.", "mit"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License.", "mpl"),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: want for i, (_, want) in enumerate(cases)}
    assert got[0][1] == got[5][1] == 1.0 and got[6][1] == 0.0
    # The check SQL has the same rules.
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (t, _) in enumerate(cases)])
    result = con.execute(check_sql.license_scan())
    names = [d[0] for d in result.description]
    rows = {r["doc_id"]: (r["labels"], r["score"]) for r in (dict(zip(names, r)) for r in result.fetchall())}
    assert rows == got
