import html
import itertools
import math
import re
import time

import pytest

from flowlens.llm import html_extract as H


@pytest.fixture(scope="module")
def model():
    return H.train()


def _text(n):
    return "Of the many things that were said about the harbour, few were true, and fewer still were written down by anyone. " * n


#: Layouts that the model has not seen: page, text.
NEW = [
    (f"<html><head><title>T</title></head><body><div class='topnav'><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></div><main><article><h1>Harbour</h1><p>{_text(2)}<p>Short."
     f"</article></main><div id='cookie-banner'>We use cookies.</div><aside><p>{_text(1)}</p></aside><footer>&copy; Me</footer>", f"Harbour\n{_text(2).strip()}\nShort."),
    (f"<body><div class=\"page-content\"><h2>A &amp; B</h2><p>{_text(1)}</p><blockquote>Said   so\n once.</blockquote></div><section class=\"comments-area\"><p>{_text(3)}</p></section></body>",
     f"A & B\n{_text(1).strip()}\nSaid so once."),
    (f"<body><header>Site name</header><article><h1>One</h1><p>a <b>bold</b> <a href=x>link</a>&nbsp;end</p><p>{_text(1)}</p></article><form><label>Name</label><input></form></body>",
     f"One\na bold link end\n{_text(1).strip()}"),
    ("<p>only text &lt;b&gt; &#233; &quot;q&quot;</p>", "only text <b> é \"q\""),
]


@pytest.mark.parametrize("source,text", NEW)
def test_new_layouts(model, source, text):
    assert H.main_text(source, model) == text


def test_marginals_against_all_labelings(model):
    for source in ("<body><nav><a href=x>a</a></nav><p>b c d.</p>", "<div class=ad>x</div><ul><li>one<li>two</ul>", "plain"):
        page = H.parse(source)
        n = len(page.tags)
        node = [sum(model.weights[i] * x for i, x in H._evidence(page.tags[k], page.names[k], page.texts[k], page.links[k])) for k in range(n)]
        total, of = 0.0, [0.0] * n
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(a for a, b in zip(node, y) if b) + sum(model.edges[H._edge(page, k)][y[page.parents[k]]][y[k]] for k in range(1, n)))
            total += w
            for k in range(n):
                of[k] += w * y[k]
        assert model.marginals(page) == pytest.approx([x / total for x in of], abs=1e-9)


def test_parse_of_broken_pages():
    page = H.parse("<div><p>a<div>b</p>c<span>d</div><script>if (a < b) x('</p>')</script>e<!-- no --><style>p{}</style>f<br>g&amp h<ul><li>1<li>2")
    assert [t for t in page.texts if t] == ["a", "b", "cd", "ef g& h", "1", "2"]
    for odd in ("", "<", "<<>>", "</p></div>", "<!--", "<script>", "<p", "a" * 100_000, "<div>" * 20_000 + "deep", "&#0;&#xD800;&bogus;"):
        H.main_text(odd, H.ContentModel([0.0] * len(H.FEATURES), ((((0.0, 0.0),) * 2),) * 3))


def test_pages_table(spark, model):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    got = {r.page_id: r for r in H.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), model).collect()}
    assert len(got) == len(rows)
    for r in rows:
        body = r.html[r.html.index("<article>") + 9:r.html.index("</article>")]
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", body))
        want = "\n".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_odd_rows(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>x y z.</p>"), (3, "u", "<nav>a</nav>"), (3, "u", "<nav>a</nav>"), (4, "w", f"<article><p>{_text(20_000)}</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 text", "2 n_chars")
    got = sorted(((str(r.page_id), str(r.url), r.text == "", r.n_chars) for r in H.extract(pages, model).collect()))
    n = len(_text(20_000).strip())
    assert got == sorted([("1", "u", True, 0), ("2", "None", True, 0), ("None", "v", False, 6), ("3", "u", True, 0), ("3", "u", True, 0), ("4", "w", False, n)])
    assert H.extract(pages.limit(0), model).count() == 0


def test_options_and_controls_left_open_lose_no_text():
    texts = lambda source: [t for t in H.parse(source).texts if t]
    assert texts("<form><datalist id=d><option value=a>A<option value=b>B</datalist></form><p>article</p>") == ["article"]
    assert texts("<datalist><option value=a><option value=b></datalist><p>one</p><select><option>x</option></select><p>two</p>") == ["one", "two"]
    assert texts("<p>a <button>go</button> b</p><select><optgroup><option>x<option>y</select><p>c</p>") == ["a b", "c"]
    assert texts("<select><option>x<p>c</p><select><option>y</option></select><p>d</p>") == ["c", "d"]
    assert texts("<svg><p>c</p><iframe src=x><p>d</p>") == ["c", "d"] and texts("<option>x <b>y</b></option>z") == ["z"]
    assert texts("<p>c</p><script>var a") == ["c"]


@pytest.mark.parametrize("source, texts", [
    ("<p title=it's>First line, don't stop.</p><p>b</p>", ["First line, don't stop.", "b"]),
    ("a<!-->b<p>c-->d", ["ab", "c-->d"]), ("a<!--->b", ["ab"]), ("a<!-- x --!>b", ["ab"]), ("a<!-- x -- > y -->b", ["ab"]), ("a<!-- never closed", ["a"]),
    ("<p class='a b' id=\"x>y\">q</p>", ["q"]), ("<p data-x = 5 >ok</p>", ["ok"]), ("1 < 2 and 3 > 2", ["1 < 2 and 3 > 2"]), ("x<a href='cut off", ["x"]),
    ("<a href=/x/>link</a> z", ["link z"]), ("<!DOCTYPE html><?xml x?>hi", ["hi"]), ("", []),
])
def test_comments_quotes_and_cut_tags(source, texts):
    assert [t for t in H.parse(source).texts if t] == texts


@pytest.mark.parametrize("source", [
    "<a '" * 250_000, "<div>" * 200_000, "<b>x</i>" * 125_000, "<!x" * 300_000, "<!--" * 250_000, "<p x='>" * 150_000, "<select>" * 125_000, "<option><b>" * 90_000,
    "<td><table>" + "<div>" * 100_000 + "<td></td>" * 50_000, "<li><ul>" + "<div>" * 100_000 + "<li>" * 100_000,
], ids=["quotes", "open", "stray", "declarations", "comments", "values", "selects", "options", "cells", "entries"])
def test_hostile_pages_of_a_megabyte_take_seconds(source):
    begin = time.process_time()
    H.parse(source)
    assert time.process_time() - begin < 5


def test_long_pages_repeated_rows_and_empty_tables(spark):
    long = "<html><body><article>" + "".join(f"<p>Paragraph {i} of a very long page about rivers and stones.</p>" for i in range(20_000)) + "</article></body></html>"
    rows = [(1, "u", long), (1, "u", long), (2, None, None), (None, "v", ""), (3, "w", "<div>" * 5000 + "x")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' text", "1 n_chars")).collect()
    texts = [r.text for r in got if r.page_id == 1]
    assert len(got) == 5 and texts[0] == texts[1] and texts[0].count("\n") == 19_999
    assert all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id in (2, None)] == ["", ""]
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
