import html
import itertools
import random
import re
import time

import numpy as np
import pytest
from quantloom.llm.html_text import Forest, Tree, extract_text, fit, labels_of, learn, read, redress, start, sum_product
from quantloom.llm.queries import QUERIES

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def blocks(page):
    return [t for t in read(page).text if t is not None]


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.read.parquet(f"{MORE}/pages.parquet"))


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("<p>a <b>b<br>c</p><p>d", ["a b c", "d"]),
        ("<p>a<p>b<div>c<p>d</div>e", ["a", "b", "c", "d", "e"]),
        ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("x &amp;amp; &eacute;&#233;&#xe9; &nbsp; y &copy", ["x &amp; ééé y ©"]),
        ("a<script>var t='</p><p>';</script>b<style>p{}</style>c<!-- <p> -->d<!-->e", ["abcde"]),
        ('<a title="x>y" href=z>t</a> 1 < 2', ["t 1 < 2"]),
        ("<p>a</p><script>never ends", ["a"]),
        ("<p>a<!-- never ends <p>b", ["a"]),
        ("<p>a</p><button>never ends<p>b", ["a", "never ends", "b"]),
        ("a</p>b</div></x>c", ["a", "bc"]),
        ("<P>A</P><DIV>B</DIV>\n\t c  d", ["A", "B", "c d"]),
        ("a <div", ["a"]),
    ],
)
def test_blocks_of_pages(page, want):
    assert blocks(page) == want


def test_reading_takes_linear_time_and_deep_pages_keep_their_text():
    for bit in ("<div>", "<b>", "<p><b>x", "<!--", '<a x="', "<a x='\">", "<button>", "</div>", "<", "&", "<li>", "< a=' ", "<x y=  ", "<script>", "<td><p>"):
        t = time.time()
        read(bit * 60000)
        assert time.time() - t < 8, bit
    assert blocks("<div>" * 1000 + "x" + "</div>" * 1000 + "<p>y") == ["x", "y"]


def test_messages_equal_all_labellings(spark):
    rng, np_rng = random.Random(3), np.random.default_rng(3)
    trees = []
    for _ in range(6):
        t = Tree()
        for _ in range(rng.randrange(0, 8)):
            t.add(rng.randrange(len(t.parent)), rng.choice(["div", "p", "nav"]))
        for k in range(len(t.parent)):
            if k not in t.parent and k:
                t.text[k] = "some text"
        trees.append(t)
    forest, model = Forest(trees), start()
    w, e = model.weights + np_rng.normal(size=len(model.weights)), np_rng.normal(size=(3, 2, 2))
    p, expected = sum_product(forest, w, e)
    node = np.bincount(forest.node, w[forest.feature], len(forest.parent))
    wanted = np.zeros((3, 2, 2))
    for t, s in zip(trees, forest.starts, strict=False):
        n = len(t.parent)
        every = []
        for y in itertools.product((0, 1), repeat=n):
            edges = [(forest.kind[s + k], y[t.parent[k]], y[k]) for k in range(1, n)]
            every.append((np.exp(sum(node[s + k] for k in range(n) if y[k]) + sum(e[x] for x in edges)), y, edges))
        total = sum(x for x, _, _ in every)
        for k in range(n):
            assert np.isclose(p[s + k], sum(x for x, y, _ in every if y[k]) / total)
        for x, _, edges in every:
            for a in edges:
                wanted[a] += x / total
    assert np.allclose(expected, wanted)


def test_learned_weights_find_the_text_in_other_markup(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id % 9 = 4").select("html").collect()
    rng, right, every = random.Random(5), 0, 0
    for r in rows:
        tree = read(r.html)
        made, y = redress(tree, labels_of(tree), rng)
        good = sum_product(Forest([made]), model.weights, model.edges)[0] >= 0.5
        right += sum(int(g) == v for g, v, t in zip(good, y, made.text, strict=True) if t is not None)
        every += sum(t is not None for t in made.text)
    assert every > 4000 and right / every > 0.975


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join(rng.choice(["stone", "river", "walked", "under", "the", "bright", "old", "bridge", "slowly"]) for _ in range(n)).capitalize() + "."


def test_pages_of_other_kinds(model):
    a, b, c = words(40, 1), words(60, 2), words(30, 3)
    shop = f"""<html><body><div id="masthead"><a href=/>Site</a></div><div class="main-menu"><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>
      <div class="cookie-banner">{words(20, 4)} We use cookies. <button>OK</button></div><div class="postContent"><h1>The title</h1><p>{a}</p><p>{b} <a href=x>link</a></p></div>
      <div class="sidebar"><h3>Related</h3><ul><li><a href=3>Three</a></li></ul></div><div id="comments"><h3>2 comments</h3><div class="comment"><p>{c}</p></div></div>
      <form action=/s><label>Search</label><input name=q></form><div class="footer">&copy; 2020 All rights reserved</div></body></html>"""
    assert model.text([shop]) == [f"The title\n\n{a}\n\n{b} link"]
    plain = f"<body><table><tr><td><a href=1>Home</a> <a href=2>News</a></td></tr><tr><td><p>{a}<p>{b}<p>{c}</td></tr></table></body>"
    assert model.text([plain]) == [f"{a}\n\n{b}\n\n{c}"]
    assert model.text([None, "", "<nav><a href=x>y</a></nav>"]) == ["", "", ""]


def truth(page):
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(x for x in parts if x)


def test_query_gives_each_pages_article(spark):
    for d in (SMALL, MORE):
        want = sorted((r.page_id, r.url, truth(r.html), len(truth(r.html))) for r in spark.read.parquet(f"{d}/pages.parquet").collect())
        got = sorted(map(tuple, QUERIES["op11_html_text"](spark, d).collect()))
        assert len(got) == len(want) and sum(a == b for a, b in zip(got, want, strict=True)) >= 0.99 * len(want)


def test_null_repeated_long_and_clashing_columns(spark, model):
    long = "<article>" + f"<p>{words(12)}</p>" * 20000 + "</article>"
    rows = [(1, "u", None, "t", 0), (1, "u", None, "t", 0), (None, None, "<article><p>" + words(30) + "</p></article>", "t", 0), (3, "v", long, "t", 0), (4, "w", "", "t", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = extract_text(df, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in got.collect()), key=str)
    assert [x[0] for x in by] == [0, 1, 1, 3, 4] and by[0][2] == words(30) and by[1][2] == "" == by[4][2]
    assert by[3][2] == "\n\n".join([words(12)] * 20000) and all(len(x[2]) == x[3] for x in by)
    assert extract_text(df.limit(0)).count() == 0
    assert np.array_equal(learn([]).weights, start().weights) and extract_text(df.where("page_id = 4")).first().text == ""
