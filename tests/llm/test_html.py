import html as entities
import re
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import html
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def model(spark):
    return html.learn(spark.read.parquet(f"{SMALL}/pages.parquet"))


def test_every_page_of_the_table(spark, model):
    rows = html.extract(spark.read.parquet(f"{SMALL}/pages.parquet"), model).collect()
    assert len(rows) == 50
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        assert r.text == " ".join(entities.unescape(re.sub(r"</?(p|h1|br|b)>", " ", inner)).split())


def test_layouts_not_seen_in_training(spark, model):
    rng, exact = Random(1234), []
    pages = [html.Page(r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    parts = [html.blocks_of(p, html.semantic_truth(p)) for p in pages]
    other = [b for g in parts for b in g[2:4]]
    for g in parts:
        page = html.Page(source := html.recompose(rng, g[:10], other))
        exact.append(html.main_texts(model, [source])[0] == html.text_of(page, html.marked_truth(page)))
    assert np.mean(exact) >= 0.95


def test_references_blocks_and_broken_markup(model):
    words = "Enough ordinary words, to read here. " * 8
    page = (f"<!doctype html><html><body><nav><a href=x>Home</a></nav><main><h1>A&amp;B &lt;c&gt; &#233;&nbsp;x</h1><p>One<b>two</b>\n three{words}"
            f"<br>four<ul><li>five<li>six</ul><script>var x='</p>';</script><p>{words}<div class='ad'>Buy <b>now</b></div>"
            f"<form><p>your mail</p></form></main><div class='comments'><p>{words}</p></div><footer>end</footer>")
    want = " ".join(f"A&B <c> é x Onetwo three{words} four five six {words}".split())
    parsed = html.Page(page)
    assert html.text_of(parsed, html.semantic_truth(parsed)) == want
    assert html.main_texts(model, [page])[0].startswith(f"A&B <c> é x Onetwo three{words.strip()} four") and "Buy" not in want


def test_choices_never_contradict(model):
    rng = Random(3)
    for _ in range(50):
        page = html.Page("".join(rng.choice(["<div>", "</div>", "<p>", "<b>", "text, text. ", "<ul><li>", "<nav>", "</nav>", "<!-- c -->", "<![x", "&"])
                                 for _ in range(200)))
        _, own = html.describe(page)
        kept = html.decode(page, np.random.default_rng(1).normal(size=len(own)) * 3, own)
        ended = [False] * len(kept)  # content was above, junk since
        for i in range(1, len(kept)):
            p = page.parents[i]
            ended[i] = ended[p] or kept[p] and not kept[i]
            assert not (ended[i] and kept[i])


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "plain"), (4, "<p>"), (5, "<div>" * 3000 + "deep " * 50), (6, "<article><p>" + "long " * 100000),
            (6, "<article><p>" + "long " * 100000)]
    pages = spark.createDataFrame([(i, h, "old", 1) for i, h in rows], "page_id long, html string, text string, n_chars int")
    got = [(r.page_id, r.text) for r in html.extract(pages, model).collect()]
    assert got[:2] == [(1, ""), (2, "")] and got[3] == (4, "") and len(got) == 7
    assert got[5] == got[6] == (6, "long " * 99999 + "long")
    assert html.extract(pages.where(F.lit(False)), model).count() == 0
    assert html.learn(pages.where(F.lit(False))).splits


def test_trees_learn_a_rule():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = html.boost(x[:3000], y[:3000], np.ones(3000))
    assert np.mean((model.odds(x[3000:]) > 0) == y[3000:]) > 0.97


def test_marked_sections_are_comments(model):
    def whole(source):
        page = html.Page(source)
        return html.text_of(page, [True] * len(page.tags))

    assert whole("<p>a</p><![foo]><p>body text</p>") == "a body text"
    assert whole("<p>see <![1] note</p><p>c</p>") == "see c"
    assert whole("<p>a</p><![if x><p>b</p><![endif]><p>c</p><![CDATA[d>e]]>") == "a b c e]]>"
    assert whole("<p>a</p><svg><![CDATA[x>y]]></svg><p>b</p>") == "a b"
    assert whole("a <![foo") == "a <![foo"
    words = "Enough ordinary words, to read here. " * 8
    page = "<html><head>{}</head><body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>" + words + "</p>{}<p>" + words + "</p></article></body></html>"
    assert html.main_texts(model, [page.format("<![1]>", "<![2 x]>")]) == html.main_texts(model, [page.format("", "")]) == [f"Title {words}{words.strip()}"]


def test_page_inside_a_form(model):
    words = "Enough ordinary words, to read here. " * 8
    page = ("<html><body><{0} id=aspnet><nav><a href=x>Home</a></nav><div class=content><h1>Title</h1><p>" + words + "</p><p>" + words
            + "</p><form><p>your mail</p></form></div><footer>end</footer></{0}></body></html>")
    assert html.main_texts(model, [page.format("form")]) == html.main_texts(model, [page.format("div")]) == [f"Title {words}{words.strip()}"]
