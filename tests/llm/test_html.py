import html as entities
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.llm import html


def blocks(source):
    return [t for t in html.parse(source).text if t is not None]


def test_blocks_of_a_page():
    assert blocks("<p>a  <b>b</b>c<br>d<p>e&amp;f &#233;&nbsp;g</p>tail") == ["a bc d", "e&f é g", "tail"]
    assert blocks("<script>var t='</p>';</script><style>p{}</style><title>no</title><!-- no --><p>yes<!-- no") == ["yes"]
    assert blocks("<ul><li>one<li>two</ul><table><tr><td>x<td>y<tr><td>z</table>") == ["one", "two", "x", "y", "z"]
    assert blocks('<p title="a > b">in</p><select><option>no</select><p class=x>unended <b') == ["in", "unended"]
    assert blocks("&am and &amp and &lt;p&gt;") == ["&am and & and <p>"]
    assert blocks("") == [] and blocks("<") == ["<"] and blocks("a < b") == ["a < b"]
    assert blocks("<div>" * 3000 + "deep" + "</div>" * 3000) == ["deep"]
    assert blocks("</p></div>x</li>") == ["x"]


def test_links_end_with_their_block():
    page = html.parse("<p><a href=x>one</p><p>two</p>")
    assert [(t, n) for t, n in zip(page.text, page.links, strict=True) if t] == [("one", 3), ("two", 0)]


def test_sum_product_against_enumeration():
    rng = np.random.default_rng(1)
    pages = [html.parse(s) for s in ("<div><p>a</p><ul><li>b</ul></div>", "x", "", "<h1>t</h1><nav><p>u</p></nav>")]
    f = html.forest(pages)
    unary = rng.normal(size=(len(f.parent), 2))
    edges = rng.normal(size=(9, 2, 2))
    single, joint = html.sum_product(f, unary, edges)
    n = len(f.parent)
    want, pairs, total = np.zeros((n, 2)), np.zeros((n, 2, 2)), 0.0
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(edges[f.kind[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0))
        total += w
        for i in range(n):
            want[i, y[i]] += w
            if f.parent[i] >= 0:
                pairs[i, y[f.parent[i]], y[i]] += w
    assert np.allclose(single, want / total) and np.allclose(joint, pairs / total)


def test_gradient_learns_labels():
    pages = [html.parse(f"<nav><p>menu {k}</p></nav><main><p>story {k}</p></main>") for k in range(20)]
    model = html.train(pages, [[int(t is not None and "story" in t) for t in p.text] for p in pages])
    assert html.texts(model, ["<nav><p>menu x</p></nav><main><p>story y</p></main>"]) == ["story y"]


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return html.fit(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def test_held_out_layouts(model):
    pages = [html.parse(s) for s in html.layouts(200, seed=77)]
    labels = [html.marked(p) for p in pages]
    wrong = total = 0
    for page, own, p in zip(pages, labels, model.marginals(pages), strict=True):
        for text, y, q in zip(page.text, own, p, strict=True):
            if text is not None:
                total += 1
                wrong += (q >= 0.5) != bool(y)
    assert wrong / total < 0.01


def test_given_pages(model, spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumns({"text": F.lit("x"), "h": F.lit(1)})
    got = {r.page_id: r for r in html.extract(pages, model).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        own = re.search("<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        plain = " ".join(entities.unescape(re.sub("<(?:/?p|/?h1|br)>", " ", re.sub("</?b>", "", own))).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (plain, len(plain), r.url)


def test_page_without_semantic_markup(model):
    story = [f"This is sentence {k} of a story that goes on for quite some time, and it ends here." for k in range(5)]
    page = (
        '<div class="navbar"><a href=/>Home</a> <a href=/n>News</a></div><div class="cookie-notice">We use cookies to make this site work for you.</div>'
        '<div class="sidebar"><h3>Related</h3><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></div>'
        f'<div class="post-content"><h1>A story</h1>{"".join(f"<p>{s}</p>" for s in story)}<div class="ad">Buy now, buy cheap.</div></div>'
        '<form><label>Search</label><input name=q></form><div class="comments"><div class="comment"><p>I do not agree with any of this at all, sorry.</p></div></div>'
        '<div class="footer">&copy; Someone, all rights reserved.</div>'
    )
    assert html.texts(model, [page]) == [" ".join(["A story", *story])]


def test_edges(model, spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<nav><ul><li><a href=/>Home</a></ul></nav>"), (2, "u", "<nav><ul><li><a href=/>Home</a></ul></nav>")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "", 0), ("2", "", 0), ("2", "", 0), ("None", "", 0)]
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(none, html.fit(none, n_layouts=20)).count() == 0
    long = "<article>" + "<p>Some words of a long page, again and again.</p>" * 30_000 + "</article>"
    assert html.texts(model, [long])[0].count("Some words") == 30_000


ARTICLE = "<h1>Title here</h1><p>One paragraph of an article that says this and that, and goes on.</p><p>A second paragraph, which is shorter.</p><p>Third.</p>"
TEXT = "Title here One paragraph of an article that says this and that, and goes on. A second paragraph, which is shorter. Third."


@pytest.mark.parametrize(
    "page",
    [
        f"<article>{ARTICLE}<section id=comments><h2>Comments</h2><div class=comment><p>I think that this is a very good article, and I want to say so at length.</p></div></section></article>",
        f"<nav><a href=/>Home</a></nav><article>{ARTICLE}</article><aside><h3>Related</h3><p>Read also this other story about something else entirely.</p></aside><footer>&copy; 2024</footer>",
        f"<div class='notice'>We have changed our terms. Please read them with care before you go on.</div><article>{ARTICLE}</article>",
        f"<article>{ARTICLE}<form action=/subscribe><p>Subscribe to our letter and get news every week.</p><input type=email></form></article>",
        f"<header><h1>Site name</h1><p>The daily news of everything</p></header><article>{ARTICLE}</article>",
        f"<article>{ARTICLE.replace('</p><p>A', '</p><div class=advert>Buy our things now, they are cheap and good.</div><p>A')}</article>",
        f"<div class=header>Site</div><div class=article-body>{ARTICLE}</div><div class='sidebar'><p>Some text in the side bar that is about as long as a paragraph.</p></div>",
        f"<div role=navigation><a href=a>A</a> <a href=b>B</a></div><div role=main>{ARTICLE}</div><div role=complementary><p>Other stuff to read about, a long line of text.</p></div>",
        f"<table><tr><td class=menu><a href=a>A</a><br><a href=b>B</a></td><td class=content>{ARTICLE}</td></tr></table>",
        f"<article>{ARTICLE}</article><div class='reader-comments'><h3>3 comments</h3><ol><li><b>Ann</b><p>I liked it very much, thanks for writing this long article.</p></li></ol></div>",
        ARTICLE,
    ],
)
def test_common_layouts(model, page):
    assert html.texts(model, [f"<html><head><title>X</title></head><body>{page}</body></html>"]) == [TEXT]
