import itertools
import random

import numpy as np
import pytest

from scatterlake.llm import html


@pytest.fixture(scope="module")
def weights():
    return html.classifier()


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class='ad'>Buy now, it is cheap.</div><article><h1>A&amp;B</h1><p>One  two\nthree.<br>four<p><b>Five &lt;six&gt;.</article><footer>&copy; site</footer></body></html>", "A&B\nOne two three. four\nFive <six>."),
    ("<body><header><div class=logo>My site</div></header><main><h1>Title here</h1><p>First paragraph of the text.</p><script>var t='</p>';</script><p>Second one&nbsp;is here.</p><ul><li>item one<li>item two</ul></main><aside><h3>Related</h3><p>Another story that you may like.</p></aside><section id='comments'><h3>Comments</h3><div class='comment'><p>I liked this very much, thanks.</p></div></section></body>", "Title here\nFirst paragraph of the text.\nSecond one is here.\nitem one\nitem two"),
    ("<div id='cookie-notice' role='dialog'><p>We use cookies on this site.</p></div><div class='post-content'><p>Body text of the post.</p><form><label>Mail</label><p>Subscribe to our letter</p></form><p>More body text a", "Body text of the post.\nMore body text a"),
    ("<div class='content has-sidebar'><h2>Head</h2><p>Some words of the text.</p><!-- a > b --><table><tr><td>x<td>y</table></div><div class=sidebar><p>Popular posts of the week.</p></div>", "Head\nSome words of the text.\nx\ny"),
    (None, ""),
    ("", ""),
    ("<nav><a href='/'>only a menu</a></nav>", ""),
    ("<p>un &am", "un &am"),
]


def test_pages(weights):
    got = html.extract([p for p, _ in PAGES], weights)
    for (page, want), text in zip(PAGES, got, strict=True):
        assert text == want, page


def test_generated_templates(weights):
    rnd = random.Random(77)
    right = 0
    for _ in range(200):
        page = html.template(rnd)
        found = html.blocks(page)
        want = "\n".join(t.replace("\1", "") for t, _ in found if "\1" in t)
        right += html.extract([page.replace("\1", "").replace("\2", "")], weights)[0] == want
    assert right >= 185


def test_minimum_cut_is_a_minimum():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        gain = rng.normal(0, 1, n).tolist()
        links = [(int(a), int(b), float(rng.random())) for a, b in rng.integers(0, n, (int(rng.integers(0, 12)), 2))]
        cost = lambda x: -sum(g for g, k in zip(gain, x) if k) + sum(w for a, b, w in links if x[a] != x[b])  # noqa: B023, E731
        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(html.minimum_cut(gain, links)) - best) < 1e-9


def test_frame(spark, weights):
    rows = [(k, f"http://x/{k}", p, 1) for k, (p, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0], 2), (None, "u", "<p>x y</p>", 3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3)
    got = html.extracted(frame).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id == 0} == {PAGES[0][1]}
    assert html.extracted(frame.limit(0)).count() == 0


def test_long_and_deep_pages(weights):
    deep = "<div>" * 3000 + "text in the deep." + "</div>" * 3000
    wide = "".join(f"<p>paragraph number {k} of many.</p>" for k in range(3000))
    got = html.extract([deep, wide, "<" * 20000, "<a" * 5000, "<!--" * 4000, "&" * 9000], weights)
    assert got[0] == "text in the deep." and got[1].count("\n") == 2999


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ('<svg class="i"/><p>All of the article.</p><p>More of it stands here.</p>', "All of the article.\nMore of it stands here."),
        ("<math/><p>All of the article.</p>", "All of the article."),
        ("<svg><title/><style/><g><path d='M0'></g></svg><p>All of the article.</p>", "All of the article."),
        ("<svg><path d='M0'><p>All of the article.</p>", "All of the article."),
        ("<button><p>All of the article.</p>", "All of the article."),
        ("<object data=x><p>All of the article.</p>", "All of the article."),
        ("<iframe src=x><p>All of the article.</p>", "All of the article."),
        ("<p>So <math><mrow><mi>x</mi> <mo>=</mo> <mn>2</mn></mrow></math> holds <svg><g><path/></g></svg>here.</p>", "So x = 2 holds here."),
        ("<noscript><p>Without a script.</p></noscript><p>After it.<script>var a", "Without a script.\nAfter it."),
    ],
)
def test_only_scripts_and_the_like_are_dropped(inner, want):
    assert "\n".join(t for t, _ in html.blocks(f"<article><h1>T</h1>{inner}")) == f"T\n{want}"


def test_an_article_after_an_icon_stays(weights):
    page = "<article><h1>Title</h1><svg class='i'/><p>All of the article stands in this line.</p><p>The second line of it stands here, with <math><mi>x</mi></math> in it.</p></article>"
    assert html.extract([page], weights) == ["Title\nAll of the article stands in this line.\nThe second line of it stands here, with x in it."]


def test_very_deep_and_crossed_pages_take_linear_time():
    import time

    n = 100_000
    began = time.time()
    found = html.blocks("<div>x" * n + "</p></i></section>" * n + "<p>End of it.</p>")
    assert len(found) == n + 1 and found[-1][0] == "End of it."
    html.edges(found[-2000:])
    assert time.time() - began < 60
