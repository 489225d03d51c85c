"""op11: against its SQL on the tables, hand-made pages with known main text, cuts against all labellings."""

import itertools
import random

import pytest

from quire.llm.html_text import OP11_SQL, Flow, Page, extracted, labelled, main_text, op11_html_extraction

LONG = "This paragraph of the article is long enough to count as text, for it has many words in it."
ASIDE = "Some other text that is long enough to look like a paragraph of content, with many words in it."
PAGES = {
    "no main element, names only": (
        f"""<html><body class="has-sidebar nav-open"><header><h1>My Site</h1><p>Tagline of the site.</p></header>
        <div id="cookie-notice"><p>{ASIDE}</p></div><div class="content-sidebar-wrap"><div class="post entry-content"><h2>A title</h2>
        <p>{LONG}</p><p>Short.</p><ul><li>one item</li><li>two</li></ul><p>{LONG} More.</p><div class="share-buttons"><a href=x>Tweet</a></div></div>
        <div class="sidebar"><h3>Popular</h3><p>{ASIDE}</p></div></div><div id="comments"><h3>2 Comments</h3><div class="comment"><p>{ASIDE}</p></div></div>
        <form><label>Name</label><input></form><footer><p>&copy; 2020 me. All rights reserved.</p></footer></body></html>""",
        ["A title", LONG, "Short.", "one item", "two", f"{LONG} More."],
    ),
    "article with all that does not belong": (
        f"""<nav>Home</nav><main><article><header><h1>T &lt;b&gt;</h1></header><p>One<br>two&nbsp;three<p>Be.<aside>{ASIDE}</aside>
        <table><tr><td>a<td>b</table><div class=ad>Buy this thing now.</div><pre>x
          y</pre><section class="comments"><article class="comment"><p>{ASIDE}</p></article></section><footer>By X</footer></article></main>
        <div class="newsletter"><p>{ASIDE}</p></div><div>Something else.</div>""",
        ["T <b>", "One two three", "Be.", "a", "b", "x y"],
    ),
    "bare paragraph": (f"<p>{LONG}</p><script>x<p>y</p></script><!-- <p>no</p> -->", [LONG]),
    "hidden and role": (f'<div role="banner"><p>{ASIDE}</p></div><article><p>{LONG}</p><div hidden><p>{ASIDE}</p></div><p style="display: none">{ASIDE}</p></article>', [LONG]),
    "links in running text stay, lists of links beside it go": (f'<div><p>{LONG} <a href="#">A link</a>.</p></div><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div>', [f"{LONG} A link."]),
    "crossed and truncated": (f"<article><h1>T</h1><p><b>{LONG}<i></b> more</i><p>Last &amp;amp; &am", ["T", f"{LONG} more", "Last &amp; &am"]),
    "only boilerplate": ("<nav>a</nav><footer>b</footer>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_known_pages(name):
    html, want = PAGES[name]
    assert main_text(html).split("\n") == (want or [""])


def test_equals_sql(spark, duck, data, same_rows):
    same_rows(op11_html_extraction(spark, data).toPandas(), duck.execute(OP11_SQL).df())


def test_least_cuts():
    r = random.Random(2)
    for _ in range(150):
        n = r.randrange(1, 9)
        ends = [(r.randrange(9), r.randrange(9)) for _ in range(n)]
        edges = [(a, b, r.randrange(7)) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]
        flow = Flow(n + 2)
        for i, (s, t) in enumerate(ends):
            flow.join(n, i, s)
            flow.join(i, n + 1, t)
        for a, b, c in edges:
            flow.join(a, b, c, c)
        cost = lambda side: sum(t if side[i] else s for i, (s, t) in enumerate(ends)) + sum(c for a, b, c in edges if side[a] != side[b])
        assert cost(flow.cut(n, n + 1)) == min(map(cost, itertools.product((True, False), repeat=n)))


def test_long_and_deep_pages():
    html = "<article>" + f"<p>{LONG}</p><p>x</p>" * 5000 + "</article>" + f"<div class=ad><p>{ASIDE}</p></div>" * 2000
    assert main_text(html).count("\n") == 9999
    assert [t for t, _, c in labelled(Page("<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000)) if c] == [LONG]


def test_odd_rows(spark):
    rows = [(1, None, "q"), (2, "", "q"), (None, "<p>", None), (4, f"<article><p>{LONG}", "q"), (4, f"<article><p>{LONG}", "q"), (5, "no tags at all, but a sentence with quite a few words that a reader would call text.", "q")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = extracted(df, out="main").collect()
    assert [r["main"]["text"] for r in out] == ["", "", "", LONG, LONG, rows[-1][1]] and [r["text"] for r in out] == [r[2] for r in rows]
    assert extracted(df.limit(0)).count() == 0
