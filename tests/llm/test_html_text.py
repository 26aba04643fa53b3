import time
from html.parser import HTMLParser

import numpy as np

from provrank.llm.html_text import LABELLED, blocks, extract, features, grow, is_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><!-- ad --><div class="ad">Buy this now.</div>
<article><h1>Head &amp; more</h1><p><b>First &eacute;  line<br>two.<p>Short.</p><div class="share">Share this</div><form>Mail <input name=x></form></article>
<section id="comments"><article><p>I liked it very much, thank you all.</p></article></section><aside>Other</aside><footer>&copy; site</footer>"""


def test_page():
    assert main_text(PAGE) == "Head & more First é line two. Short."


def test_pages_without_marks_use_density():
    long = "word " * 40
    page = f"<div><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul><p>{long}</p><p>{long}</p><ul><li><a href=z>three</a></li></ul></div>"
    assert main_text(page) == " ".join([long.strip()] * 2)


def test_tree_fits_its_table():
    assert all(is_text(r[:-1]) == bool(r[-1]) for r in LABELLED)


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<script>x") == main_text("<!-- ") == ""
    assert main_text("<article>a &lt;b&gt; &#x41;&#66; &am <p cla") == "a <b> AB &am"
    assert main_text("<nav><ul><li>x<article><p>kept text</article>") == "kept text"
    assert main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    assert main_text("<main><p class=notice>no<p>yes</main>") == "yes"


def test_frame(spark):
    df = spark.createDataFrame([(1, PAGE, "t"), (2, None, "t"), (2, None, "t"), (3, "", "t")], "page_id long, html string, Text string")
    out = extract(df).collect()
    assert sorted((r.page_id, r.n_chars) for r in out) == [(1, len(main_text(PAGE))), (2, 0), (2, 0), (3, 0)]
    assert extract(df.limit(0)).count() == 0


def test_features_of_blocks_and_neighbours_by_hand():
    page = "<p>a b c</p><p>d <a href=x>ef gh</a></p><div><a href=y>i</a></div>"
    found = blocks(page)
    assert [b[0] for b in found] == ["a b c", "d ef gh", "i"]
    want = [(3, 0.0, 0, 0.0, 3, 5 / 7, 2), (3, 5 / 7, 3, 0.0, 1, 1.0, 2), (1, 1.0, 3, 5 / 7, 0, 0.0, 2)]
    assert all(abs(x - y) < 1e-12 for f, w in zip(features(found), want, strict=True) for x, y in zip(f, w, strict=True))


def test_grown_tree_takes_the_best_cut_of_all():
    r = np.random.default_rng(3)
    for _ in range(20):
        x, y = r.integers(0, 6, (40, 3)).astype(float), r.integers(0, 2, 40).astype(float)
        gini = lambda p: len(p) * p.mean() * (1 - p.mean()) if len(p) else 0.0
        best = min(gini(y[x[:, c] <= v]) + gini(y[x[:, c] > v]) for c in range(3) for v in range(5))
        c, cut, *_ = grow(x, y, 1)
        assert abs(gini(y[x[:, c] <= cut]) + gini(y[x[:, c] > cut]) - best) < 1e-9


class Article(HTMLParser):
    """The text of the article elements, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.parts += [" "] * (tag in ("p", "br", "h1"))

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.parts += [" "] * (tag in ("p", "h1"))

    def handle_data(self, data):
        self.parts += [data] * (self.depth > 0)


def test_every_page_of_the_table_gives_its_article(spark, small):
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        plain = Article()
        plain.feed(r.html)
        plain.close()
        assert main_text(r.html) == " ".join("".join(plain.parts).split())


def test_words_and_links_decide_under_ambiguous_names_and_in_lists():
    for name in ("side", "share", "skip", "alert", "search", "form", "related", "social"):
        page = f"<article><p>{'a b c d ' * 9}</p><p class={name}>{'real words here ' * 9}</p><div class={name}>Share now</div><p>{'x y ' * 20}</p></article>"
        assert main_text(page).count("real") == 9 and "Share" not in main_text(page)
        assert "real" not in main_text(f"<p class={name}>{'real words here ' * 9}</p><article><p>a b c</p></article>")
    links = "".join(f"<li><a href=/{k}>link {k}</a></li>" for k in range(5))
    assert main_text(f"<article><p>{'text ' * 30}</p><ul>{links}</ul><p>{'more ' * 30}</p></article>") == " ".join(["text"] * 30 + ["more"] * 30)
    assert main_text(f"<article><p>{'text ' * 30}</p><p><a href=x>the source</a></p><p>{'more ' * 30}</p></article>").count("the source") == 1


def test_deep_nesting_is_linear():
    began = time.perf_counter()
    assert main_text("<article>" + "<div>" * 40_000 + "deep" + "</div>" * 40_000) == "deep"
    assert main_text("<article>" + "<p class=x>" * 40_000 + "deep") == "deep"
    assert time.perf_counter() - began < 10
