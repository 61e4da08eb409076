import html
import math
import re
import time

import numpy as np
import pytest

from citeforge.llm import tagpaths as P

SF = "/root/testdata/sf0.001"
LONG = [f"The {k} harbour was quiet, and the boats lay still; nobody spoke. It rained." for k in ("first", "second", "third")]
BODY = "".join(f"<p>{x}</p>" for x in LONG)
WANT = "\n".join(LONG)


def plain_scores(path, chars, marks):
    """The scores by plain loops."""
    support = []
    for amount in (chars, marks):
        ratio = [sum(a for a, q in zip(amount, path) if q == p) / path.count(p) for p in path]
        kernel = {d: math.exp(-d * d / 2) for d in range(-2, 3)}
        smooth = []
        for i in range(len(path)):
            near = [(kernel[d], ratio[i + d]) for d in kernel if 0 <= i + d < len(path)]
            smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
        score = {p: sum(s for s, q in zip(smooth, path) if q == p) / path.count(p) for p in set(path)}
        most = max(score.values())
        support.append({p: s / most if most else 0.0 for p, s in score.items()})
    return [support[0][p] + support[1][p] - support[0][p] * support[1][p] for p in path]


def test_scores_equal_plain_loops():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 60):
        path, chars, marks = rng.integers(0, 7, n), rng.integers(1, 400, n).astype(float), rng.integers(0, 9, n).astype(float)
        got = P.path_scores(path, chars, marks, 7)[path]
        assert np.allclose(got, plain_scores(path.tolist(), chars.tolist(), marks.tolist()))


@pytest.mark.parametrize(
    "page",
    [
        f"<body><article>{BODY}</article></body>",
        f"<body><header><h1>Site</h1><p>Slogan of the site, in many words, as ever.</p></header><main><nav>a b c</nav>{BODY}<aside>Read more, much more.</aside></main></body>",
        f"<div class='top menu'><ul><li><a href=x>Home</a><li><a>News</a></ul></div><div class=story>{BODY}</div><div id='comments'><p>I disagree, strongly! Really, I do.</p></div>",
        # No tag, class or id tells the parts apart: the ratios of their paths do.
        f"<div><div><a href=1>Home</a></div><div><a href=2>News</a></div><div><a href=3>Sport</a></div></div><section>{BODY}</section><div><div>About</div><div>Help</div></div>",
        f"<table><tr><td><a>One</a><br><a>Two</a><br><a>Three</a><td>{BODY}</table>",
        f"<body><div class='cookie-notice'>We use cookies, of course.</div><form><label>Name</label><p>Sign in.</p></form><div class='content has-sidebar'>{BODY}<div class='share'>Share this!</div></div><!-- x > y --><footer>Imprint</footer>",
        f"<body><article>{BODY}<section class=comments><article class=comment><p>First! {'Nice, nice. ' * 90}</p></article></section></article>",
        f"<article>{BODY}<script>if (a < b) document.write('<p>no</p>')</script><style>p::after{{content:'</p>'}}</style><noscript>Turn it on.</noscript></article>",
        f"<article>{BODY}<!-- never closed <p>no</p>",
        f"<article>{BODY}<a href='never closed>no",
        f"<article>{BODY}<p hidden>no</p><p style='color:red;display: none'>no</p></article>",
    ],
)
def test_page_shapes(page):
    assert P.main_text(page) == WANT


def test_blocks_and_references():
    page = "<article><h1>A&amp;B&nbsp;&#8211; x</h1><p>one\n <b>t</b>wo<br>three &lt;p&gt; &copy &unknown; 5 < 6<p> <ul><li>item<li><a href=x>link</a> text</ul>tail</article>"
    assert P.main_text(page) == "A&B – x\none two three <p> © &unknown; 5 < 6\nitem\nlink text\ntail"


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<script>x</script>", "<nav>only a menu</nav>", "<", "<a"])
def test_nothing_to_extract(page):
    assert P.main_text(page) in ("", "<")


def test_names_are_ignored_where_nothing_is_left():
    assert P.main_text("<div class='header'><p>All there is.</p></div>") == "All there is."


@pytest.mark.parametrize("unit", ["<div>", "<b>", "<a href='", "<x \"", "<!--", "<", "&", "<p><b>x<br>", "<li>", "</div>", "<title>", "a <ul><li>b"])
def test_time_follows_length(unit):
    """Twice the page takes about twice the time, however it is damaged."""

    def took(n):
        began = time.process_time()
        P.main_text(unit * n)
        return time.process_time() - began

    took(100)
    assert took(40_000) < 0.3 + 4 * took(20_000)


def test_rows(spark):
    rows = spark.createDataFrame([(1, "u", f"<article>{BODY}</article>", "x", "x"), (1, "u", f"<article>{BODY}</article>", "x", "x"), (None, None, None, "x", "x"), (2, "v", "word " * 200_000, "x", "x")], "page_id long, url string, html string, text string, n_chars string")
    got = P.extract(rows).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == [(0, "", 0), (1, "u", len(WANT)), (1, "u", len(WANT)), (2, "v", 999_999)]
    assert P.extract(rows.limit(0)).collect() == []


def test_query_finds_all_articles(spark):
    """On these pages the article element says what is wanted; the extraction has to agree wholly."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in P.op12_tag_paths(spark, SF).collect()}
    for k, page in pages.items():
        inner = re.sub("<br>", " ", re.search("<article>(.*)</article>", page, re.S)[1])
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[k] == (want, len(want))
