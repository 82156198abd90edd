import math
import random
import time

import pytest

from tidewire.llm import html_tree
from tidewire.llm.html_tree import blocks_of, extract_text, low_nodes
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, text string, host int"


def text_of(spark, *sources):
    rows = [(i, f"http://h{i}.example.com/x", s, "t", 1) for i, s in enumerate(sources)]
    found = extract_text(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    return [r["text"] for r in found.orderBy("page_id").collect()]


def test_pages_without_their_furniture(spark):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>'
        '<nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">buy</div>'
        '<header>site</header><div id="cookie-notice">we use</div><article class="post"><header><h1>A &amp;&lt;b&gt; title</h1></header>'
        "<p><b>One  two\n three<br><p>Four &eacute; &#8364;<p>five <i>six</i>seven<div>in div<ul><li>l1<li>l2</ul></div>"
        '<form><input value="q">search</form><aside>side</aside><table><tr><td>c1<td>c2</table>'
        '<section id="comments"><p>reader says</p></section></article><div class="sidebar">s</div><footer>&copy; me</footer></body></html>'
    )
    assert text_of(spark, page) == ["A &<b> title\nOne two three\nFour é €\nfive sixseven\nin div\nl1\nl2\nc1\nc2"]


def test_pages_without_an_article(spark):
    found = text_of(
        spark,
        '<body><div class="menu">m</div><main><p>in main</p></main><div>out</div></body>',
        '<div class="menuBar">m</div><div class="content">kept</div>plain<p hidden>no</p><p style="display: none">no</p>',
        "no markup at all &amp; 3 < 4",
    )
    assert found == ["in main", "kept\nplain", "no markup at all & 3 < 4"]


def test_odd_sources(spark):
    odd = [None, "", "   ", "<", "<p", "<p>a", "<article><p>x</article>", "<script>never closed <p>x", '<p class="a>b</p><p>c', "<!-- open", "</p></div>a<//>b", "<p>" * 3000 + "deep", "<b>" * 3000 + "x"]
    found = text_of(spark, *odd)
    assert found[:4] == ["", "", "", "<"] and found[5] == "a" and found[6] == "x" and found[7] == "" and found[11] == "deep" and found[12] == "x"


def test_nodes_that_repeat_on_a_host_go(spark):
    rows = []
    for i in range(40):
        own = f"<p>story {i} of its own {i * i}</p>"
        rows.append((i, "https://Site.example.com:80/" + str(i), f'<article><h1>t{i}</h1>{own}<div class="x7">read more here</div></article>', "t", 1))
    rows += [(100 + i, None, "<article><p>the same copy</p></article>", "t", 1) for i in range(40)]
    rows += [(5, "https://site.example.com/5", rows[5][2], "t", 1)]
    pages = spark.createDataFrame(rows, SCHEMA)
    found = {r["page_id"]: r["text"] for r in extract_text(pages).collect()}
    assert found[5] == "t5\nstory 5 of its own 25" and found[100] == "the same copy"
    assert extract_text(pages).count() == len(rows)


def test_few_pages_are_not_judged(spark):
    rows = [(i, "http://a.example.com/", f"<article><p>own {i}</p><div>again</div></article>", "t", 1) for i in range(5)]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit("a.example.com"))
    assert low_nodes(pages).count() == 0


def test_empty_table(spark):
    assert extract_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_page_keeps_every_block():
    page = "<body><article>" + "".join(f"<p>para {i}</p>" for i in range(20_000)) + "</article></body>"
    assert [t for _, t, _ in blocks_of(page)] == [f"para {i}" for i in range(20_000)]


def test_copies_of_a_page_change_no_text(spark):
    page = lambda i: f"<body><article><p>story {i} tells of {i * 7}</p><div class=x7>read more here</div></article></body>"

    def texts(copies):
        rows = [(i, "http://one.example.com/x", page(i), "t", 1) for i in range(30)]
        rows += [(100 + i, "http://one.example.com/x", page(3), "t", 1) for i in range(copies)]
        return {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}

    alone, beside = texts(0), texts(70)
    assert all(t == f"story {i} tells of {i * 7}" for i, t in alone.items())
    assert {k: t for k, t in beside.items() if k < 100} == alone
    assert {t for k, t in beside.items() if k >= 100} == {alone[3]}


BADLY_CLOSED = {
    "no end": "<p " * 100_000,
    "quotes without end": '<a "' * 80_000,
    "an end inside quotes": '<a ">" ' * 60_000,
    "one open quote": "<p " * 100_000 + '">',
    "a name without end": "<p" * 150_000 + ' ">',
    "deep": "<div>" * 60_000 + "x",
    "ends without a start": "<div>" * 50_000 + "</p>" * 50_000,
    "cells below": "<div>" * 40_000 + "<td></td>" * 40_000,
    "items above": "<li><ul>" + "<div>" * 40_000 + "<li></li>" * 40_000,
}


@pytest.mark.parametrize("kind", BADLY_CLOSED)
def test_time_is_in_proportion_however_badly_closed(kind):
    began = time.process_time()
    blocks_of(BADLY_CLOSED[kind])
    assert time.process_time() - began < 5


def test_tags_that_never_end_are_text():
    assert [t for _, t, _ in blocks_of("<p>a <b c")] == ["a <b c"]
    assert [t for _, t, _ in blocks_of('<p>a <b title="x>y">c</b> <i "d')] == ['a c <i "d']


def test_numbers_of_any_length_are_decoded():
    source = "<p>&#" + "9" * 9_000 + "; &#" + "0" * 9_000 + "65; &#x" + "0" * 9_000 + "41; &#; &#x; &#66 &amp;</p>"
    assert [t for _, t, _ in blocks_of(source)] == ["\ufffd A A &#; &#x; B &"]


def test_a_teaser_beside_the_story_is_not_the_region(spark):
    story = "<p>" + "the story goes on " * 20 + "</p><p>and ends</p>"
    teaser = '<article class="more"><p>read that too</p></article>'
    found = text_of(spark, f"<main>{story}</main>{teaser}", f"<main>{story}{teaser}</main>", f"<main><p>kicker</p><article>{story}</article></main>")
    assert found == ["the story goes on " * 19 + "the story goes on\nand ends"] * 3


def of_one_host(spark, sources):
    rows = [(i, "http://one.example.com/x", s, "t", 1) for i, s in enumerate(sources)]
    found = extract_text(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()
    return [r["text"] for r in found]


def test_places_in_a_style_are_judged_apart(spark):
    """Before, the elements of one path were one node, and the story kept its unnamed neighbours."""
    pages = [f"<body><div>Home News</div><div>story {i} tells of {i * 7}</div><div>All ours</div></body>" for i in range(30)]
    other = [f"<body><div>a page {i} of</div><div>its own layout</div><p>{i}</p></body>" for i in range(3)]
    found = of_one_host(spark, pages + other)
    assert found[:30] == [f"story {i} tells of {i * 7}" for i in range(30)]
    assert found[30:] == [f"a page {i} of\nits own layout\n{i}" for i in range(3)]


def test_an_element_is_judged_with_its_styles(spark):
    """Before, elements of two styles were never judged, as each style is on too few pages."""
    styles = ["<p>read on</p>", "<ul><li>more</li><li>of it</li></ul>"]
    page = lambda i, below: f"<article><p>story {i} of {i * 7}</p><div class=x7>{below}</div></article>"
    assert of_one_host(spark, [page(i, styles[i % 2]) for i in range(12)]) == [f"story {i} of {i * 7}" for i in range(12)]
    # one more style that differs on each page: the element is not noisy, nor are its repeated parts on enough pages
    mixed = of_one_host(spark, [page(i, styles[i % 2] if i % 3 else f"<h2>see {i}</h2>") for i in range(12)])
    assert mixed[0] == "story 0 of 0\nsee 0" and mixed[1] == "story 1 of 7\nmore\nof it"


def noisy_by_definition(pages):
    """{path of (style, place) pairs: pages} of the noisy elements; a page is a text or a list of (label, page)."""
    def styled(page):
        return page if isinstance(page, str) else tuple(f"#{n}" if isinstance(p, str) else n for n, p in page)

    def importance(shown):
        m = len(shown)
        return 1.0 if m == 1 else -sum(k / m * math.log(k / m, m) for k in (shown.count(s) for s in set(shown)))

    noisy = {}

    def judge(at, here):
        """(composite importance, all below noisy) of the element at ``at``, which is on the pages ``here``."""
        shown = [styled(p) for p in here]
        value, low = importance(shown), True
        if not isinstance(here[0], str):
            below = 0.0
            for style in set(shown):
                like = [p for p, s in zip(here, shown) if s == style]
                found = [judge((*at, (style, i)), [p[i][1] for p in like]) for i in range(len(style))]
                below += len(like) / len(here) * sum(v for v, _ in found) / len(found)
                low &= all(x for _, x in found)
            weight = 0.9 ** len(set(shown))
            value = (1 - weight) * value + weight * below
        low &= value < html_tree.LOW
        if low and at:
            noisy[at] = len(here)
        return value, low

    judge((), pages)
    return noisy


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_composite_importance_equals_its_definition(spark, seed):
    draw = random.Random(seed)

    def furniture(depth):
        if depth == 0 or draw.random() < 0.3:
            return draw.choice(["more"] * 20 + ["less"])
        return [("div", furniture(depth - 1)) for _ in range(draw.choice([1, 2, 2, 2]))]

    fixed = [furniture(3) for _ in range(3)]
    pages = []
    for i in range(60):
        below = draw.choices([*fixed, furniture(2)], [8, 4, 2, 1])[0]
        pages.append([("h1", f"title {i}"), ("section", [("p", draw.choice(["a"] * 20 + ["b"])), ("section", below)])])

    def source(page):
        return page if isinstance(page, str) else "".join(f"<{n}>{source(p)}</{n}>" for n, p in page)

    rows = [("h", source(p)) for p in pages]
    tree = html_tree.style_tree(spark.createDataFrame(rows, "host string, html string").repartition(3))
    got = sorted(r["m"] for r in html_tree.noisy_elements(tree).collect())
    want = noisy_by_definition(pages)
    assert got == sorted(want.values()) and max(len(at) for at in want) > 3
    assert any(len(at) < max(len(b) for b in want if b[: len(at)] == at) for at in want)    # some noisy inner element


def test_few_pages_of_a_style_are_not_judged(spark):
    pages = [f"<div>Home</div><div>story {i} of {i * 7}</div>" for i in range(5)]
    assert of_one_host(spark, pages) == [f"Home\nstory {i} of {i * 7}" for i in range(5)]
