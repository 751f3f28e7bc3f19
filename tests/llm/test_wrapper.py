"""Wrapper induction on pages with known main text, on the given pages, and on hard rows."""

import html
import random
import re
from collections import Counter

import pytest

from gatelight.llm import wrapper
from tests.llm.helpers import one_to_one

SF = "/root/testdata/sf0.01"


def _page(i, body, side="Read our other sites"):
    """A page without semantic elements: only alignment tells the template from the text."""
    return (
        f"<html><head><title>t{i}</title><script>var a='<p>no</p>';</script></head><body><div class='top'>Daily Post</div><div><ul><li><a href='/'>Home</a><li><a href='/x'>World</a></ul></div>"
        f"<table><tr><td>{side}<td><div>{body}</div></table><div>All rights reserved by the Daily Post and its writers everywhere</div></body></html>"
    )


def test_template_is_told_by_alignment():
    words = ["red", "green", "blue", "stone", "river"]
    random.seed(4)
    bodies = [[" ".join(random.choices(words, k=random.randrange(8, 40))) + f" {i} {j}" for j in range(random.randrange(1, 5))] for i in range(12)]
    pages = [_page(i, "".join(f"<p>{p}</p>" for p in b)) for i, b in enumerate(bodies)]
    assert wrapper.texts_of_block(pages) == ["\n".join(b) for b in bodies]


def test_first_page_null_or_of_another_layout():
    bodies = [[f"text {i} {j} " + "river stone " * (3 + i) for j in range(1 + i % 3)] for i in range(12)]
    bodies = [[p.strip() for p in b] for b in bodies]
    pages = [_page(i, "".join(f"<p>{p}</p>" for p in b)) for i, b in enumerate(bodies)]
    wanted = ["\n".join(b) for b in bodies]
    index = "<body><div class='top'>Daily Post</div><ul><li>One<li>Two</ul><div>Page not found</div></body>"
    for first in (None, "", "<p>", index):
        assert wrapper.texts_of_block([first, *pages])[1:] == wanted, first


def test_banner_on_some_pages():
    bodies = [f"text {i} " + "river stone " * (3 + i) for i in range(12)]
    banner = "<div>The Daily Post moves to another place in May</div>"
    pages = [f"<body><div>{banner if i % 3 else ''}<p>{b}</p></div></body>" for i, b in enumerate(bodies)]
    assert wrapper.texts_of_block(pages) == [b.strip() for b in bodies]


def test_simple_tree_matching_counts():
    a = wrapper.slot_of(wrapper.parse("<div><p>x</p><ul><li>1</ul><table><tr><td>t</table></div>"))
    b = wrapper.slot_of(wrapper.parse("<div><table><tr><td>t</table><p>y</p><h2>z</h2><ul><li>1<li>2</ul></div>"))
    score, pairs = wrapper.match(a, b)
    # The page, the division, the run of paragraphs and headings, the list and the run of items match; the table crosses.
    assert [(x.tag, len(y.nodes)) for x, y in pairs if x.tag in ("p", "li")] == [("p", 2), ("li", 2)]
    assert len(pairs) == 5 and score == 10


def _best_score(a, b):
    """The largest number of matching nodes by trying every alignment of the children."""
    if not wrapper._like(a, b):
        return 0

    def best(i, j):
        if i == len(a.children) or j == len(b.children):
            return 0
        taken = _best_score(a.children[i], b.children[j])
        return max(best(i + 1, j), best(i, j + 1), taken + best(i + 1, j + 1) if taken else 0)

    return best(0, 0) + 1 + (a.names == b.names)


def _random_tree(rng, depth):
    children = [_random_tree(rng, depth - 1) for _ in range(rng.randrange(5))] if depth else []
    return wrapper.Slot(rng.choice(["div", "table", "p", "ul"]), rng.choice(["", "x"]), False, [], "", children)


@pytest.mark.parametrize("cells, pairs", [(1 << 18, 10_000), (2, 10_000)])
def test_matching_equals_every_alignment(monkeypatch, cells, pairs):
    monkeypatch.setattr(wrapper, "_MOST_CELLS", cells)
    monkeypatch.setattr(wrapper, "_MOST_PAIRS", pairs)
    rng = random.Random(7)
    for _ in range(150):
        a, b = _random_tree(rng, 2), _random_tree(rng, 2)
        score, found = wrapper.match(a, b)
        assert score == _best_score(a, b)
        assert score == sum(1 + (x.names == y.names) for x, y in found)


def test_constant_nodes_of_any_tag_are_template():
    # No class names, no article: what all pages share in one place goes, whatever its tag.
    random.seed(2)
    body = lambda i: [" ".join(random.choices(["red", "green", "blue", "stone"], k=random.randrange(9, 30))) + f" {i} {j}" for j in range(1 + i % 4)]
    bodies = [body(i) for i in range(64)]
    page = lambda b: "<body><ul><li>Home<li>About</ul><h2>Daily Post</h2><div>" + "".join(f"<p>{p}</p>" for p in b) + "<p>Subscribe to our letter, it is free.</p></div><p>All rights reserved</p></body>"
    pages = [page(b) for b in bodies]
    assert wrapper.texts_of_block(pages) == ["\n".join(b) for b in bodies]
    alone = [wrapper.texts_of_block([p])[0] for p in pages]
    assert all("Subscribe" in t for t in alone) and any("Home" in t for t in alone)
    # On few pages a paragraph that is alike may be the text itself.
    assert all("Subscribe" in t for t in wrapper.texts_of_block(pages[:5]))


def test_ten_thousand_siblings():
    import resource
    import time

    rng = random.Random(1)
    kinds = ["<h3>t{0}</h3>", "<div><p>text {0}</p></div>", "<table><tr><td>a{0}</table>", "<ul><li>x<li>{0}</ul>"]
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    mixed = ["<body><div>" + "".join(rng.choice(kinds).format(f"{i} {k}") for i in range(10_000)) + "</div></body>" for k in range(2)]
    assert all(t.count("\n") > 9_000 for t in wrapper.texts_of_block(mixed))
    rows = ["<body>" + "".join(f"<h3>t{i} {k}</h3><p>text {i} {k}</p>" for i in range(5_000 + k)) + "</body>" for k in range(4)]
    assert [t.count("\n") + 1 for t in wrapper.texts_of_block(rows)] == [10_000, 10_002, 10_004, 10_006]
    assert time.time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_what_is_set_apart():
    page = (
        "<body><header>Site</header><nav>Menu</nav><div class='cookie-notice'>We bake</div><main><article><header><h1>Ti&amp;tle &#233;</h1></header>"
        "<p>One<br>two  three</p><div class='ad'>Buy</div><aside>Side</aside><form>Mail <input></form><pre>a\n b</pre><p><b>Open bold<br><p>Next&nbsp;one"
        "<section id=comments><p>First!</p></section><footer>By me</footer></article></main><footer>&copy;</footer><noscript>js</noscript></body>"
    )
    assert wrapper.texts_of_block([page]) == ["Ti&tle é\nOne two three\na b\nOpen bold\nNext one"]


def test_equal_pages_keep_their_text():
    page = "<body><nav>Menu</nav><article><h1>Same</h1><p>Same text</p></article></body>"
    assert wrapper.texts_of_block([page] * 5) == ["Same\nSame text"] * 5
    near = [page.replace("</article>", f"<p>end {i}</p></article>") for i in range(6)]
    assert wrapper.texts_of_block(near) == [f"Same\nSame text\nend {i}" for i in range(6)]


def test_odd_pages():
    assert wrapper.texts_of_block([None, "", "plain &lt;text", "<", "<p", "<!-- x", "</div>" * 50, "<div>" * 5000 + "deep"])[2] == "plain <text"
    assert wrapper.texts_of_block(["<div>" * 5000 + "deep"]) == ["deep"]


def _plain(page):
    """The articles of the given pages by their markup."""
    article = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1)
    blocks = [" ".join(html.unescape(re.sub(r"</?(b|br)>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
    return "\n".join(b for b in blocks if b)


def test_given_pages_whole(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = Counter(map(tuple, wrapper.main_texts(pages).collect()))
    wanted = Counter((r.page_id, r.url, _plain(r.html), len(_plain(r.html))) for r in pages.collect())
    assert got == wanted


def test_hard_rows(spark):
    article = "<body><nav>m</nav><article><p>" + "long text " * 20_000 + "</p></article>"
    rows = [(1, "http://a.org/1", None), (2, None, "<p>x"), (None, "no url", "<p>y"), (3, "https://u@A.org:80/", ""), (3, "https://u@A.org:80/", ""), (4, "http://a.org", article), (5, "http://a.org/", article)]
    pages = spark.createDataFrame([(*r, "clash", 3) for r in rows], "page_id long, url string, html string, text string, host int")
    got = sorted(map(tuple, one_to_one(wrapper.main_texts(pages), len(rows))), key=repr)
    long_text = ("long text " * 20_000).strip()
    wanted = [(1, "http://a.org/1", "", 0), (2, None, "x", 1), (None, "no url", "y", 1), (3, "https://u@A.org:80/", "", 0), (3, "https://u@A.org:80/", "", 0), (4, "http://a.org", long_text, len(long_text)), (5, "http://a.org/", long_text, len(long_text))]
    assert got == sorted(wanted, key=repr)
    assert wrapper.main_texts(pages.limit(0)).count() == 0


def test_hot_host_is_split(spark):
    rows = [(i, "http://hot.org/" if i % 3 else f"http://h{i % 7}.org/", f"<article><p>page {i}</p></article>") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = wrapper.extract(pages, pages_per_block=8, most_hot=10)
    assert sorted((r.page_id, r.text) for r in got.collect()) == [(i, f"page {i}") for i in range(400)]


def test_tail_of_a_host_has_a_template(spark):
    # One page more than a block holds, and than two, without semantic elements.
    rows = [(i, f"http://h{n}.org/{i}", n, _page(i, f"<p>text {i} " + "stone " * (5 + i % 7) + "</p>")) for n in (8, 9, 16, 17, 65) for i in range(n)]
    pages = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "page_id long, url string, html string")
    for size in (8, 64):
        got = sorted((r.url, r.text) for r in wrapper.extract(pages, pages_per_block=size).collect())
        assert got == sorted((url, f"text {i} " + " ".join(["stone"] * (5 + i % 7))) for i, url, _, _ in rows)
