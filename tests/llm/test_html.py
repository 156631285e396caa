"""Pages whose names mean nothing, pages that are broken or deep, and what may not be dropped."""

import random
import re
import time

import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import html_wrapper  # noqa: E402

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper larch maple oak pine rowan spruce tulip willow yew".split()


def _said(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _plain_page(seed):
    """(html, text) of a host on which x1 is the menu, x4 the article, x5 a box that changes, x6 what readers say."""
    rng = random.Random(seed)
    title, paras = _said(rng, 6), [_said(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 6))]
    menu = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in WORDS[:6])
    body = "".join(f"<p>{p}</p>" for p in paras[:1]) + "<p class=warning>" + paras[1] + "</p>" + "".join(f"<p>{p}</p>" for p in paras[2:])
    share = "<div class=x9><span>Tell others</span> <b>now</b></div>"
    readers = "".join(f"<div class=x7><b>{_said(rng, 1)}</b><p>{_said(rng, 5)}</p></div>" for _ in range(rng.randint(0, 3)))
    page = f"<html><body><div class=x1><ul>{menu}</ul><p>The garden paper, every day</p></div><div class=x2><div class=x4><h1>{title}</h1>{body}{share}</div><div class=x5><p>{_said(rng, 8)}</p></div></div><div class=x6>{readers}</div><div class=x8>All rights with us</div></body></html>"
    return page, "\n\n".join([title, *paras])


def test_the_wrapper_decides_where_names_mean_nothing(spark):
    pages = [_plain_page(k) for k in range(40)]
    rows = [(k, f"http://plain.org/{k}", p) for k, (p, _) in enumerate(pages)] + [(100 + k, f"http://alone{k}.org/", p) for k, (p, _) in enumerate(pages[:5])]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == want for k, (_, want) in enumerate(pages))
    assert any(got[100 + k] != pages[k][1] for k in range(5))  # alone, a page cannot be told apart


def test_paragraphs_are_never_dropped_by_name():
    page = "<article><h1>T</h1>" + "".join(f"<p class={c}>{c} text</p>" for c in ("warning", "related", "share", "form", "replies", "notice")) + "<div class=share>gone</div><blockquote class=comment>said</blockquote></article>"
    assert html_wrapper.extract(page).split("\n\n") == ["T", *(f"{c} text" for c in ("warning", "related", "share", "form", "replies", "notice")), "said"]


def test_equal_pages_keep_their_text(spark):
    page = _plain_page(1)[0].replace("x4", "article-body")
    rows = [(k, f"http://same.org/{k}", f"<html><body><nav>n</nav><article><h1>One</h1><p>and the same text</p><div><p>in a part</p></div></article><footer>f{k}</footer></body></html>") for k in range(6)]
    got = {r["text"] for r in html_wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"One\n\nand the same text\n\nin a part"}
    assert html_wrapper.extract(page)


DEEP = 20_000


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div>" * DEEP + "deep text" + "</div>" * DEEP, "deep text"),
        ("<div>" * DEEP + "open text", "open text"),
        ("<b>" * DEEP + "".join(f"<p>t{k}" for k in range(200)), "\n\n".join(f"t{k}" for k in range(200))),
        ("<div>" * DEEP + "</span></i></p>" * DEEP + "stray", "stray"),
        ("<article>" + "".join(f"<div><p>a{k}</p>" for k in range(5000)), "\n\n".join(f"a{k}" for k in range(5000))),
        ("<article>" + "".join(f"<h2>h{k}</h2><p>p{k}</p>" for k in range(5000)), "\n\n".join(f"{c}{k}" for k in range(5000) for c in "hp")),
        ("<table>" + "<tr><td>c" * DEEP, "\n\n".join(["c"] * DEEP)),
        ("<" * 100_000 + "1", "<" * 100_000 + "1"),
    ],
)
def test_deep_and_long_pages(page, want):
    began = time.time()
    assert html_wrapper.extract(page) == want
    w = html_wrapper.infer([page, page + "<p>more", page])
    ways, fixed = html_wrapper.content(html_wrapper.unpacked(html_wrapper.packed(w)))
    html_wrapper.skeleton(html_wrapper.stream(html_wrapper.parse(page)))
    assert html_wrapper.extract(page, ways, fixed) == want
    assert time.time() - began < 20


def test_broken_and_edge_rows(spark):
    rows = [(1, None, None), (2, "http://a.org/1", ""), (3, "http://a.org/2", "<div" * 5000), (4, "http://a.org/3", "</p></div>"), (5, None, "<p>x"), (5, None, "<p>x"), (6, "", "<div hidden>no<div>no</div></div>yes"), (7, "u", "<p>\x00 &#0; &nbsp; a&#x20AC;&amp;lt;")]
    df = spark.createDataFrame([(*r, ["z"], "s") for r in rows], "page_id long, url string, html string, ways array<string>, skeleton string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_wrapper.extract_pages(df).collect())
    assert got[:2] == [(1, "", 0), (2, "", 0)] and got.count((5, "x", 1)) == 2 and (6, "yes", 3) in got and got[-1][1].endswith("a€&lt;")


def _ids_page(seed, name):
    """_plain_page with a content box whose id is `name` and that has no class."""
    page, text = _plain_page(seed)
    return page.replace("<div class=x4>", f"<div id={name}>"), text


@pytest.mark.parametrize("name", [lambda k: f"post-{k + 1}", lambda k: "".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=8)), lambda k: f"post-{1000 + k}", lambda k: "same"])
@pytest.mark.parametrize("n", [5, 40])
def test_ids_that_differ_by_page(spark, name, n):
    pages = [_ids_page(k, name(k)) for k in range(n)]
    rows = [(k, f"http://ids.org/{k}", p) for k, (p, _) in enumerate(pages)] + [(0, "http://ids.org/0", pages[0][0])]
    got = html_wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == n + 1 and all(r["text"] == pages[r["page_id"]][1] for r in got)


def test_fitting_long_lists_takes_linear_time():
    took = []
    for n in (4_000, 8_000, 16_000):
        page = "<div>" + "".join(f"<div><p id=u{k}x>text {k}</p></div>" for k in range(n)) + "</div>"
        began = time.time()
        html_wrapper.infer([page])
        took.append(time.time() - began)
    assert took[1] < 2 and took[2] < 3.5 * took[1]


def test_names_do_not_drop_parts_of_the_content(spark):
    def page(k):
        inner = f"<h1>head {k}</h1><div class=notice>noted {k} in the article</div><section class=search><p>how we searched {k}</p></section><ul class=menu><li>soup {k}<li>bread {k}</ul><ul class=menu><li><a href=/>up {k}</a></ul><div class=notice>the same words</div><div class=comments>said {k}</div>"
        return f"<html><body><div class=notice>cookies</div><article>{inner}<p>end {k}</p></article></body></html>"

    want = lambda k: "\n\n".join([f"head {k}", f"noted {k} in the article", f"how we searched {k}", f"soup {k}", f"bread {k}", f"end {k}"])
    rows = [(k, f"http://n.org/{k}", page(k)) for k in range(8)]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == want(k) for k in range(8))
    two = "<body><div class=menu>m</div><article><p>one</p></article><article><p>two and more</p></article><div class=related><article>other</article></div></body>"
    assert html_wrapper.extract(two) == "one\n\ntwo and more"
    assert html_wrapper.extract("<div class=widget><p>all there is</p></div>") == "all there is"


def _matches(x, page):
    """Whether a wrapper's expression, as a plain regular expression over tags and texts, is one of a page's stream."""

    def rule(g):
        inner = "T" if g.value == html_wrapper.TEXT else f"<{re.escape(g.value)}>{''.join(map(rule, g.items))}</{re.escape(g.tag)}>"
        return f"(?:{inner}){g.kind}"

    def said(g):
        return "T" if g.value == html_wrapper.TEXT else f"<{g.value}>{''.join(map(said, g.items))}</{g.tag}>"

    return re.fullmatch(rule(x), said(page)) is not None


@pytest.mark.parametrize("seed", range(60))
def test_the_wrapper_is_an_expression_of_every_page(seed):
    rng = random.Random(seed)

    def some(depth):
        return "".join(rng.choice(["w", "<p>t</p>", f"<div>{some(depth - 1)}</div>", f"<ul>{some(depth - 1)}</ul>", "<h2>h</h2>"]) for _ in range(rng.randint(0, 5))) if depth else "x"

    pages = [some(3) for _ in range(rng.randint(1, 6))]
    w = html_wrapper.infer(pages)
    assert all(_matches(w, html_wrapper.stream(html_wrapper.parse(p))) for p in pages)


def test_long_lists_lose_no_group(monkeypatch):
    monkeypatch.setattr(html_wrapper, "WIDE", 4)
    pages = []
    for k in range(100):
        legal = "<section class=legal><p>All rights are ours.</p></section>" * (k in (10, 11, 12))
        pages.append(f"<body><div class=main><h1>Title {k}</h1><p>What {k} says is said in words of its own.</p><div class='c{k // 3}'><p>And more by {k}.</p></div>{legal}</div></body>")
    w = html_wrapper.unpacked(html_wrapper.packed(html_wrapper.infer(pages)))
    walk, values = [w], set()
    while walk:
        x = walk.pop()
        values.add(x.value)
        assert not x.items or sum(y.chars for y in x.items) == x.chars  # nothing is left out
        assert len(x.items) <= 40
        walk += x.items
    assert {f"div c{k}" for k in range(33)} <= values
    ways, fixed = html_wrapper.content(w)
    for k in (3, 10):
        assert html_wrapper.extract(pages[k], ways, fixed) == f"Title {k}\n\nWhat {k} says is said in words of its own.\n\nAnd more by {k}."
