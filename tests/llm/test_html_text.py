"""Main text of pages: path scores against a plain version, selection on pages of several kinds, linear time."""

import math
import time

import pytest

from chronofold.llm import html_text as H

LONG = "This is a long sentence, with words and commas, that tells of something. It goes on and on; and then it ends. "


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div class="content no-sidebar"><p>Hello world, this is the main text.</p></div>', "Hello world, this is the main text."),
        ('<div class="page has-menu"><article><p>Hello main.</p></article><div>foot</div></div>', "Hello main."),
        ('<div class="layout-with-sidebar"><article><p>Hello main.</p></article></div>', "Hello main."),
        ('<div class="sidebar"><article><p>Kept.</p></article></div>', "Kept."),
        (f"<article><h1>T</h1><p>{LONG}</p><ul><li><a href=x>Home</a></li><li><a href=y>About</a></li></ul><p>Short.</p><p>See <a>this</a>, ok.</p></article>", f"T {LONG.strip()} Short. See this, ok."),
        (f"<body><nav>Menu</nav><div class=post><h2>Head</h2><p>{LONG}</p></div><div class='post-comments'>{LONG}</div><footer>F</footer></body>", f"Head {LONG.strip()}"),
        (f"<main><p>{LONG}</p><table><tr><td>1<td>two</table></main><aside>{LONG}</aside>", f"{LONG.strip()} 1 two"),
        (f"<body><form><div id=content><h1>T</h1><p>{LONG}</p></div><input value=x><label>Name</label><button>Send</button></form></body>", f"T {LONG.strip()}"),
        (f"<form action=/x><article><p>{LONG}</p></article><div class=menu>Menu</div></form>", LONG.strip()),
        (f"<div role=form><main><p>{LONG}</p></main></div>", LONG.strip()),
        (f"<div><p>{LONG}</p></div><form>Your name and mail here</form>", LONG.strip()),
        (f"<article><p>{LONG}</p><form>Your name and mail here</form></article>", LONG.strip()),
        ("<form></form>", ""),
        ("<p>a<p>b&nbsp;&amp;<br>c", "a b & c"),
        ("<a href=1>only</a> <a>links</a>", "only links"),
        ("just text", "just text"),
        ("<div class=menu></div>", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_pages(page, want):
    assert H.main_text(page) == want


def test_path_scores_equal_a_plain_version():
    page = H.Page(f"<article><h1>Title, one</h1><p>{LONG}<b>bold</b></p><div><p>x</p></div></article><div><span>out. there</span></div>")
    nodes = [(e.path, e.link, t) for e, t, _ in page.nodes]
    got = H.path_scores(nodes, page.parents, page.central)

    def up(p):
        return [p, *up(page.parents[p])] if p >= 0 else []

    def steps(p, q):
        a, b = up(p)[::-1], up(q)[::-1]
        same = sum(x == y for x, y in zip(a, b, strict=False))
        return len(a) + len(b) - 2 * same

    per = {}
    for p, link, t in nodes:
        x = per.setdefault(p, [0, 0, 0])
        x[2] += 1
        if not link:
            x[0] += len(t.strip())
            x[1] += len(H.PUNCTUATION.findall(t))
    assert set(got) == set(per)
    for p in per:
        w = {q: H.NEAR ** steps(p, q) for q in per}
        length, points = (sum(w[q] * per[q][k] / per[q][2] for q in per) / sum(w.values()) for k in (0, 1))
        assert got[p] == pytest.approx(length * math.log2(2 + points) * (H.PRIOR if page.central[p] else 1))


@pytest.mark.parametrize("part", ['<a "', "<b>x", "<b>", "<p>", "<!--", "<div>", "<li>z", "<a '\">", "<![CDATA["])
def test_long_broken_pages_take_linear_time(part):
    began = time.time()
    H.main_text(part * 50_000 + "</i>" * 50_000)
    assert time.time() - began < 10


def test_extract_keeps_every_row(spark):
    rows = [(1, "u", "<p>x</p>", "e"), (1, "u", "<p>x</p>", "e"), (None, None, None, None), (2, "u", "", "e"), (3, "u", f"<p>{'long text, ' * 50000}</p>", "e")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = [("x", 1), ("x", 1), ("", 0), ("", 0), (("long text, " * 50000).strip(), 549999)]
    assert sorted((r.text, r.n_chars) for r in got) == sorted(want)
