"""Pages of many shapes through the extraction of main text."""

import time

import pytest

from tempofuse.llm.html_text import extract, smooth, threshold

P = "A paragraph of the article with words enough to count as its content, and then some more of them."
NAV = "<nav><ul><li><a href=/a>Home page</a></li><li><a href=/b>News today</a></li></ul></nav>"
FOOT = "<footer>&copy; host &middot; All rights reserved here.</footer>"


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


PAGES = {
    "names inside an article are no reason to drop": (NAV + f"<article><h1>T</h1><p>{P}</p><section id=discussion><p>{P} A</p></section><p class=share-price>{P} B</p><p>x <span class=search>{P}</span> y</p><div class=related-work><p>{P} C</p></div><p><label>Label</label></p></article>" + FOOT, ["T", P, P + " A", P + " B", f"x {P} y", P + " C", "Label"]),
    "a menu that is not closed ends at the article": ("<nav><ul><li><a href=/a>Home</a></li></ul>" + f"<article><h1>T</h1><p>{P}</p><p>{P}</p></article>" + FOOT, ["T", P, P]),
    "a menu that never ends is no evidence": (f"<nav><ul><li><a href=/a>Home</a></li></ul><div><h1>T</h1><p>{P}</p><p>{P}</p></div>", ["T", P, P]),
    "without an article the densest part": (NAV + f"<div class=ad>Buy this now, really.</div><div id=content><h1>T</h1><p>{P}</p><p>Short.</p><p>{P}</p></div><div class=sidebar><p>{P}</p></div><div class=comments><p>Reader says hello.</p></div>" + FOOT, ["T", P, "Short.", P]),
    "a heading before the part belongs to it": (NAV + f"<h1>Title</h1><div id=content><p>{P}</p><p>{P}</p></div>" + FOOT, ["Title", P, P]),
    "comments, forms and asides inside an article go": (f"<article><h1>T</h1><p>{P}</p><form><label>Name</label><input></form><section class=comments><p>{P}</p></section><aside>Side {P}</aside></article>", ["T", P]),
    "references and white space": ("<article><p>a &amp; b &eacute; &#8364;\n\n  c</p><p>x</p></article>", ["a & b é € c", "x"]),
    "paragraphs and emphasis that are not closed": ("<article><h1>T</h1><p><b>bold<br><p>next<p>last</article>", ["T", "bold", "next", "last"]),
    "lists and tables": (f"<article><p>{P}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table></article>", [P, "one", "two", "a", "b", "c"]),
    "a list of references in an article stays": (f"<article><p>{P}</p><ul><li><a href=x>ref one</a></li><li><a href=y>ref two</a></li></ul></article>" + FOOT, [P, "ref one", "ref two"]),
    "hidden parts go": (f"<article><p>{P}</p><p hidden>h</p><div style='display: none'>n</div></article>", [P]),
    "plain text": ("just text", ["just text"]),
    "a promotion, a menu and captions of the story stay": (NAV + f"<article><h1>T</h1><p>{P}</p><div class=promotion><p>Her promotion. {P}</p></div><figure class=overlay><figcaption>A picture of the hall</figcaption></figure><div class=menu><p>Soup of the day. {P}</p></div><p class=social>Social work. {P}</p><p>{P}</p></article>" + FOOT, ["T", P, f"Her promotion. {P}", "A picture of the hall", f"Soup of the day. {P}", f"Social work. {P}", P]),
    "the same names outside an article go": (f"<div class=menu>Soup {P}</div><div class=promotion>Buy {P}</div><article><h1>T</h1><p>{P}</p><p>{P}</p></article><div class=social>Share {P}</div>", ["T", P, P]),
    "sidebars, notices and comments go inside an article too": (f"<article><h1>T</h1><p>{P}</p><div class=sidebar><p>{P}</p></div><section class=notice><p>{P}</p></section><div id=comments><p>{P}</p></div><p>{P}</p></article>", ["T", P, P]),
    "an advert between paragraphs goes": (f"<article><p>{P}</p><div class='ad'>Buy {P}</div><p>{P}</p></article>", [P, P]),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, lines = PAGES[name]
    assert extract(page(html)).split("\n") == lines


def test_pages_without_text():
    assert extract("") == "" and extract("<nav>only</nav>") == "" and extract(page("<script>x</script>")) == "" and extract("<<<>>&&") != None  # noqa: E711


def test_broken_and_deep_pages_take_time_in_proportion():
    def took(n):
        best = 9.0
        for _ in range(3):
            t = time.perf_counter()
            assert extract("<div>" * n + P + "</div>" * n) == P
            assert extract("<ul><li><b>" * n + P) == P
            best = min(best, time.perf_counter() - t)
        return best

    assert took(16000) < 8 * took(4000)


def test_a_very_large_page():
    text = extract(page("<article>" + f"<p>{P}</p>" * 20_000 + "</article>"))
    assert text.count("\n") == 19_999


def test_the_dealt_steps():
    import numpy as np

    x = smooth(np.array([0, 0, 0, 9.0, 9, 9, 9, 0, 0, 0]))
    assert x.argmax() in (4, 5) and x[0] < 1 and 1 < threshold(x) < 8
