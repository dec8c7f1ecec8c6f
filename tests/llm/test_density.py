"""The main text by density: without telling names, without densities, in forms and under words of comments."""

from __future__ import annotations

import re

import pytest

from brindle.llm import html
from tests.conftest import DATA


def nameless(page):
    """The page without class, id and role, its section tags as divs."""
    page = re.sub(r"""\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", "", page, flags=re.I)
    return re.sub(r"(?i)(</?)(article|main|nav|header|footer|aside|section)\b", r"\1div", page)


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(f"{DATA}/sf0.1/pages.parquet").limit(800).collect() if r.html]


def test_articles_are_found_without_names(pages):
    same = [html.extract(nameless(p)) == html.extract(p) for p in pages]
    assert sum(same) >= 0.95 * len(same)


def test_without_densities_they_are_not(pages, monkeypatch):
    real = html.densities
    zero = lambda dom, out, texts: ([0.0] * len(dom.tag), [0.0] * len(dom.tag), *real(dom, out, texts)[2:])
    want = [html.extract(p) for p in pages[:200]]
    monkeypatch.setattr(html, "densities", zero)
    assert sum(html.extract(nameless(p)) == w for p, w in zip(pages, want, strict=False)) < 20


TEXT = "".join(f"<p>Plain sentence {i} of the main text with a good many words in it.</p>" for i in range(6))
WANT = "\n".join(["Title", *(f"Plain sentence {i} of the main text with a good many words in it." for i in range(6))])


@pytest.mark.parametrize("start,end", [
    ('<form id="aspnetForm" action="x"><div><article>', "</article></div><input name=q><button>Go</button></form>"), ("<form><div>", "</div></form>"),
    ('<div class="post comments-open">', "</div>"), ('<div id="discussion">', "</div>"), ('<div class="page has-sidebar newsletter">', "</div>"),
])
def test_wrapped_pages_stay_whole(start, end):
    assert html.extract(f"<html><body><nav><a href=x>Menu</a></nav>{start}<h1>Title</h1>{TEXT}{end}<footer>Foot</footer></body></html>") == WANT


def test_small_forms_and_comments_go():
    more = '<form><p>Sign up for our letter, it comes each week.</p></form><div class="comments"><p>A reader says that all of this is very well put.</p></div>'
    assert html.extract(f"<body><div><h1>Title</h1>{TEXT}</div>{more}</body>") == WANT
    assert html.extract(f"<body><div><h1>Title</h1>{TEXT}{more}</div></body>") == WANT


def test_notices_beside_the_path_go_by_their_sum():
    notice = "<div><p>We use small files on your device.</p><p>Fine</p></div>"
    assert html.extract(f"<body>{notice}<div><h1>Title</h1>{TEXT}</div><div>Imprint and further words of the house.</div></body>") == WANT


def test_text_right_in_the_body():
    assert html.extract(f"<body><h1>Title</h1>{TEXT}<div><p>One more.</p><p>Last.</p></div></body>") == f"{WANT}\nOne more.\nLast."


def test_inline_wrappers_are_no_core():
    assert html.extract("<body><div><a href=x>Menu</a></div><div><h1>Title</h1><p><b>All of the text is bold, every word of it, from the first to the last.</b></p></div><div>Small print of the house.</div></body>") == "Title\nAll of the text is bold, every word of it, from the first to the last."
