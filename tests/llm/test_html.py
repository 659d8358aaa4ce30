"""Main text: marks on wrappers, words inside labels, and time that is linear in the page."""

import time

import pytest

from sparkloom.llm.html_text import main_text

LONG = ["The first paragraph of the article, with commas, and enough words to be prose, says this. " * 3, "The second one, longer still, goes on, and on, about the same thing as the first one did. " * 3]
ARTICLE = "".join(f"<p>{x.strip()}</p>" for x in LONG)
TEXT = "\n".join(x.strip() for x in LONG)


@pytest.mark.parametrize("attrs", ["class='has-sidebar'", "class='tracking-tight'", "class='no-comments'", "id='page-menu-open'", "class='hasSidebar' role='form'", "class='layout navbar'"])
@pytest.mark.parametrize("beside", ["", "<div class='sidebar'><p>Beside it.</p></div>", "<nav><a href=1>One</a> <a href=2>Two</a></nav>"])
def test_marked_wrappers_keep_the_article(attrs, beside):
    assert main_text(f"<body><div {attrs}>{beside}<div id=c>{ARTICLE}</div></div></body>") == TEXT
    assert main_text(f"<body>{beside}<form action=x><div {attrs}>{ARTICLE}</div></form></body>") == TEXT


def test_marks_beside_an_article_still_count():
    note = "<div class='cookie-notice'><p>" + "We use cookies, many, many of them. " * 20 + "</p></div>"
    comments = "<div class='comments'><p>" + "Nice article, I like it, really. " * 60 + "</p></div>"
    assert main_text(f"<body>{note}<div>{ARTICLE}</div>{comments}</body>") == TEXT
    assert main_text(f"<body><div class='comments'>{ARTICLE}</div></body>") == ""
    assert main_text("<body><div class='cookie-notice'><p>We use cookies.</p></div></body>") == ""


PARTS = [f"Paragraph {i} of it, which goes on, and says more than one thing about the matter at hand, at some length." for i in "abcde"]
BODY = "".join(f"<p>{x}</p>" for x in PARTS)


@pytest.mark.parametrize("attrs", ["class='comments-enabled'", "id='comments-page'", "class='sidebar-open'", "class='page-with-ads layout sidebar'"])
def test_marks_of_states_and_layouts(attrs):
    assert main_text(f"<body><div {attrs}>{BODY}</div></body>") == "\n".join(PARTS)


def test_marks_lower_points():
    assert main_text("<body><div class='sidebar-left layout'><p>A short note.</p></div></body>") == "A short note."
    lead = "The lead stands outside, before the rest. " * 7
    assert main_text(f"<body><p>{lead}</p><div class='layout-with-rail sidebar'>{BODY}</div></body>") == "\n".join([lead.strip(), *PARTS])
    menu, rail = "<div class='layout menu'><p>Home, news.</p></div>", "<div class='page-layout sidebar'><p>Read this, too.</p></div>"
    comments = "<div class='comments-section'><p>" + "Nice article, I like it, really. " * 60 + "</p></div>"
    assert main_text(f"<body>{menu}<div>{BODY}</div>{rail}{comments}</body>") == "\n".join(PARTS)


def test_marks_on_paragraphs():
    page = "<article><p class='teaser'>The lead, in short.</p><p class='social-theory'>Of theory.</p><p class='ad-box'>Buy, buy!</p><p>The rest, <span class='share-buttons'>share</span>of it.</p></article>"
    assert main_text(page) == "The lead, in short.\nOf theory.\nThe rest, of it."


def test_labels():
    assert main_text("<div><p>The word <label>inside</label> stays, of course, here.</p><p>And more of it, too.</p></div>") == "The word inside stays, of course, here.\nAnd more of it, too."
    assert "Name" not in main_text(f"<div><div><label>Name</label><input></div>{ARTICLE}</div>")


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<b>" * n + "x<hr>" * n,
        lambda n: "<p><button>" + "<div>" * n,
        lambda n: "<div>" * n + "<article></article>" * n,
        lambda n: "<a><div>" + "<i>" * n + "</a>" * n,
        lambda n: "<table><tr><td><table>" + "<div>" * n + "<td></td>" * n,
        lambda n: "<div class=menu>" * n + "x, " * 100 + "<p class=nav>y</p>" * n,
        lambda n: "<div class=menu><p>long, enough text, to count as some prose of the page.</p></div>" * n,
    ],
)
def test_linear(page):
    def seconds(n):
        began = time.process_time()
        main_text(page(n))
        return time.process_time() - began

    seconds(100)
    assert seconds(40_000) < 16 * max(seconds(5_000), 0.02)
